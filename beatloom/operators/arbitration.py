"""Choosing and merging analyzer documents, and the hook for a user's own analyzer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatloom.functions import documents as D
from beatloom.functions import variants as V
from beatloom.operators import payloads as P

POLICY_ALIASES = {"never": "disabled", "on-failure": "on-error", "on-validate-failure": "on-invalid"}
FALLBACK_POLICIES = {"disabled", "on-error", "on-invalid", "on-error-or-invalid", "always"}
EVENT_POLICIES = {"disabled", "optional", "required"}
EVENTS = "array<variant>"


def with_analyzer(tracks: DataFrame, analyze: Callable[[pd.DataFrame], pd.DataFrame], key: str = "track_id") -> DataFrame:
    """Run a user callable over batches of tracks (U1): key, payload text, error text.

    The callable gets a pandas batch and returns ``payload`` texts in the same order. A batch that
    fails is retried row by row, and a row that fails becomes an error row for :func:`arbitrate`.
    """
    schema = T.StructType([tracks.schema[key], T.StructField("payload", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = list(analyze(batch)["payload"])
                if len(out) != len(batch):
                    raise ValueError(f"{len(out)} payloads for {len(batch)} tracks")
                errors = [None] * len(batch)
            except Exception:  # noqa: BLE001 - failures are data here
                out, errors = [], []
                for i in range(len(batch)):
                    try:
                        (payload,) = analyze(batch.iloc[i : i + 1])["payload"]
                        out.append(payload)
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        out.append(None)
                        errors.append(str(e))
            yield pd.DataFrame({key: batch[key].to_numpy(), "payload": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

    return tracks.mapInPandas(run, schema)


def stage_table(payloads: DataFrame) -> DataFrame:
    """Adds what merging needs: events, warnings, timing flag."""
    texts = lambda v: F.coalesce(F.array_compact(F.transform(V.items(V.get(v, "warnings")), V.text)), F.array().cast("array<string>"))
    return payloads.withColumns({"events": P.stage_events("raw"), "warnings": texts("raw"), "has_timing": P.has_timing("raw")})


def write_back(raw, events, warnings, defaults: dict, overrides: dict):
    """The document with chosen hits, its warnings and runtime facts in it; null stays null."""
    facts = lambda named: F.parse_json(F.to_json(F.struct(*[c.alias(k) for k, c in named.items()]))) if named else F.parse_json(F.lit("{}"))
    listed = lambda x: F.parse_json(F.to_json(x))
    return D.over(D.settled, "variant", raw, listed(events), listed(warnings), facts(defaults), facts(overrides))


def merge_events(timing: DataFrame, events: DataFrame, policy: str = "optional") -> DataFrame:
    """Put a second stage's hits onto the timing documents.

    Both sides: track_id, raw, and for ``events`` an optional error text. Non-empty events replace
    the timing side's own. ``raw`` comes back with the hits, warnings and runtime facts written into
    it, so that charts are made from them. With ``required``, ``violation`` names tracks that have none.
    """
    if policy not in EVENT_POLICIES:
        raise ValueError(f"unsupported event policy {policy!r}; expected one of {sorted(EVENT_POLICIES)}")
    t = stage_table(timing).select("track_id", "raw", "events", "warnings")
    e = stage_table(events)
    error = F.col("error") if "error" in events.columns else F.lit(None).cast("string")
    e = e.select("track_id", F.col("raw").isNotNull().alias("has_payload"), F.col("events").alias("new_events"), F.col("warnings").alias("event_warnings"), error.alias("failure"))
    if policy == "disabled":
        e = e.limit(0)
    j = t.join(e, "track_id", "left")
    ran = F.coalesce("has_payload", F.lit(False))
    n = F.coalesce(F.array_size("new_events"), F.lit(0))
    used = ran & (n > 0)
    number = n.cast("string")
    # --- fixed values: warning texts
    own = (
        F.when(used, F.concat(F.lit("Merged "), number, F.lit(" stage-2 drum-event candidates into timing-backed analyzer output")))
        .when(ran, "Event backend returned no drum-event candidates; timing-only payload kept")
        .when(F.lit(policy == "disabled"), "Stage-2 drum-event backend disabled; timing-only payload kept")
        .when(F.col("failure").isNotNull(), F.concat(F.lit("Stage-2 drum-event backend failed; timing-only payload kept: "), F.col("failure")))
        .otherwise("No stage-2 drum-event backend configured; timing-only payload kept")
    )
    prefixed = F.when(ran, F.transform("event_warnings", lambda w: F.concat(F.lit("event-backend: "), w))).otherwise(F.array().cast("array<string>"))
    violation = F.when(
        F.lit(policy == "required") & ~ran,
        F.coalesce(F.concat(F.lit("required event backend failed: "), F.col("failure")), F.lit("event policy is required but no event payload was given")),
    )
    warnings = F.concat("warnings", F.array(own), prefixed)
    facts = {"eventPolicy": F.lit(policy), "eventBackendRan": ran, "eventBackendUsed": used, "eventBackendCandidateCount": F.when(ran, n).otherwise(F.lit(0)), "eventBackendFailure": F.col("failure")}
    return j.select(
        "track_id", write_back(F.col("raw"), F.when(used, F.col("new_events")), warnings, {}, facts).alias("raw"),
        F.when(used, F.col("new_events")).otherwise(F.col("events")).alias("events"),
        warnings.alias("warnings"),
        ran.alias("event_backend_ran"), used.alias("event_backend_used"), F.when(ran, n).otherwise(F.lit(0)).alias("event_backend_count"),
        F.col("failure").alias("event_backend_failure"), violation.alias("violation"),
    )


def arbitrate(primary: DataFrame | None, fallback: DataFrame | None, policy: str = "disabled", validation: str = "none") -> DataFrame:
    """Choose between two analyzers per track.

    Both sides: track_id, raw, optional error. A missing or malformed document is an error. When
    the primary has timing but no hits, the fallback's hits are merged onto it. ``raw`` comes back with
    the chosen hits, warnings and runtime facts written into it, so that charts are made from them.
    Tracks without a usable document keep a null ``raw`` and the reason in ``failure``.
    """
    policy = POLICY_ALIASES.get(policy, policy)
    if policy not in FALLBACK_POLICIES:
        raise ValueError(f"unsupported fallback policy {policy!r}; expected one of {sorted(FALLBACK_POLICIES)}")
    if primary is None and fallback is None:
        raise ValueError("no analyzer payloads were given")
    has_primary, has_fallback = primary is not None, fallback is not None
    base = primary if has_primary else fallback

    def side(df, p):
        if df is None:
            df = base.limit(0)
        error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
        s = stage_table(df).withColumn("__e", error)
        s = P.validate_payload(s, validation)
        return s.select(
            "track_id", F.col("raw").alias(f"{p}_raw"), F.col("events").alias(f"{p}_events"), F.col("warnings").alias(f"{p}_warnings"),
            F.col("has_timing").alias(f"{p}_timing"), F.col("issue").alias(f"{p}_issue"),
            F.when(F.col("raw").isNull(), F.coalesce("__e", F.lit("document missing or malformed"))).alias(f"{p}_error"),
        )

    c = F.col
    j = side(primary, "p").join(side(fallback, "f"), "track_id", "full_outer")
    no_raw = c("p_raw").isNull()
    p_error = F.when(no_raw, F.coalesce("p_error", F.lit("document missing or malformed")))
    on_error, on_invalid = policy in ("on-error", "on-error-or-invalid"), policy in ("on-invalid", "on-error-or-invalid")
    lit = F.lit
    # --- fixed values: reasons and warning texts, in the order the rules apply
    rules = [
        (lit(not has_primary and has_fallback), lit("primary backend command not configured"),
         lit("analyzer wrapper used fallback backend because no primary backend command was configured")),
        (lit(policy == "always" and has_fallback), lit("fallback policy forced fallback backend"),
         lit("analyzer wrapper skipped primary backend because fallback policy was set to always")),
        (lit(on_error and has_fallback) & no_raw, F.concat(lit("primary backend failed: "), p_error),
         F.concat(lit("analyzer wrapper fell back after primary backend failure: "), p_error)),
        (lit(on_invalid and has_fallback) & ~no_raw & c("p_issue").isNotNull(), c("p_issue"),
         F.concat(lit("analyzer wrapper fell back after primary backend validation failed: "), c("p_issue"))),
    ]
    reason = message = F.when(lit(False), lit(None).cast("string"))
    for fires, why, text in rules:
        reason, message = reason.when(fires, why), message.when(fires, text)
    j = j.withColumns({"__why": reason, "__text": message})
    fell = c("__why").isNotNull()
    count = lambda p: F.coalesce(F.array_size(f"{p}_events"), lit(0))
    try_merge = ~fell & ~no_raw & lit(has_fallback and policy in ("on-invalid", "on-error-or-invalid", "always")) & c("p_timing") & (count("p") == 0)
    merged = try_merge & c("f_raw").isNotNull() & (count("f") > 0)
    merge_text = F.when(merged, F.concat(lit("analyzer wrapper merged "), count("f").cast("string"), lit(" fallback drum-event candidates onto primary timing output"))).when(
        try_merge & c("f_raw").isNotNull(), "analyzer wrapper kept timing-only primary output because fallback backend returned no usable drum-event candidates for stage-2 merge"
    ).when(
        try_merge, F.concat(lit("analyzer wrapper kept timing-only primary output after stage-2 fallback event merge failed: "), F.coalesce("f_error", lit("document missing or malformed")))
    )
    none = F.array().cast("array<string>")
    prefixed = F.when(merged, F.transform("f_warnings", lambda w: F.concat(lit("event-backend: "), w))).otherwise(none)
    closing = F.array_compact(
        F.array(
            lit("analyzer wrapper delegated to backend command"),
            F.when(c("p_issue").isNotNull(), F.concat(lit("analyzer wrapper primary backend validation warning: "), c("p_issue"))),
        )
    )
    warnings = F.when(fell, F.concat(F.coalesce("f_warnings", none), F.array("__text"))).when(
        ~no_raw, F.concat("p_warnings", F.coalesce(F.array_compact(F.array(merge_text)), none), prefixed, closing)
    )
    selected = F.when(fell, "fallback").when(merged, "primary+fallback-events").when(~no_raw, "primary")
    why = F.when(fell, c("__why")).otherwise(c("p_issue"))
    defaults = {"selectedBackend": selected, "fallbackPolicy": lit(policy), "validationMode": lit(validation), "fallbackUsed": fell, "fallbackReason": why}
    overrides = {"selectedBackend": F.when(merged, selected), "eventBackendUsed": F.when(merged, lit(True)), "eventBackendCandidateCount": F.when(merged, count("f"))}
    chosen = F.when(fell, c("f_raw")).otherwise(c("p_raw"))
    return j.select(
        "track_id",
        write_back(chosen, F.when(merged, c("f_events")), warnings, defaults, overrides).alias("raw"),
        F.when(fell, c("f_events")).when(merged, c("f_events")).otherwise(c("p_events")).alias("events"),
        warnings.alias("warnings"),
        selected.alias("selected_backend"),
        fell.alias("fallback_used"),
        why.alias("fallback_reason"),
        F.when(fell & c("f_raw").isNull(), F.coalesce("f_error", lit("document missing or malformed"))).when(~fell & no_raw, p_error).alias("failure"),
    )
