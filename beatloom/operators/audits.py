"""Audits of label coverage and of loop runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatloom.functions import labels as L
from beatloom.functions import variants as V


def label_counters(labels: DataFrame) -> DataFrame:
    """Counters per artifact and over all artifacts.

    ``labels``: artifact, counter, key. Both groupings come from one grouping-set aggregate; the
    overall rows have a null artifact.
    """
    g = labels.groupingSets([["artifact", "counter", "key"], ["counter", "key"]], "artifact", "counter", "key")
    return g.agg(F.count(F.lit(1)).alias("n"))


def lane_family(lane) -> Column:
    """Text before the first underscore."""
    return F.substring_index(lane, "_", 1)


def audit_labels(candidates: DataFrame, normalized: DataFrame, notes: DataFrame) -> DataFrame:
    """Long-form labels of three artifact stages.

    ``candidates``: artifact, label, note (raw hits); ``normalized`` and ``notes``: artifact, lane.
    """
    c = L.map_lane(candidates, "label", "note", "audit").withColumn(
        "__norm", F.coalesce(L.normalize_label("label", "full"), F.lit("<missing>"))
    )
    parts = F.array(
        F.struct(F.lit("raw").alias("counter"), F.col("__norm").alias("key")),
        F.when(F.col("lane").isNotNull(), F.struct(F.lit("mapped").alias("counter"), F.col("lane").alias("key"))),
        F.when(F.col("lane").isNotNull(), F.struct(F.lit("family").alias("counter"), lane_family("lane").alias("key"))),
        F.when(F.col("lane").isNull(), F.struct(F.lit("unmapped").alias("counter"), F.col("__norm").alias("key"))),
    )
    raw = c.select("artifact", F.explode(F.array_compact(parts)).alias("p")).select("artifact", "p.counter", "p.key")
    other = lambda df, name: df.where(F.col("lane").isNotNull()).select("artifact", F.lit(name).alias("counter"), F.col("lane").alias("key"))
    return raw.unionByName(other(normalized, "normalized")).unionByName(other(notes, "chart"))


def lane_audit(candidates: DataFrame, normalized: DataFrame, notes: DataFrame) -> DataFrame:
    """Label and lane counters of all artifacts."""
    return label_counters(audit_labels(candidates, normalized, notes))


def rank_counters(counters: DataFrame) -> DataFrame:
    """Position of each key by count, then name (T7); a closed set of counters over few keys."""
    w = Window.partitionBy("artifact", "counter").orderBy(F.col("n").desc(), "key")
    return counters.withColumn("rank", F.row_number().over(w))


# --- loop audit ------------------------------------------------------------------------------------


def _first_integer(warning: Column) -> Column:
    """First whitespace-separated token made of digits only."""
    tokens = F.filter(F.split(F.trim(warning), r"\s+"), lambda t: t.rlike("^[0-9]+$"))
    return F.get(tokens, F.lit(0)).try_cast("bigint")


def loop_counts(sources: DataFrame) -> DataFrame:
    """Stage-2, filtered and deduped counts read from the warnings of each source.

    A later stage-2 warning replaces the count of an earlier one; the others add up.
    """
    w = F.col("warnings")
    merged = F.filter(w, lambda x: x.contains("merged ") & x.contains("fallback drum-event candidates"))
    numbered = F.filter(F.transform(merged, _first_integer), lambda n: n.isNotNull())
    total = lambda word: F.aggregate(
        F.filter(w, lambda x: x.contains(word)), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(_first_integer(x), F.lit(0).cast("long"))
    )
    return sources.withColumns({
        "stage2_used": F.when(F.size(merged) > 0, F.lit(True)),
        "stage2_count": F.coalesce(F.try_element_at(numbered, F.lit(-1)), F.lit(0).cast("long")),
        "filtered_count": F.coalesce(total("filtered "), F.lit(0).cast("long")), "deduped_count": F.coalesce(total("deduped "), F.lit(0).cast("long")),
    })


def loop_totals(sources: DataFrame) -> DataFrame:
    """Totals over all sources (A27); backends are a handful of names."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ", ")
    return sources.agg(
        F.count(F.lit(1)).alias("source_count"), F.coalesce(F.bool_and(F.coalesce("stage2_used", F.lit(False))), F.lit(False)).alias("all_stage2_used"),
        F.coalesce(F.sum("stage2_count"), F.lit(0)).alias("stage2_total"), F.coalesce(F.sum("filtered_count"), F.lit(0)).alias("filtered_total"),
        F.coalesce(F.sum("deduped_count"), F.lit(0)).alias("deduped_total"), names("timing_backend").alias("timing_backends"), names("selected_backend").alias("selected_backends"),
    )


def attach_runs(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Run of each item: the first with its URI, else the one at its position.

    ``items``: batch, pos, source_uri; ``runs``: batch, pos, source_uri, run_id, status.
    """
    by_uri = runs.where(F.col("source_uri").isNotNull()).groupBy("batch", "source_uri").agg(F.min_by(F.struct("run_id", "status"), "pos").alias("u"))
    by_pos = runs.select("batch", "pos", F.struct("run_id", "status").alias("p"))
    j = items.join(by_uri, ["batch", "source_uri"], "left").join(by_pos, ["batch", "pos"], "left")
    r = F.coalesce("u", "p")
    return j.withColumns({"run_id": r["run_id"], "run_status": r["status"]}).drop("u", "p")


def first_artifact(artifacts: DataFrame) -> DataFrame:
    """First artifact URI of each run and type (J17): run_id, type, uri, pos."""
    return artifacts.groupBy("run_id", "type").agg(F.min_by("uri", "pos").alias("uri"))


def loop_audit(documents: DataFrame) -> dict[str, DataFrame]:
    """Summary of validation documents (G16): sources and totals.

    ``documents``: batch, raw - a document with validate_analyzer and runs_final lists.
    """
    a = documents.select("batch", F.posexplode(V.items(V.get("raw", "validate_analyzer"))).alias("pos", "a"))
    outs = F.transform(V.items(V.get("a", "logs")), lambda x: V.text(V.get(x, "stdout")))
    parsed = F.filter(F.transform(F.filter(outs, lambda t: F.ltrim(t).startswith("{")), F.try_parse_json), lambda v: V.is_object(v))
    a = a.select(
        "batch", "pos", V.text(V.get("a", "source", "source_uri")).alias("source_uri"), V.text(V.get("a", "source", "source_name")).alias("source_name"),
        V.flag(V.get("a", "validation", "imports_ok")).alias("imports_ok"), V.flag(V.get("a", "validation", "config_ok")).alias("config_ok"),
        F.get(parsed, F.lit(0)).alias("log"),
    )
    s = a.select(
        "batch", "pos", "source_uri", "source_name", "imports_ok", "config_ok", V.text(V.get("log", "analysis", "runtimeBackend")).alias("timing_backend"),
        V.text(V.get("log", "analysis", "runtimeSelectedBackend")).alias("selected_backend"), V.flag(V.get("log", "analysis", "runtimeFallbackUsed")).alias("fallback_used"),
        V.number(V.get("log", "analysis", "estimatedTempoBPM")).alias("tempo_bpm"), V.number(V.get("log", "analysis", "confidence")).alias("confidence"),
        F.coalesce(F.array_compact(F.transform(V.items(V.get("log", "warnings")), V.text)), F.array().cast("array<string>")).alias("warnings"),
    )
    r = documents.select("batch", F.posexplode(V.items(V.get("raw", "runs_final"))).alias("pos", "r")).select(
        "batch", "pos", V.text(V.get("r", "source_uri")).alias("source_uri"), V.text(V.get("r", "run_id")).alias("run_id"), V.text(V.get("r", "status")).alias("status"),
        V.items(V.get("r", "artifacts")).alias("artifacts"),
    )
    art = r.select("run_id", F.posexplode("artifacts").alias("pos", "x")).select("run_id", "pos", V.text(V.get("x", "type")).alias("type"), V.text(V.get("x", "uri")).alias("uri"))
    kinds = ["audio_analysis", "normalized_analysis", "base_chart", "final_chart"]
    wide = first_artifact(art).groupBy("run_id").pivot("type", kinds).agg(F.first("uri"))
    sources = attach_runs(loop_counts(s), r.drop("artifacts")).join(wide, "run_id", "left")
    return {"sources": sources, "totals": loop_totals(sources)}


def loop_markdown(sources: DataFrame, totals: DataFrame, title: str = "Loop audit") -> DataFrame:
    """Markdown lines of the loop audit: section, position, line_no, line."""
    # --- fixed values: line labels
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("None")) for x in p])
    c = F.col
    head = totals.select(F.lit(0).alias("section"), F.lit(0).alias("position"), F.posexplode(F.array(
        F.lit(f"# {title}"), F.lit(""), text("- Sources: ", c("source_count")), text("- Stage-2 candidate count: ", c("stage2_total")),
        text("- Filtered candidates: ", c("filtered_total")), text("- Deduped candidates: ", c("deduped_total")),
        F.concat(F.lit("- Selected backends: "), F.when(c("selected_backends") != "", c("selected_backends")).otherwise("none")), F.lit(""),
    )).alias("line_no", "line"))
    lines = F.concat(
        F.array(
            text("## ", F.coalesce("source_name", "source_uri")), text("- timing backend: ", c("timing_backend")), text("- selected backend: ", c("selected_backend")),
            text("- stage-2 used: ", F.when(c("stage2_used"), "True")), text("- stage-2 candidates: ", c("stage2_count")), text("- filtered: ", c("filtered_count")),
            text("- deduped: ", c("deduped_count")), text("- confidence: ", c("confidence")), text("- run id: ", c("run_id")),
        ),
        F.when(F.size("warnings") > 0, F.concat(F.array(F.lit("- warnings:")), F.transform("warnings", lambda w: F.concat(F.lit("  - "), w)))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("")),
    )
    body = sources.select(F.lit(1).alias("section"), c("pos").alias("position"), F.posexplode(lines).alias("line_no", "line"))
    return head.unionByName(body)
