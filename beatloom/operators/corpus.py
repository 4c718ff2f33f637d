"""Evaluating a whole corpus of songs, expectations and charts.

Joins of songs, expectations, charts and reports ask for a merge join: their rows hold arrays and texts that
Spark takes for shorter than they are, and they grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from beatloom.functions import scalars as S
from beatloom.operators import compare as C
from beatloom.operators import evaluation as V
from beatloom.operators import metrics as M
from beatloom.session import cut

KEYS = ["song_id", "difficulty"]


def join_expectations(expectations: DataFrame, charts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expectations that have a chart, and ``song:difficulty`` of those that have none."""
    k = charts.select("song_id", F.col("key_difficulty").alias("difficulty")).distinct()
    k = k.hint("merge")
    found = expectations.join(k, KEYS, "left_semi")
    missing = expectations.join(k, KEYS, "left_anti").select(
        *KEYS, F.concat_ws(":", F.col("song_id").cast("string"), "difficulty").alias("missing")
    )
    return found, missing


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per repeat of a key (E6). Counted, not ranked, so a hot key stays one row."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return n.select(*keys, F.explode(F.sequence(F.lit(2), F.col("n"))).alias("repeat"))


def lint(songs: DataFrame, expectations: DataFrame) -> DataFrame:
    """Corpus problems in (song, code) order columns."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    real = F.col("source_type") == "real_clip"

    def rule(fires, severity, code, message):
        return F.when(fires, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message")))

    untagged = ~(
        F.coalesce(F.array_contains("tags", "regression"), F.lit(False)) | F.coalesce(F.array_contains("tags", "smoke"), F.lit(False))
    )
    # --- fixed values: codes and messages
    per_song = songs.select(
        "song_id",
        F.explode(
            F.array_compact(
                F.array(
                    rule(real & blank("source_provenance"), "warning", "missing_source_provenance", "Real clips should record where the review audio came from."),
                    rule(real & blank("review_status"), "warning", "missing_review_status", "Real clips should declare a review status."),
                    rule(real & empty("review_notes"), "warning", "missing_review_notes", "Real clips should include review notes for human reviewers."),
                    rule(real & empty("review_checklist"), "warning", "missing_review_checklist", "Real clips should include a review checklist for regression signoff."),
                    rule(real & untagged, "warning", "missing_execution_tag", "Real clips should be tagged for at least one execution lane such as smoke or regression."),
                    rule(F.coalesce(F.col("baseline_status") == "approved_baseline", F.lit(False)) & blank("baseline_chart_id"), "warning",
                         "missing_baseline_chart_id", "Approved baselines should record the chart artifact or snapshot ID they were approved against."),
                )
            )
        ).alias("i"),
    ).select("song_id", "i.*")

    def add(df, severity, code, message):
        return df.select("song_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"))

    same_song = add(duplicates(songs, ["song_id"]), "error", "duplicate_song_id", "Song IDs must be unique within the corpus.")
    same_level = add(duplicates(expectations, KEYS), "error", "duplicate_expectation_difficulty",
                     "Each song should only define one expectation per difficulty.")
    bare = add(songs.join(expectations.select("song_id").distinct().hint("merge"), "song_id", "left_anti"), "warning", "missing_expectations",
               "Song has no expectations yet.")
    return per_song.unionByName(same_song).unionByName(same_level).unionByName(bare)


def totals(results: DataFrame, expectations: DataFrame, missing: DataFrame) -> DataFrame:
    """One row of corpus counts (A12). ``results``: passed and comparison status per expectation."""
    r = results.agg(
        F.count(F.lit(1)).alias("evaluated"), F.count_if("passed").alias("passed"),
        F.count("comparison").alias("comparisons"), F.count_if(F.col("comparison") == "regressed").alias("severe"),
    )
    return r.crossJoin(expectations.agg(F.count(F.lit(1)).alias("total"))).crossJoin(missing.agg(F.count(F.lit(1)).alias("missing"))).select(
        "total", "passed", (F.col("evaluated") - F.col("passed") + F.col("missing")).alias("failed"), "missing", "comparisons", "severe"
    )


def tag_summary(expectations: DataFrame, results: DataFrame, songs: DataFrame) -> DataFrame:
    """Expectations per tag; a missing chart counts as failed."""
    x = expectations.select(*KEYS).join(results.select(*KEYS, "passed").hint("merge"), KEYS, "left")
    per_song = x.groupBy("song_id").agg(F.count(F.lit(1)).alias("t"), F.count_if("passed").alias("p"))
    s = songs.select("song_id", F.explode("tags").alias("tag")).join(per_song.hint("merge"), "song_id")
    return s.groupBy("tag").agg(F.sum("t").alias("total"), F.sum("p").alias("passed")).withColumn("failed", F.col("total") - F.col("passed"))


def difficulty_summary(expectations: DataFrame, results: DataFrame) -> DataFrame:
    """Expectations per difficulty with passed, failed and missing."""
    x = expectations.select(*KEYS).join(results.select(*KEYS, "passed", F.lit(True).alias("found")).hint("merge"), KEYS, "left")
    s = x.groupBy("difficulty").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.col("found").isNull()).alias("missing")
    )
    return s.withColumn("failed", F.greatest(F.col("total") - F.col("passed") - F.col("missing"), F.lit(0)))


def value_summaries(songs: DataFrame, results: DataFrame) -> DataFrame:
    """Counts of source types, review, baseline and comparison states (A15), in long form."""
    unspecified = lambda c: F.coalesce(F.col(c), F.lit("unspecified"))
    v = songs.select(
        F.col("source_type").alias("source_type"), unspecified("review_status").alias("review_status"),
        unspecified("baseline_status").alias("baseline_status"),
    )
    names = ["source_type", "review_status", "baseline_status"]
    g = v.groupingSets([[n] for n in names], *names).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 0b011, "source_type").when(F.col("g") == 0b101, "review_status").otherwise("baseline_status")
    key = F.when(F.col("g") == 0b011, F.col("source_type")).when(F.col("g") == 0b101, F.col("review_status")).otherwise(F.col("baseline_status"))
    songs_part = g.select(kind.alias("kind"), key.alias("key"), "n")
    status = results.where(F.col("comparison").isNotNull()).groupBy(F.col("comparison").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return songs_part.unionByName(status.select(F.lit("comparison").alias("kind"), "key", "n"))


def evaluate_charts(charts, notes, measures, expectations, focused) -> DataFrame:
    """Reports of all charts. Notes are cut first: metrics, streaks and previews all read them."""
    notes = cut(notes)
    metrics = M.chart_metrics(charts, notes, measures)
    pairs = charts.select("chart_id", "song_id", "key_difficulty", F.col("difficulty").alias("chart_difficulty"))
    return C.report_row(V.evaluate(metrics, pairs, expectations, focused), M.note_preview(notes))


def evaluate_corpus(songs, expectations, focused, candidate, baseline=None) -> dict[str, DataFrame]:
    """Everything about a corpus.

    ``candidate`` and ``baseline`` are (charts, notes, measures). Reports are cut after scoring,
    because every summary below reads them.
    """
    reports = cut(evaluate_charts(*candidate, expectations, focused))
    found, missing = join_expectations(expectations, candidate[0])
    comparison = None
    if baseline is not None:
        comparison = cut(C.compare(reports, evaluate_charts(*baseline, expectations, focused)))
        results = reports.join(comparison.select(*KEYS, F.col("status").alias("comparison")).hint("merge"), KEYS, "left")
    else:
        results = reports.withColumn("comparison", F.lit(None).cast("string"))
    problems = lint(songs, expectations)
    t = totals(results, expectations, missing)
    n_lint = problems.agg(F.count(F.lit(1)).alias("lint"), F.count_if(F.col("severity") == "error").alias("lint_errors"))
    n_tags = songs.select(F.explode("tags").alias("tag")).agg(F.count_distinct("tag").alias("tags"))
    t = t.crossJoin(n_lint).crossJoin(n_tags).withColumn(
        "status", F.when((F.col("failed") == 0) & (F.col("missing") == 0) & (F.col("lint_errors") == 0), "PASS").otherwise("FAIL")
    )
    return {
        "totals": t, "results": results, "missing": missing, "comparison": comparison, "lint": problems,
        "tags": tag_summary(expectations, results, songs), "difficulties": difficulty_summary(expectations, results),
        "values": value_summaries(songs, results),
    }


# --- G10 -------------------------------------------------------------------------------


def report_summary(passed="passed") -> F.Column:
    c = F.col
    ok = F.concat(
        F.lit("PASS "), c("chart_difficulty"), F.lit(" score="), S.fixed2("score"), F.lit(" notes="), c("note_count").cast("string"),
        F.lit(" measures="), c("measure_count").cast("string"), F.lit(" lanes="), F.array_join("lanes", ","),
    )
    codes = F.array_join(F.transform("issues", lambda i: i["code"]), ",")
    bad = F.concat(F.lit("FAIL "), c("chart_difficulty"), F.lit(" score="), S.fixed2("score"), F.lit(" issues="), codes)
    return F.when(c(passed), ok).otherwise(bad)


def render_results(results: DataFrame, songs: DataFrame, density: DataFrame) -> DataFrame:
    """Report lines of every result: song_id, difficulty, line_no, line.

    Density is one entry per measure of a single chart.
    """
    c = F.col
    d = density.groupBy("chart_id").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("bar_index", "note_count"))),
                lambda x: F.concat(F.lit("m"), x["bar_index"].cast("string"), F.lit("="), x["note_count"].cast("string")),
            ),
            " ",
        ).alias("density")
    )
    s = songs.select("song_id", "source_fixture", "source_type", "source_provenance", "tags", "review_status", "baseline_status", "baseline_chart_id",
                     *(["clip_duration_seconds"] if "clip_duration_seconds" in songs.columns else [F.lit(None).cast("double").alias("clip_duration_seconds")]))
    r = results.join(s.hint("merge"), "song_id").join(d.hint("merge"), "chart_id", "left")
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ",")).otherwise("-")
    unspecified = lambda x: F.coalesce(c(x), F.lit("unspecified"))
    head = F.concat(
        c("song_id").cast("string"), F.lit(" ["), c("difficulty"), F.lit("] "), report_summary(), F.lit(" source="), c("source_fixture"),
        F.lit(" source_type="), c("source_type"), F.lit(" duration="),
        F.coalesce(F.concat(S.fixed2("clip_duration_seconds"), F.lit("s")), F.lit("unknown")), F.lit(" tags="), tags,
        F.lit(" review="), unspecified("review_status"), F.lit(" baseline="), unspecified("baseline_status"),
        F.lit(" baseline_chart="), F.coalesce("baseline_chart_id", F.lit("none")),
    )
    share = lambda x: F.when(c("note_count") > 0, c(f"n_{x}") / c("note_count")).otherwise(F.lit(0.0))
    focus = F.concat_ws(" ", *[F.concat(F.lit(f"{x}="), c(f"n_{x}").cast("string"), F.lit("@"), S.fixed2(share(x))) for x in ("kick", "snare", "hihat_closed")])
    usage = F.array_join(F.transform("usage", lambda u: F.concat(u["lane"], F.lit("="), u["n"].cast("string"))), " ")
    codes = F.array_join(F.transform("issues", lambda i: i["code"]), ",")
    # --- fixed values: line labels
    lines = F.array_compact(
        F.array(
            head,
            F.concat(F.lit("provenance "), c("source_provenance")),
            F.concat(F.lit("compare status="), c("comparison")),
            report_summary(),
            F.concat(F.lit("snapshot lanes="), F.array_join("lanes", ","), F.lit(" measures="), c("measure_count").cast("string"),
                     F.lit(" notes="), c("note_count").cast("string")),
            F.concat(F.lit("lane_usage "), usage),
            F.concat(F.lit("focused_lane_balance "), focus),
            F.concat(F.lit("measure_density "), F.coalesce("density", F.lit(""))),
            F.concat(F.lit("quality_flags same_lane_streak="), c("longest_run").cast("string"), F.lit(" measure_burstiness="), S.fixed2("burstiness")),
            F.concat(F.lit("note_preview "), F.array_join("preview", " | ")),
            F.concat(F.lit("issues "), F.when(F.size("issues") > 0, codes).otherwise("none")),
        )
    )
    return r.select("song_id", "difficulty", F.posexplode(lines).alias("line_no", "line"))


def render_summary(corpus: dict[str, DataFrame]) -> DataFrame:
    """Head of the report: section, line (G10). Every section is a handful of summary rows."""
    t = corpus["totals"]
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    c = F.col
    head = t.select(
        F.lit(0).alias("section"), F.lit("").alias("sort_key"),
        text("corpus pass=", c("passed"), "/", c("total"), " failed=", c("failed"), " missing=", c("missing"),
             " comparisons=", c("comparisons"), " tags=", c("tags"), " lint=", c("lint")).alias("line"),
    )
    order = F.create_map(*[F.lit(x) for kv in {"source_type": 1, "review_status": 2, "baseline_status": 3, "comparison": 4}.items() for x in kv])
    label = F.create_map(*[F.lit(x) for kv in {"source_type": "source_summary", "review_status": "review_summary", "baseline_status": "baseline_summary", "comparison": "comparison_summary"}.items() for x in kv])
    pairs = lambda: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "n"))), lambda x: F.concat(x["key"], F.lit("="), x["n"].cast("string"))), " ")
    v = corpus["values"].groupBy("kind").agg(pairs().alias("p"))
    values = v.select(order[c("kind")].alias("section"), F.lit("").alias("sort_key"), F.concat(label[c("kind")], F.lit(" "), c("p")).alias("line"))
    tags = corpus["tags"].select(F.lit(5).alias("section"), c("tag").alias("sort_key"), text("tag_summary ", c("tag"), "=", c("passed"), "/", c("total")).alias("line"))
    dif = corpus["difficulties"].select(
        F.lit(6).alias("section"), c("difficulty").alias("sort_key"),
        F.concat(
            text("difficulty_summary ", c("difficulty"), "=", c("passed"), "/", c("total")),
            F.when(c("failed") > 0, text("/fail=", c("failed"))).otherwise(""), F.when(c("missing") > 0, text("/missing=", c("missing"))).otherwise(""),
        ).alias("line"),
    )
    lint_lines = corpus["lint"].select(
        F.lit(7).alias("section"), F.concat_ws("|", c("song_id").cast("string"), "code").alias("sort_key"),
        text("lint severity=", c("severity"), " code=", c("code"), " song=", c("song_id"), " message=", c("message")).alias("line"),
    )
    missing = corpus["missing"].select(F.lit(9).alias("section"), c("missing").alias("sort_key"), F.concat(F.lit("missing "), c("missing")).alias("line"))
    out = head
    for part in (values, tags, dif, lint_lines, missing):
        out = out.unionByName(part)
    return out
