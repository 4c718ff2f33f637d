"""Comparing a chart report with an approved baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom import constants as K
from beatloom.functions import scalars as S

KEYS = ["song_id", "difficulty"]


def preview_changes(base: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """Preview lines only one side has (E1): keys, change, line. Previews hold twelve lines.

    Both sides meet in one grouping, so that each is made once.
    """
    side = lambda df, new: df.select(*keys, "line", F.lit(new).alias("__new"))
    g = side(base, False).unionByName(side(cand, True)).groupBy(*keys, "line").agg(F.bool_and("__new").alias("added"), F.bool_or("__new").alias("either"))
    return g.where(F.col("added") == F.col("either")).select(*keys, "line", F.when(F.col("added"), "added").otherwise("removed").alias("change"))


def report_row(evaluated: DataFrame, preview: DataFrame) -> DataFrame:
    """Evaluation plus the preview lines as one array of at most twelve."""
    p = preview.groupBy("chart_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]).alias("preview"))
    return evaluated.join(p.hint("merge"), "chart_id", "left").withColumn("preview", F.coalesce("preview", F.array().cast("array<string>")))


def focused_delta(joined: DataFrame) -> DataFrame:
    """Focused-lane changes in long form from a joined base/candidate row."""
    share = lambda p, x: F.when(F.col(f"{p}note_count") > 0, F.col(f"{p}n_{x}") / F.col(f"{p}note_count")).otherwise(F.lit(0.0))
    rows = F.array(
        *[
            F.struct(
                F.lit(x).alias("lane"),
                F.col(f"b_n_{x}").alias("baseline_count"),
                F.col(f"n_{x}").alias("candidate_count"),
                (F.col(f"n_{x}") - F.col(f"b_n_{x}")).alias("count_delta"),
                (share("", x) - share("b_", x)).alias("share_delta"),
            )
            for x in K.FOCUSED_LANES
        ]
    )
    return joined.withColumn("focused", rows)


def join_baseline(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Candidate reports with their baseline report, if any, as ``b_`` columns."""
    cols = ["chart_id", "score", "passed", "note_count", "measure_count", "notes_per_measure", "issues", "preview", "chart_difficulty",
            *[f"n_{x}" for x in K.FOCUSED_LANES]]
    b = baseline.select(*KEYS, *[F.col(c).alias(f"b_{c}") for c in cols])
    return candidate.join(b.hint("merge"), KEYS, "left")


def _reasons(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items))


def compare(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Deltas, status and highlights of each candidate that has a baseline."""
    j = focused_delta(join_baseline(candidate, baseline).where(F.col("b_chart_id").isNotNull()))
    c = F.col
    j = j.withColumns(
        {
            "score_delta": c("score") - c("b_score"),
            "note_delta": c("note_count") - c("b_note_count"),
            "measure_delta": c("measure_count") - c("b_measure_count"),
            "density_delta": c("notes_per_measure") - c("b_notes_per_measure"),
            "preview_added": F.sort_array(F.array_except("preview", "b_preview")),
            "preview_removed": F.sort_array(F.array_except("b_preview", "preview")),
        }
    )
    j = j.withColumns(
        {
            "note_drift": F.abs(c("note_delta").cast("double")) / F.greatest(c("b_note_count"), F.lit(1)).cast("double"),
            "churn": F.size("preview_added") + F.size("preview_removed"),
            # the first lane with the largest shift
            "biggest": F.element_at(
                F.array_sort(
                    F.transform(
                        "focused",
                        lambda f, i: F.struct((-F.abs(f["share_delta"])).alias("s"), i.alias("i"), f["lane"].alias("lane"), f["share_delta"].alias("d")),
                    )
                ),
                1,
            ),
        }
    )
    score, drift, density, churn = c("score_delta"), c("note_drift"), F.abs("density_delta"), c("churn")
    shift = F.abs(c("biggest.d"))
    score_text = F.concat(F.lit("score_drop="), S.fixed2(score))
    drift_text = F.concat(F.lit("note_drift="), S.signed("note_delta"), F.lit(" ("), S.fixed2(drift * 100), F.lit("%)"))
    density_text = F.concat(F.lit("density_shift="), S.signed("density_delta", True))
    shift_text = F.concat(F.lit("focused_lane_shift="), c("biggest.lane"), F.lit("@"), S.signed(c("biggest.d"), True))
    churn_text = F.concat(F.lit("preview_churn="), churn.cast("string"))
    regress = _reasons(
        [F.when(score <= -0.15, score_text), F.when(drift >= 0.35, drift_text), F.when(density >= 1.5, density_text),
         F.when(shift >= 0.18, shift_text), F.when(churn >= 8, churn_text)]
    )
    watch = _reasons(
        [F.when((score > -0.15) & (score <= -0.05), score_text), F.when((drift < 0.35) & (drift >= 0.18), drift_text),
         F.when((density < 1.5) & (density >= 0.75), density_text), F.when((shift < 0.18) & (shift >= 0.08), shift_text),
         F.when((churn < 8) & (churn >= 4), churn_text)]
    )
    improve = _reasons([F.when(score >= 0.10, F.concat(F.lit("score_gain=+"), S.fixed2(score)))])
    j = j.withColumns({"__r": regress, "__w": watch, "__i": improve})
    failed, fixed = c("b_passed") & ~c("passed"), ~c("b_passed") & c("passed")
    codes = F.array_join(F.transform("issues", lambda i: i["code"]), ",")
    status = (
        F.when(failed, "regressed").when(fixed, "improved").when(F.size("__r") > 0, "regressed")
        .when(F.size("__w") > 0, "watch").when(F.size("__i") > 0, "improved").otherwise("stable")
    )
    highlights = (
        F.when(failed, F.array(F.lit("baseline passed but candidate failed"), F.concat(F.lit("candidate issues="), codes)))
        .when(fixed, F.array(F.lit("baseline failed but candidate passed"), F.concat(F.lit("score_delta="), S.fixed2(score))))
        .when(F.size("__r") > 0, c("__r")).when(F.size("__w") > 0, c("__w")).when(F.size("__i") > 0, c("__i"))
        .otherwise(F.array(F.lit("within_regression_thresholds")))
    )
    return j.select(
        *KEYS, c("b_chart_difficulty").alias("baseline_difficulty"), c("chart_difficulty").alias("candidate_difficulty"),
        c("b_passed").alias("baseline_passed"), c("passed").alias("candidate_passed"),
        "score_delta", "note_delta", "measure_delta", "density_delta", "note_drift", "churn", "focused",
        "preview_added", "preview_removed", status.alias("status"), highlights.alias("highlights"),
    )
