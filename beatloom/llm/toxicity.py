"""Toxicity of documents: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of two lexicons (a hand-written one, and words and word beginnings mined from
labelled documents), nearness of their hits to the second person, and rates of capitals, punctuation and
obfuscation. Labels are joined as a bounded sample, so texts are never shuffled: one pass over the sampled
documents mines the lexicon, one computes their features, and scoring is one pass over all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from beatloom.llm.staging import stage, unused
from beatloom.llm.tokens import slices

SAMPLE = 200_000  # labelled documents that are learnt from, at most; those with the least hash
LEXICON = 4_000  # mined entries of each kind, at most
THRESHOLD = 0.7

HAND = frozenset(
    """idiot idiots moron morons stupid dumb trash garbage pathetic loser losers worthless disgusting scum clown clowns
    fool fools jerk jerks creep creeps freak freaks vermin filth filthy ugly useless retard imbecile cretin bastard
    bastards bitch asshole fuck fucking shit crap damn hate kill die suck sucks liar liars coward cowards pig pigs rat
    idioten dumm dummkopf arschloch abschaum versager widerlich dreck schwachkopf trottel lügner feigling
    idiote imbécile stupide connard salaud ordure minable dégoûtant nul crétin menteur lâche
    idiota estúpido estúpida imbécil basura asqueroso patético inútil perdedor mentiroso cobarde tonto cabrón""".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
NEAR = 5  # words between a hit and the second person

WORD = re.compile(r"\w+")
OBFUSCATED = re.compile(r"(?<!\w)[^\W\d_]+(?:[@$*!|+0134578]+[^\W\d_]+)+(?!\w)")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
LEET = str.maketrans("@$0134578!|+*", "asoleastbiit ", "")
NOT_CAPITAL = bytes(i for i in range(256) if not chr(i).isupper())
NOT_LETTER = bytes(i for i in range(256) if not chr(i).isalpha())
PREFIX = 4

FEATURES = [
    "words", "hand_density", "hand_hits", "mined_density", "mined_distinct", "mined_weight", "prefix_density", "prefix_distinct", "prefix_weight",
    "near_second", "second_density", "capitals", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_hits", "stretched",
]


def features(text: str, words_of: dict[str, float], beginnings: dict[str, float]) -> list[float]:
    """Dense features of a whole text; all zero for an empty one."""
    low = text.lower()
    words = WORD.findall(low)
    n = max(len(words), 1)
    hits = [i for i, w in enumerate(words) if w in HAND or w in words_of]
    hand = sum(words[i] in HAND for i in hits)
    mined = {words[i]: words_of[words[i]] for i in hits if words[i] in words_of}
    begin = [(w, x) for w, x in ((w[:PREFIX], beginnings.get(w[:PREFIX])) for w in words) if x]
    persons = [i for i, w in enumerate(words) if w in SECOND]
    near, k = 0, 0
    for i in hits:
        while k < len(persons) and persons[k] < i - NEAR:
            k += 1
        near += k < len(persons) and persons[k] <= i + NEAR
    raw = text.encode("latin-1", "replace")
    letters = max(len(raw.translate(None, NOT_LETTER)), 1)
    odd = OBFUSCATED.findall(low)
    plain = [w.translate(LEET).replace(" ", "") for w in odd]
    chars = max(len(text), 1)
    return [
        math.log1p(len(words)), hand / n, math.log1p(hand),
        len([i for i in hits if words[i] in mined]) / n, float(len(mined)), max(mined.values(), default=0.0),
        len(begin) / n, float(len({w for w, _ in begin})), max((x for _, x in begin), default=0.0),
        near / n, len(persons) / n, len(raw.translate(None, NOT_CAPITAL)) / letters,
        text.count("!") / chars, text.count("?") / chars, sum(text.count(c) for c in ".,;:-'\"()#&%*|") / chars,
        len(odd) / n, float(sum(w in HAND or w in words_of for w in plain)), len(STRETCHED.findall(low)) / n,
    ]


@dataclass
class Model:
    """Lexicons, trees and calibration; trees and calibration are None if the labels hold one class only."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_labels(labels: DataFrame, most: int = SAMPLE, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """At most ``most`` training labels, one per document; repeated ones count as toxic if one of them is."""
    rows = labels.select(F.col(doc_id).cast("long").alias("label_id"), F.col(label).cast("int").alias("toxic"))
    rows = rows.filter("label_id is not null and toxic in (0, 1)").filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    return stage(rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most), "toxicity-labels")


def mine(labelled: DataFrame, kind: Column, at_least: int, totals: tuple[int, int]) -> dict[str, float]:
    """Words of ``kind`` (an array column) that tell toxic documents from others, with their log-odds.

    Counts are of documents. A word needs ``at_least`` toxic documents, a log-odds ratio of 1.5 and four
    standard errors; of those, the LEXICON surest are taken.
    """
    clean, toxic = totals
    counts = labelled.select("toxic", F.explode(F.array_distinct(kind)).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = counts.filter(F.col("t") >= at_least)
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (clean - F.col("c") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    sure = counts.select("word", odds.alias("odds"), (odds / error).alias("z")).filter("odds >= 1.5 and z >= 4")
    return {r["word"]: r["odds"] for r in sure.orderBy(F.desc("z"), "word").limit(LEXICON).collect()}


def add_features(docs: DataFrame, model: Model, text: str = "text", name: str = "toxic_features") -> DataFrame:
    """The rows with an array of features."""
    words, beginnings = model.words, model.beginnings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, batch.schema.names.index(text)):
                rows = pa.array([features(t, words, beginnings) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, rows], names=[*part.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, rounds: int = 30, depth: int = 3, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the labelled documents outside the held-out third.

    Without labelled documents of both classes there is nothing to learn: the score is then that of the
    hand lexicon.
    """
    sample = sample_labels(labels, most, doc_id, label)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    labelled = rows.join(F.broadcast(sample), rows["doc_id"] == sample["label_id"]).select("doc_id", "text", "toxic")
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = Model()
    if not 0 < toxic < n:
        return model
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    at_least = max(5, round(0.02 * toxic))
    model.words = mine(labelled, words, at_least, (n - toxic, toxic))
    model.beginnings = mine(labelled, F.transform(F.filter(words, lambda w: F.length(w) > PREFIX), lambda w: w.substr(1, PREFIX)), at_least, (n - toxic, toxic))
    seen = stage(add_features(labelled, model).drop("text"), "toxicity-features").coalesce(8)
    seen = seen.select("doc_id", F.col("toxic").cast("double").alias("label"), array_to_vector("toxic_features").alias("features"))
    own = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(10))
    classes = {(r["own"], r["label"]) for r in seen.select((own < 7).alias("own"), "label").distinct().collect()}
    if len({label for _, label in classes}) < 2:
        return Model()
    # Few labels may leave one part without a class; trees and calibration then share all of them.
    apart = len(classes) == 4
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, seed=7, minInstancesPerNode=4 if apart else 1, featureSubsetStrategy="all")
    model.trees = trees.fit(seen.filter(own < 7) if apart else seen)
    told = model.trees.transform(seen.filter(own >= 7) if apart else seen)
    model.calibration = IsotonicRegression(featuresCol="probability", featureIndex=1, labelCol="label", predictionCol="score").fit(told.select("label", "probability"))
    return model


def _scored(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """The rows with their columns as c0, c1, ... (so that no name can clash) and a column score."""
    rows = add_features(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), model, f"c{docs.columns.index(text)}")
    if model.trees is None:
        return rows.withColumn("score", 1 - F.exp(-F.element_at("toxic_features", FEATURES.index("hand_hits") + 1)))
    rows = rows.withColumn("toxic_vector", array_to_vector("toxic_features"))
    trees = model.trees.setFeaturesCol("toxic_vector").setPredictionCol("toxic_class").setRawPredictionCol("toxic_raw").setProbabilityCol("toxic_probability")
    calibration = model.calibration.setFeaturesCol("toxic_probability").setPredictionCol("calibrated")
    return calibration.transform(trees.transform(rows)).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "calibrated")))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxic_score") -> DataFrame:
    """The rows with a score from 0 to 1, in a column that gets underscores if the name is taken. Null texts
    are scored as empty ones; one pass, no shuffle."""
    return _scored(docs, model, text).select(*_own(docs), F.col("score").alias(unused(docs, name)))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **names: str) -> DataFrame:
    """The rows that score below the threshold, with their own columns."""
    scored = _scored(docs, fit(docs, labels, **names), names.get("text", "text"))
    return scored.filter(F.col("score") < threshold).select(*_own(docs))


def op3_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = score(docs, model, name="score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
