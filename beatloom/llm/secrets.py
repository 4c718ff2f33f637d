"""Secrets in texts, in column expressions only.

Base patterns come first. Then long tokens are scored by two character Markov models, of random strings and
of ordinary identifiers: a token is a secret if its log-likelihood ratio is high enough. Both models are
trained from labelled samples: random strings are made from hashes in the usual alphabets, identifiers from
the words of a bounded sample of documents in the usual spellings. A model has one number for each pair of
characters, so its size is fixed by the alphabet.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.native import none, spans

# The base patterns by kind, in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Whole runs of token characters that hold a letter and a digit.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
SAMPLE_DOCUMENTS = 4_000  # whose words are the ordinary sample, those with the least hash
RANDOM_STRINGS = 5_000  # of each alphabet
LEAST_MEAN, LEAST_TOTAL = 0.35, 10.0  # log-likelihood ratio by character pair and of a token
ROW = "start:bigint,end:bigint,kind:int,value:string"


def random_sample(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Random strings (column word): base 64, hexadecimal and upper-case base 32-like."""
    digest = F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")).cast("binary"), 256)
    forms = [F.base64(F.unhex(digest)), digest, F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")), F.regexp_replace(F.base64(F.unhex(digest)), r"\+", "-")]
    return spark.range(n).select(F.explode(F.array(*forms)).alias("word"))


def ordinary_sample(docs: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Words of a bounded sample of documents, as they stand, in capitals, and joined in pairs."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.join(F.broadcast(ids), "doc_id")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,24}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    pairs = F.zip_with(F.col("w"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    word = sample.select(words.alias("w")).select(F.explode(pairs).alias("p")).filter("p.b is not null").select("p.a", "p.b")
    low = F.lower("a")
    number = F.pmod(F.xxhash64("a", "b"), F.lit(10_000))
    dated = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), number.cast("int")), "yyyy-MM-dd'T'00-mm-ss'Z'")
    forms = [F.upper(F.concat_ws("_", "a", "b")), F.concat_ws("_", F.upper("a"), number), F.concat_ws("-", low, dated, low), F.col("a"), F.upper("a"), F.concat_ws("_", low, F.lower("b")), F.concat(low, F.initcap("b")), F.concat_ws("-", low, F.lower("b")), F.concat(low, F.lit("2"))]
    return word.select(F.explode(F.array(*forms)).alias("word"))


def pair_counts(sample: DataFrame) -> dict[str, int]:
    """Counts of character pairs; at most the square of the alphabet."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    rows = sample.filter(F.length("word") > 1).groupBy("word").count().select(F.explode(pairs).alias("pair"), "count")
    rows = rows.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("pair").agg(F.sum("count").alias("n"))
    return {r["pair"]: r["n"] for r in rows.collect()}


def train(docs: DataFrame, smoothing: float = 0.002) -> list[float]:
    """Log-likelihood ratios of the second character of a pair given the first, by place in the alphabet.

    ``smoothing`` is the weight of the uniform distribution in both models.
    """
    tables, size = [], len(ALPHABET)
    for sample in (random_sample(docs.sparkSession), ordinary_sample(docs)):
        counts = pair_counts(sample)
        rows = []
        for a in ALPHABET:
            total = sum(counts.get(a + b, 0) for b in ALPHABET)
            rows += [(1 - smoothing) * counts.get(a + b, 0) / total + smoothing / size if total else 1 / size for b in ALPHABET]
        tables.append(rows)
    return [round(math.log(r / o), 4) for r, o in zip(*tables, strict=True)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, and null for one of less than two characters."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda total, i: total + F.get(table, place(i) * len(ALPHABET) + place(i + 1)))


def _told(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _sorted(found: Column) -> Column:
    return F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    ``found`` lists start, kind number, end and value of all spans by start, then kind. Null texts are empty;
    null and repeated doc_ids are kept; an empty table gives no rows. One pass, no shuffle, apart from the
    training samples.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    model = model or train(rows)
    column = F.col("text")

    def matches(kind: int, pattern: str, gate: Column, keep: Callable | None = None) -> Column:
        found = spans(column, F.lit(pattern), lambda m: {"kind": F.lit(kind), "value": m}, "kind int, value string", keep)
        return F.when(gate, found).otherwise(none(ROW))

    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    secret = lambda m: (ratio(m, model) >= LEAST_TOTAL) & (ratio(m, model) >= LEAST_MEAN * (F.length(m) - 1)) & (F.size(F.array_distinct(F.split(m, ""))) >= 8)
    rows = rows.withColumns({
        "assign": matches(0, ASSIGN, column.rlike(ASSIGN), value),
        "access": matches(1, ACCESS, column.contains("AKIA"), lambda m: F.length(m) >= 16),
        "hex": matches(2, HEX, column.rlike(HEX)),
        "token": matches(3, TOKEN, column.rlike(TOKEN), secret),
    })
    rows = rows.withColumn("base", _sorted(F.concat("assign", "access", "hex")))
    added = F.filter("token", lambda t: ~F.exists("base", lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"])))
    rows = rows.withColumn("found", F.when(F.size("token") > 0, _sorted(F.concat("assign", "access", "hex", added))).otherwise(F.col("base")))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return rows.select("doc_id", *counts, F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"), "found")


def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")
