"""Line deduplication against levelled sorted runs of line hashes, in column expressions only.

A run is a table of line hashes with the number of documents that hold each, bucketed and sorted by hash.
A new batch is counted, merge-anti-joined with every run to leave out what is settled already, and written
as a run of level 0; a full level is merged into one run of the next. So a line is rewritten once per
level, and a batch costs one shuffle of its own hashes: the runs keep their buckets and are never shuffled.
"""

from __future__ import annotations

import json
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.staging import filesystem, stage, unused
from beatloom.session import work_dir

LINE_SPACE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
RUN_SCHEMA = "h1 long, h2 long, n long"


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def row_key(doc_id: str, text: str) -> list[Column]:
    """128 bits that rows share only if they agree in doc_id and text, and so in the result."""
    return [F.xxhash64(F.col(doc_id), F.col(text)), F.xxhash64(F.lit(1), F.col(text))]


def keyed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 1) -> DataFrame:
    """Rows (r1, r2, n_lines, h1, h2, i, first) of every line whose key has ``shortest`` code points or more.

    ``i`` is the line's position, ``first`` marks the first line of its key in the document; h1 and h2 are
    two hashes of the key with different seeds.
    """
    r1, r2 = row_key(doc_id, text)
    key = lambda x: F.btrim(x, F.lit(LINE_SPACE))
    one = lambda x, i: F.struct(F.xxhash64(key(x)).alias("h1"), F.xxhash64(F.lit(1), key(x)).alias("h2"), i.alias("i"), (F.length(key(x)) >= shortest).alias("k"))
    lines = F.split(lowered(F.coalesce(F.col(text), F.lit(""))), "\n", -1)
    d = docs.select(r1.alias("r1"), r2.alias("r2"), F.transform(lines, one).alias("all"))
    d = d.select("r1", "r2", F.size("all").alias("n_lines"), F.sort_array(F.filter("all", lambda x: x["k"])).alias("s"))
    # lines of one key are neighbours now: each is held against the one before it
    before = F.concat(F.array(F.lit(None).cast(d.schema["s"].dataType.elementType)), F.col("s"))
    again = lambda a, b: a["h1"].eqNullSafe(b["h1"]) & a["h2"].eqNullSafe(b["h2"])
    marked = F.zip_with("s", before, lambda a, b: F.struct(a["h1"].alias("h1"), a["h2"].alias("h2"), a["i"].alias("i"), (~again(a, b)).alias("first")))
    d = d.select("r1", "r2", "n_lines", F.explode(F.slice(marked, F.lit(1), F.size("s"))).alias("x"))
    return d.select("r1", "r2", "n_lines", "x.*")


class LineRuns:
    """Levelled sorted runs of line hashes below a folder that all executors share.

    ``fanout`` runs of a level are merged into one of the next. A hash is settled once a run counts it
    ``settled`` times or more; later batches leave it out. ``settled=1`` keeps a set of lines seen, a larger
    number counts documents up to it. The number of buckets is fixed for the life of the store.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, settled: int = 1, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.root = spark, root or work_dir(spark, "line-runs")
        self.settled, self.fanout = settled, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    @classmethod
    def reopen(cls, spark: SparkSession, root: str) -> LineRuns:
        """A store as its last finished batch left it, in a new session."""
        fs, path = filesystem(root)
        with fs.open_input_stream(f"{path}/manifest.json") as f:
            known = json.loads(f.read())
        store = cls(spark, root, known["settled"], known["fanout"], known["buckets"])
        store.levels = known["levels"]
        for run in store.runs():
            spark.sql(f"create table if not exists {run} ({RUN_SCHEMA}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {store.buckets} buckets location '{root}/{run}'")
        return store

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """Rows of a table with h1 and h2 whose hash no run has settled: a merge anti-join with each run."""
        for run in self.runs():
            counts = counts.join(self.spark.table(run).where(F.col("n") >= self.settled).select(*HASH), HASH, "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """Add a batch, rows (h1, h2, n) with each hash once, as a run of its own; then compact full levels."""
        run = self._write(self.unsettled(counts).select(*HASH, F.col("n").cast("long").alias("n")))
        levels, level = [list(x) for x in self.levels] or [[]], 0
        levels[0].append(run)
        while level < len(levels) and len(levels[level]) >= self.fanout:
            merged = self._write(self._total(levels[level]))
            levels[level] = []
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(merged)
            level += 1
        self.levels = levels
        self._commit()

    def frequent(self, at_least: int) -> DataFrame:
        """Hashes counted ``at_least`` times or more over all runs; not more than the settling number."""
        if at_least > self.settled:
            raise ValueError(f"hashes are counted up to {self.settled} only")
        if not self.runs():
            return self.spark.createDataFrame([], RUN_SCHEMA).select(*HASH)
        total = self.spark.table(self.runs()[0]) if len(self.runs()) == 1 else self._total(self.runs())
        return total.where(F.col("n") >= at_least).select(*HASH)

    def _total(self, runs: list[str]) -> DataFrame:
        """Runs merged in hash order, counts added up: full outer joins keep the buckets, nothing is shuffled."""
        rows = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).withColumnRenamed("n", "more")
            rows = rows.join(other, HASH, "full_outer").select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return rows

    def _write(self, rows: DataFrame) -> str:
        run = f"line_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.buckets, *HASH)
        rows.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.root}/{run}").saveAsTable(run)
        return run

    def _commit(self) -> None:
        """Name the live runs in one file, put in place by a rename: a killed batch leaves the store as it was."""
        fs, path = filesystem(self.root)
        state = {"settled": self.settled, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels}
        with fs.open_output_stream(f"{path}/manifest.tmp") as f:
            f.write(json.dumps(state).encode())
        fs.move(f"{path}/manifest.tmp", f"{path}/manifest.json")


def first_lines(runs: LineRuns, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 1) -> DataFrame:
    """Hashes of a batch that no earlier batch held; the batch is added to the runs."""
    counts = keyed_lines(docs, doc_id, text, shortest).where("first").groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"))
    fresh = stage(runs.unsettled(counts), "line-batch")
    runs.add(fresh)
    return fresh


def drop_frequent(docs: DataFrame, at_least: int = 10, shortest: int = 1, doc_id: str = "doc_id", text: str = "text", batches: int = 4, fanout: int = 2, share: int = 1000) -> DataFrame:
    """All rows and columns, the text without the lines whose key occurs in ``at_least`` rows or more.

    A key is the line without white space at both ends and with A-Z lower-cased; every row counts as a
    document, rows repeated with their doc_id too. Columns n_lines (before) and n_dropped are added, with
    underscores if their names are taken. Null and empty texts have one empty line, and keys shorter than
    ``shortest`` code points stay; a text that loses all lines becomes empty. Rows are dealt into
    ``batches`` that go through the runs one after the other.

    Hot lines: counting combines before its shuffle. A line that makes 1/``share`` or more of a batch's
    lines is met by a broadcast of at most ``share`` hashes a batch, all others by a shuffle.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "lines")
    keyed_lines(docs, doc_id, text, shortest).withColumn("batch", F.pmod("r1", F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("r1 long, r2 long, n_lines int, h1 long, h2 long, i int, first boolean, batch int").parquet(path)
    runs = LineRuns(spark, settled=at_least, fanout=fanout)
    totals = {r.batch: r.n for r in lines.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = spark.createDataFrame([], "h1 long, h2 long")
    for batch in sorted(totals):
        own = lines.where((F.col("batch") == batch) & F.col("first"))
        counts = stage(own.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n")), "line-counts")
        hot = hot.unionByName(counts.where(F.col("n") * share >= totals[batch]).select(*HASH))
        runs.add(counts)
    frequent = runs.frequent(at_least)
    hot = hot.distinct()  # at most share x batches rows
    spots = lines.select("r1", "r2", "n_lines", *HASH, "i")
    hits = spots.join(F.broadcast(frequent.join(F.broadcast(hot), HASH)), HASH).unionByName(
        spots.join(F.broadcast(hot), HASH, "left_anti").join(frequent.join(F.broadcast(hot), HASH, "left_anti"), HASH)
    )
    hit = hits.groupBy("r1", "r2").agg(F.collect_set("i").alias("p"), F.max("n_lines").alias("n"))
    flag = lambda at, gone: F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(gone).alias("gone")))
    rest = F.array_except(F.sequence(F.lit(0), F.col("n") - 1), F.col("p"))
    a, b, gone, n_gone = (unused(docs, name) for name in ("r1", "r2", "gone", "n_gone"))
    mask = F.transform(F.sort_array(F.concat(flag(F.col("p"), True), flag(rest, False))), lambda x: x["gone"])
    hit = hit.select(F.col("r1").alias(a), F.col("r2").alias(b), mask.alias(gone), F.size("p").cast("long").alias(n_gone))
    r1, r2 = row_key(doc_id, text)
    out = docs.withColumns({a: r1, b: r2}).join(hit, [a, b], "left")
    kept = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False)))
    n_lines, n_dropped = unused(docs, "n_lines"), unused(docs, "n_dropped")
    breaks = F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit("")))
    columns = [F.array_join(kept, "\n").alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*columns, (breaks + 1).cast("long").alias(n_lines), F.coalesce(n_gone, F.lit(0)).cast("long").alias(n_dropped))


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents share."""
    out = drop_frequent(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = """
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from s),
k as (select doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select k.doc_id, count(*) as n_lines, count(f.key) as n_dropped,
 sha256(coalesce(string_agg(case when f.key is null then k.line end, chr(10) order by k.pos), '')) as kept_sha256
from k left join f on k.key = f.key group by k.doc_id
"""
