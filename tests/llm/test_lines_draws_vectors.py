"""Line runs, importance draws and whitened vectors against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import line_runs, prefix_crc, resample, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, at_least, shortest=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in count.items() if n >= at_least and len(k) >= shortest}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lined(spark):
    rng = np.random.default_rng(1)
    common = ["All Rights Reserved", "  all rights reserved\t", "x", "é İ", "", " \t ", "\x0bfoot\x0c", "ſ", "one\r"]
    rows = [(int(i), "\n".join(str(rng.choice(common)) if rng.random() < 0.3 else f"line {rng.integers(400)}" for _ in range(rng.integers(1, 30)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n\n"), (1003, "x\n" * 40_000 + "end"), (1004, "x\nx"), (None, "x\nlost"), (7, "x\nrepeat"), (7, "x\nrepeat")]
    rows += [(2000 + i, "copy of a text\nwith two lines") for i in range(60)]
    return rows, spark.createDataFrame([(i, t, "g", 0) for i, t in rows], "doc_id long, text string, gone string, n_lines int").repartition(5)


@pytest.mark.parametrize("at_least,batches,fanout,share", [(10, 4, 2, 1000), (3, 1, 4, 1000), (10, 5, 2, 3)])
def test_frequent_lines_go(lined, at_least, batches, fanout, share):
    rows, df = lined
    out = line_runs.drop_frequent(df, at_least, batches=batches, fanout=fanout, share=share)
    assert out.columns == ["doc_id", "text", "gone", "n_lines", "n_lines_", "n_dropped"]
    got = sorted(((r.doc_id, r.n_lines_, r.n_dropped, r.text) for r in out.collect()), key=str)
    assert got == plain_lines(rows, at_least)


def test_shortest_key_and_no_documents(lined):
    rows, df = lined
    got = sorted(((r.doc_id, r.n_lines_, r.n_dropped, r.text) for r in line_runs.drop_frequent(df, 10, shortest=5).collect()), key=str)
    assert got == plain_lines(rows, 10, 5)
    assert line_runs.drop_frequent(df.where("false")).collect() == []


def test_runs_are_levelled_sorted_and_reopened(spark):
    store = line_runs.LineRuns(spark, settled=1, fanout=2, buckets=4)
    seen = set()
    for b in range(5):
        docs = spark.createDataFrame([(i, f"common\nline {i}\nline {i + 1}") for i in range(10 * b, 10 * b + 12)], "doc_id long, text string")
        fresh = {(r.h1, r.h2) for r in line_runs.first_lines(store, docs).select("h1", "h2").collect()}
        all_ = {(r.h1, r.h2) for r in line_runs.keyed_lines(docs).select("h1", "h2").collect()}
        assert fresh == all_ - seen
        seen |= all_
        store = line_runs.LineRuns.reopen(spark, store.root)
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert {(r.h1, r.h2) for r in store.frequent(1).collect()} == seen
    batch = spark.createDataFrame([(1, 2)], "h1 long, h2 long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.unsettled(batch)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        store.frequent(2)


def test_line_plan_holds_no_python(lined):
    plan = line_runs.drop_frequent(lined[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_running_crcs():
    rng = np.random.default_rng(0)
    texts = ["Hello, Wörld 12-AB", "", "a", "  ", "x" * 700 + " y " + "é" * 70_000, " ".join(map(str, rng.integers(0, 10**9, 3000))), "ab", "cd"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    words, runs = prefix_crc.ngram_crcs(np.frombuffer(b"".join(raw), np.uint8), bounds)
    got = sorted((int(t), int(c)) for text, crc in runs for t, c in zip(text, crc))
    assert got == sorted((i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in grams(t)[1])
    assert words.tolist() == [len(grams(t)[0]) for t in texts]


def plain_draw(rows, target, percent=5):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = (Counter(bucket(g) for x in texts for g in grams(x)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, x in rows:
        words, features = grams(x)
        weight = sum(gain(bucket(g)) for g in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("percent,part", [(5, 1 << 22), (60, 5000), (100, 1 << 22)])
def test_importance_draw(spark, documents, monkeypatch, percent, part):
    monkeypatch.setattr(resample, "PART", part)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    target = [rows[3][1], rows[9][1][:100], None, ""]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.draw(documents.withColumn("score", F.lit("s")), items, percent=percent)
    assert out.columns == ["doc_id", "text", "source", "lost_id", "score", "n_words", "n_features", "weight", "score_", "rank"]
    got = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score_, r.rank) for r in out.collect()), key=str)
    want = plain_draw(rows, target, percent)
    # rows that repeat a doc_id and text may take either of their ranks
    plain = lambda rows: sorted(((*r[:5], r[5] is not None) for r in rows), key=str)
    assert plain(got) == plain(want)
    assert sorted(r[5] for r in got if r[5]) == sorted(r[5] for r in want if r[5])
    unique = Counter(r[0] for r in want)
    assert [r for r in got if unique[r[0]] == 1] == [r for r in want if unique[r[0]] == 1]


def test_draw_from_nothing(spark, no_documents):
    items = spark.createDataFrame([("a b",)], "text string")
    assert resample.draw(no_documents, items).collect() == []
    few = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.draw(few, items.where("false"), percent=100, least_words=3).select("rank").collect() == [(1,)]


@pytest.mark.parametrize("dim,wanted,kind", [(64, 16, "flat"), (300, 16, "decay"), (300, 5, "ties"), (3, 3, "flat"), (40, 16, "low rank"), (1, 1, "flat"), (6, 6, "zero")])
def test_jacobi_davidson(dim, wanted, kind):
    rng = np.random.default_rng(4)
    values = {"flat": 1 + 0.01 * np.arange(dim), "decay": 0.9 ** np.arange(dim), "ties": 1.0 + (np.arange(dim) < 8), "low rank": np.where(np.arange(dim) < 5, 2.0 + np.arange(dim), 0.0), "zero": np.zeros(dim)}[kind]
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    a = q * values @ q.T
    a = (a + a.T) / 2
    calls = []
    e, u = whitening.jacobi_davidson(lambda b: calls.append(b.shape[1]) or a @ b, dim, wanted)
    assert np.allclose(e, np.sort(values)[::-1][:wanted], rtol=1e-12, atol=1e-13)
    assert np.abs(u.T @ u - np.eye(wanted)).max() < 1e-12
    assert np.abs(a @ u - u * e).max() <= 1e-12 * max(values.max(), 1e-300)
    assert kind == "zero" or len(calls) < 400


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    mix = rng.standard_normal((20, 20)) * 0.8 ** np.arange(20)[:, None]
    x = (rng.standard_normal((500, 20)) @ mix).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500 + i, x[3].tolist()) for i in range(300)]
    bad = [None, [], [1.0] * 19 + [float("nan")], [1.0] * 19 + [float("inf")], [1.0] * 19 + [None], [1.0] * 7, [2.0**41] * 20]
    rows += [(900 + i, b) for i, b in enumerate(bad)] + [(None, x[5].tolist()), (4, x[4].tolist())]
    return rows, spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int").repartition(4)


def test_whitening(vectors):
    rows, df = vectors
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000) for i, v in rows if v and len(v) == 20 and None not in v and np.isfinite(v).all() and max(map(abs, v)) < 1e9]
    fit = np.unique([x for _, x in good], axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * len(good)
    want = {(i, tuple(x)): x for i, x in good}
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = np.sign([by_id[0][k + 1].whitened for k in range(16)]) * np.sign((want[next(k for k in want if k[0] == 0)] - s / n) @ u)
    for (i, _), x in want.items():
        z = (x - s / n) @ u / np.sqrt(e) * signs
        for k in range(16):
            r = by_id[i][k + 1]
            assert abs(r.whitened - z[k]) < 1e-7 and r.deviation == int(((n * x - s) ** 2).sum()) and r.n == n
            assert abs(r.explained / (e[k] / np.trace(centred.T @ centred / n)) - 1) < 1e-10 and r.identity_error < 1e-10


def test_whitening_of_little(spark, vectors):
    df = vectors[1]
    assert whitening.whiten(df.where("false")).collect() == []
    one = whitening.whiten(df.where("vec_id = 3")).collect()
    assert len(one) == 16 and all(r.whitened is None and r.deviation == 0 for r in one)
    far = spark.createDataFrame([(i, [float(i % 2) * 2.0**38, 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten(far).collect()
    assert {r.deviation for r in got} == {None} and {r.component for r in got} == {1, 2}
    assert all(abs(abs(r.whitened) - 1) < 1e-9 for r in got if r.component == 1) and all(r.whitened is None for r in got if r.component == 2)
