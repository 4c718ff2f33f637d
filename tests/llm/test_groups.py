"""Near-duplicate groups of documents and vectors against all pairs; the pipeline's stages."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from beatloom.llm import decontaminate, projections, simhash
from beatloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts = [c + (h >> k & 1) for k, c in enumerate(counts)]
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def closure(n, linked):
    """Component number (least member) of each of n things."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    frame = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame, "a", "b").collect()}
    want = closure(1100, [x for x in links if x[0] != x[1]])
    assert got == {n: want[n] for n in {n for x in links if x[0] != x[1] for n in x}}
    assert connected_components(frame.filter("false"), "a", "b").count() == 0


def test_simhash_groups(documents, no_documents):
    rows = documents.collect()
    marks = [plain_fingerprint(r["text"]) for r in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    groups = closure(len(rows), linked)
    least = {}
    for g, r in zip(groups, rows, strict=True):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f"{m:016x}", least.get(g)) for r, m, g in zip(rows, marks, groups, strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.group_documents(documents).collect()), key=str) == want
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(d for d, _, c in want if d is not None and d == c)
    assert simhash.group_documents(no_documents).count() == 0


@pytest.mark.parametrize("block", [1024, 16])
def test_simhash_links_of_a_crowded_cell(spark, monkeypatch, block):
    """Chains and crowds of fingerprints keep every connection, however cells are cut."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(2)
    marks = {0, (1 << 64) - 1}
    for _ in range(6):
        x = int(rng.integers(0, 2**63))
        for _ in range(150):
            x ^= sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(1, 4))))
            marks.add(x)
    center = int(rng.integers(0, 2**63))
    marks |= {center ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    marks = sorted(marks)
    linked = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3]
    want = closure(len(marks), linked)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    place = {m: i for i, m in enumerate(signed)}
    frame = spark.createDataFrame([(m,) for m in signed], "bits long")
    found = [(place[r["a"]], place[r["b"]]) for r in simhash.links(frame).collect()]
    assert all((marks[i] ^ marks[j]).bit_count() <= 3 for i, j in found)
    assert closure(len(marks), found) == want


def test_vector_groups(spark):
    rng = np.random.default_rng(4)
    rows, base = [], rng.standard_normal((40, 16))
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * 0.12
        rows.append([float(x) for x in np.float32(v)])
    rows += [rows[0], rows[0], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf"), *rows[1][1:]], rows[2][:8], [], [x * 3 for x in rows[3]]]
    frame = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, n_links int").repartition(3)
    fine = [i for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(np.float32(rows[i]), float) / np.linalg.norm(np.float32(rows[i]).astype(float)) for i in fine}
    linked = [(i, j) for i in fine for j in fine if i != j and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.95]
    want = closure(len(rows), linked)
    got = {r["vec_id"]: r for r in projections.group_vectors(frame).collect()}
    assert len(got) == len(rows)
    degree = np.bincount([i for i, _ in linked], minlength=len(rows))
    found = sum(r["n_links"] for r in got.values())
    assert found <= degree.sum() and found >= 0.99 * degree.sum() and degree.sum() > 500
    assert all(got[i]["n_links"] <= degree[i] for i in got)
    assert sum(got[i]["component_id"] == want[i] for i in got) >= 0.98 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert projections.group_vectors(frame.filter("false")).count() == 0


def test_calibration_meets_its_recall():
    for n in (100, 10_000, 1_000_000):
        signs, half, lines, least = projections.calibrate(n)
        rng, dim = np.random.default_rng(n), 32
        u = rng.standard_normal((2000, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w = rng.standard_normal((2000, dim))
        w -= (w * u).sum(1, keepdims=True) * u
        v = 0.95 * u + np.sqrt(1 - 0.95**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        draws = rng.standard_normal((dim, lines * (signs + 1)))
        a, b = ((x @ draws).reshape(2000, lines, signs + 1) for x in (u, v))
        meet = (np.abs(a[..., 0] - b[..., 0]) <= half) & ((a[..., 1:] > 0) == (b[..., 1:] > 0)).all(2)
        assert (meet.sum(1) >= least).mean() >= 0.99


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], sf).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == columns for s in steps[:-1])
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in steps]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    rows = steps[1].orderBy("doc_id").collect()
    marks = [plain_fingerprint(r["text"]) for r in rows]
    groups = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 3])
    assert ids[2] == {rows[g]["doc_id"] for g in groups}
    items = [" ".join(decontaminate.words_of(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    verbatim = {r["doc_id"] for r in steps[2].collect() if any(f" {x} " in f" {' '.join(decontaminate.words_of(r['text']))} " for x in items)}
    assert verbatim and not verbatim & ids[3]
    assert steps[4].filter(F.col("text").rlike(r"[a-z0-9]@mail\d")).count() == 0
    assert steps[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
