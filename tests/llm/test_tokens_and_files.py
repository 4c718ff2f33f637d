"""Token ids, Simple-8b files, packing and WARC bundles: exact round trips and plain recounts."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beatloom.llm import packing, simple8b, token_files, warc
from beatloom.llm.tokens import Encoder
from beatloom.session import work_dir

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b", "a<|endoftext|>b", "x <|endoftext|> y", "a \n b", "é    z", " lead", "trail ", "́ a ́b", "don't it's 's 12", "a\x1cb c\x1c d", "İSTANBUL ΣΑΣ", "<|STARTOFTEXT|> A"]


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_pieces_give_the_ids_of_whole_texts(path, spaced):
    codes, plain = Encoder(path, spaced), Tokenizer.from_file(path)
    for texts in (ODD, ["the cat SAT. on\nthe mat, " * 40]):
        want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, codes.dtype).tolist() for x in codes.encode(texts)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB é\n\t.,'<|1　\x1cĠß")), max_size=30))
def test_pieces_of_any_text(text):
    for path, spaced in ((WORD, False), (BYTE, True)):
        codes = _ENCODERS.setdefault(path, Encoder(path, spaced))
        assert np.frombuffer(codes.encode([text])[0], codes.dtype).tolist() == codes.tokenizer.encode(text, add_special_tokens=False).ids


_ENCODERS = {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 2)), max_size=3000))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint32)
    words, exceptions, table = simple8b.encode(ids)
    assert (simple8b.decode(words, exceptions, table) == ids).all()
    for i in range(len(table)):  # every block by itself
        a, b = int(table["word_at"][i]), int(table["exception_at"][i])
        part = simple8b.decode(words[a : a + table["words"][i]], exceptions[b : b + table["exceptions"][i]], table[i : i + 1])
        assert (part == ids[i * simple8b.BLOCK :][: len(part)]).all()


def _ids(rows, path, end):
    plain = Tokenizer.from_file(path)
    return [np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4") for r in rows]


def test_id_files(spark, documents, no_documents):
    manifest = token_files.write_ids(documents, work_dir(spark, "ids"), WORD, spaced=False, end_id=2)
    got = sorted(token_files.read_ids(manifest).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    rows = documents.collect()
    want = Counter((r["doc_id"], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, _ids(rows, WORD, 2), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert token_files.read_ids(token_files.write_ids(no_documents, work_dir(spark, "ids"), WORD, spaced=False, end_id=2)).count() == 0


@pytest.mark.parametrize("weights", [None, {"s0": 5.0, "s1": 1.0, None: 0.1}])
def test_packing(documents, weights):
    rows = documents.collect()
    got = packing.pack(documents, BYTE, spaced=True, end_id=1, window=256, quantum=32, weights=weights).collect()
    texts = {}
    for r, ids in zip(rows, _ids(rows, BYTE, 1), strict=True):
        texts.setdefault(r["doc_id"], []).append(ids)
    by_doc = {}
    for p in got:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    for key, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == sum(map(len, texts[key]))
        if len(texts[key]) == 1:
            pieces.sort(key=lambda p: p["start"])
            assert b"".join(p["ids"] for p in pieces) == texts[key][0].tobytes()
            assert [p["start"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces[:-1])]).tolist()
    sequences = {}
    for p in got:
        sequences.setdefault(p["sequence_id"], []).append(p)
    sizes = {}
    for s, pieces in sequences.items():
        pieces.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in pieces] == np.cumsum([0, *(p["length"] for p in pieces[:-1])]).tolist()
        sizes[s] = sum(p["length"] for p in pieces)
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes.values())
    if weights is None:  # deficits stay within the quantum (and the last, partial slices)
        source = {r["doc_id"]: r["source"] for r in rows}
        slack = 3 * 32 + sum(p["length"] for p in by_doc[5])  # rows of document 5 come from two sources
        total = Counter()
        for p in got:
            total[source[p["doc_id"]]] += p["length"]
        have, tokens = Counter(), 0
        for s in sorted(sizes)[:-6]:
            for p in sequences[s]:
                have[source[p["doc_id"]]] += p["length"]
            tokens += sizes[s]
            for key, n in total.items():
                assert abs(have[key] - tokens * n / sum(total.values())) <= slack


@pytest.mark.parametrize("weights", [None, {f"h{i}": 1.0 + i % 5 for i in range(0, 400, 2)} | {"h399": 50.0, None: 3.0}])
def test_packing_of_hundreds_of_sources(spark, monkeypatch, weights):
    rng = np.random.default_rng(4)
    lengths = [int(n) for n in rng.integers(1, 250, 1600)]
    rows = [(i, "the cat sat on a mat " * (n // 6 + 1), None if i % 400 == 7 else f"h{i % 400}") for i, n in enumerate(lengths)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    run = lambda **more: packing.pack(docs, BYTE, spaced=True, end_id=1, window=256, quantum=32, weights=weights, **more)
    got = run().collect()
    source, total, tokens = {i: key for i, _, key in rows}, Counter(), Counter()
    pieces = {}
    for p in got:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        total[source[p["doc_id"]]] += p["length"]
        tokens[p["doc_id"]] += p["length"]
        pieces.setdefault(p["sequence_id"], []).append(p)
    assert all(tokens[p["doc_id"]] == p["doc_tokens"] for p in got)
    if weights is None:
        have, seen = Counter(), 0
        for s in sorted(pieces):
            for p in pieces[s]:
                have[source[p["doc_id"]]] += p["length"]
                seen += p["length"]
            if seen <= sum(n // 32 * 32 for n in total.values()):
                for key, n in total.items():  # within a quantum, and the part of the tails not yet served
                    assert abs(have[key] - seen * (n // 32 * 32) / sum(m // 32 * 32 for m in total.values())) <= 32
    else:
        early = Counter(source[p["doc_id"]] for p in got if p["sequence_id"] < 20 for _ in range(p["length"]))
        whole = sum(weights.get(key, 1.0) for key in total)
        assert all(early[key] >= 20 * 256 * weights.get(key, 1.0) / whole - 32 for key in total)
    monkeypatch.setattr(packing, "QUEUES", 1000)  # the schedule in closed form is the same
    assert {tuple(p) for p in run().collect()} == {tuple(p) for p in got}


def test_packing_of_nothing(no_documents):
    assert packing.pack(no_documents, BYTE, spaced=True, end_id=1).count() == 0


def test_schedule_matches_a_simulation():
    plan = packing.Schedule([1000, 333, 70, 0, 5], None, window=64, quantum=16)
    due = sorted((plan.due(q, np.array([j]))[0], q, j) for q in range(5) for j in range(int(plan.sizes[q])))
    for rank, (_, q, j) in enumerate(due):
        assert plan.rank(np.array([q]), np.array([j]))[0] == rank


def test_warc(spark):
    body = "<p>é" + "x" * 200
    rows = [(3, "http://a/\r\nx", body), (1, None, body), (2, "http://b", body), (2, "http://b", body), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", body), (8, "u", "y" * 300_000), (9, "u", "𝔸" * 5000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    index = warc.write_bundles(warc.mark_revisits(pages), work_dir(spark, "warc"), frame_bytes=4096)
    records = warc.read_bundles(index)
    got = Counter(tuple(r) for r in records.select("page_id", *warc.payload_columns(), "record_type", "refers_to").collect())
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == body and page != 1
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None] += 1
    assert got == want
    one = warc.read_records(index, spark.createDataFrame([(8,), (9,)], "page_id long")).collect()
    assert {(r["page_id"], bytes(r["payload"])) for r in one} == {(8, b"y" * 300_000), (9, ("𝔸" * 5000).encode())}
    assert index.groupBy("bundle").max("frame").agg({"max(frame)": "max"}).first()[0] > 0
    assert warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages.filter("false")), work_dir(spark, "warc"))).count() == 0


def test_bundles_are_plain_zstandard(spark, tmp_path):
    import zstandard

    writer = warc.BundleWriter(str(tmp_path), 1000, 3)
    records = [warc._record({"record_type": "response", "page_id": i, "url": "u", "payload": b"z" * 400, "payload_digest": hashlib.sha256(b"z" * 400).hexdigest(), "payload_bytes": 400, "refers_to": None}, "d") for i in range(5)]
    places = [writer.add(r) for r in records]
    writer.close()
    raw = (tmp_path / writer.name).read_bytes()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(records)
    reader = warc.BundleReader(str(tmp_path / writer.name))
    for i, (frame, at) in enumerate(places):
        assert warc.parse_record(reader.frame(frame), at)[0]["page_id"] == i
