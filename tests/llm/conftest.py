import zlib

import numpy as np
import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, empty and long texts, ties, repeats and a column whose name clashes."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary, n))
    texts = [sentence(int(rng.integers(5, 80))) for _ in range(60)]
    texts += [None, "", "   \n\t", texts[0], texts[0], texts[1] + " tail", "é 𝔸 ﬁ İ ſ", "one", "two words", sentence(30_000), "x" * 20_000, "a b c d e f g " * 900]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "x") for i, t in enumerate(texts)]
    rows += [(None, texts[2], "s0", "x"), (5, texts[5], "s1", "x"), (5, texts[5], "s1", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lost_id string").repartition(3)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.filter("false")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
