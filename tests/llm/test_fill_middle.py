"""Fill-in-the-middle against a plain version, and its rank index against the offsets themselves."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolens.llm import fill_middle
from tests.llm.test_operators import docs_of, empty, odd, rows_of, same  # noqa: F401


def plain(i, text):
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(tokens)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark, odd, empty):  # noqa: F811
    marked = odd.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(90, "a <S> b"), (91, "<P"), (92, "<M>"), (93, "x<" * 40), (94, "<P<S<M" * 30)], "doc_id long, text string"))
    for df in (*docs_of(spark, odd).values(), marked):
        got = fill_middle.transform(df).withColumn("back", fill_middle.restored(F.col("form"), F.col("output"))).collect()
        same([r[:-1] for r in got], [plain(i, t or "") for i, t in rows_of(df)])
        same([(r.doc_id, r.back) for r in got], [(i, t or "") for i, t in rows_of(df)])
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    clashing = odd.withColumnsRenamed({"id": "_id", "n": "output"})
    assert fill_middle.transform(clashing).count() == odd.count()
    assert fill_middle.transform(empty).count() == 0


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_rank_index(monkeypatch, block):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    rng = random.Random(block)
    texts = ["", "a", "日本語😀", "ab cd", "x" * 5000, " " * 3000,
             "".join(rng.choice(["w" * rng.randint(1, 400), " ", "é", "??"]) for _ in range(4000)),
             "a b " * 2000 + "long" * 500 + " . " * 2000]
    for text in texts:
        expected = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
        index = fill_middle.index_of(text)
        assert index.n == len(expected) and [index.offset(r) for r in range(index.n)] == expected
        assert all(np.abs(r.astype(int)).max() <= fill_middle.ERROR + 1 for r in index.residuals)
    if block > 1000:
        assert len(fill_middle.index_of(texts[-1]).ranks) <= 8  # three slopes
