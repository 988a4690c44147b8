"""Every operator against a brute-force version, on odd rows and on the smallest given tables."""

import base64
import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from echolens.llm import (bpe, chat, decontaminate, line_dedup, ngram_join, quality_rules, sharding, suffix_dedup,
                          token_counts, warc)
from echolens.llm.components import components
from echolens.llm.queries import QUERIES, tokenizer_file
from echolens.llm.tables import read
from echolens.llm.words import Texts
from tests.conftest import FOLDER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_texts():
    rng = random.Random(4)
    words = ["the", "The", "é", "naïve", "日本", "a b", "x" * 70, "$$", "it's", "1234", "", " ", "\n", "<|endoftext|>", "▁", "😀"]
    texts = [None, "", " ", "\n", "\n\n", "one", "one two", "a" * 3000, " " * 700, "日本語" * 500, "<s> <unk> <0x0A>",
             "\x1c\x85　", "<|endoftext|><|endoftext|>x"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    base = " ".join(f"word{rng.randint(0, 40)}" for _ in range(120))
    texts += [base, base, base.upper(), base + " tail", "head " + base] + [base.replace("word7", "other")] * 3
    texts += ["line one is here\nline two is here\nline three is here\n" + t for t in ("a b", "c d", "e f")]
    return texts


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    rows += [(None, "null id " * 20), (3, "again"), (5, "one"), (5, "one")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, n long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def docs_of(spark, odd):
    return {"odd": odd, "given": read(spark, FOLDER, "documents")}


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, expected):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


def test_bpe(spark, odd, empty):
    from tokenizers import Tokenizer
    file = tokenizer_file("byte_bpe_50k.json")
    known = Tokenizer.from_file(file)
    for df in docs_of(spark, odd).values():
        expected = []
        for i, t in rows_of(df):
            ids = known.encode(t or "", add_special_tokens=False).ids
            back = known.decode(ids, skip_special_tokens=False)
            expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(back.encode()).hexdigest()))
        same(bpe.round_trip(df, file).collect(), expected)
    again = bpe.decode(bpe.encode(odd, file), file)
    same(again.collect(), [(i, t or "") for i, t in rows_of(odd)])
    assert bpe.round_trip(empty, file).count() == 0


def test_bpe_contractions_at_the_end_of_a_block():
    from tokenizers import Tokenizer
    file = tokenizer_file("byte_bpe_50k.json")
    known, coder = Tokenizer.from_file(file), bpe.coder(file)
    for mark in ("they're we've he'll", "we've '' 'r", "he'll!!'re  'll", "'ve   x'll"):
        for back in range(len(mark) + 2):
            text = "word " * (bpe.BLOCK // 5) + "x" * (bpe.BLOCK % 5)
            text = text[:bpe.BLOCK - back] + mark + " and more" * 3
            got = [i for ids in coder.encode(text) for i in ids]
            assert got == known.encode(text, add_special_tokens=False).ids, (mark, back)


def test_bpe_stream_is_bounded_and_stable():
    coder = bpe.coder(tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(1)
    for text in ("a" * 5000, "=-" * 2000, "".join(rng.choice("etaoin") for _ in range(4000))):
        data = text.encode()
        streamed = [i for ids in coder.transduce(data[k:k + 17] for k in range(0, len(data), 17)) for i in ids]
        assert streamed == coder.merge(data)
    pieces = [[coder.of_byte[x] for x in part] for part in (b"\xe6", b"\x97\xa5", b"\xff")]
    assert "".join(coder.decode(pieces)) == "日\ufffd"


def test_token_counts(spark, odd, empty):
    import sentencepiece
    file = tokenizer_file("piece_bpe_32k.model")
    known = sentencepiece.SentencePieceProcessor(model_file=file)
    for df in docs_of(spark, odd).values():
        expected = []
        for i, t in rows_of(df):
            n = len(known.encode(t or ""))
            expected.append((i, len((t or "").encode()), n, n > 4096))
        same(token_counts.count_tokens(df, file).collect(), expected)
    assert token_counts.count_tokens(empty, file).count() == 0


def test_sharding(spark, odd, empty):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "hot text").otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    for df in (*docs_of(spark, odd).values(), hot):
        got = sharding.shards(df, 24).collect()
        import zlib
        same([(r.doc_id, r.size, r.text_crc32) for r in got],
             [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows_of(df)])
        total, largest, sums = sum(r.size for r in got), max(r.size for r in got), [0] * 24
        for r in got:
            sums[r.shard] += r.size
        assert max(abs(s - total / 24) for s in sums) <= largest
        for k in range(24):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert sharding.shards(empty, 24).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame(
        [(None, None, None), (1, "http://A.b.c/x y\r\nz", ""), (2, "http://a.b.c", "dup"), (3, "weird://[bad", "dup"),
         (3, "weird://[bad", "dup"), (4, None, "dup"), (5, "", "日本\r\n\r\nWARC/1.1"), (6, "http://a.b.c/é?q#f", "\0x")],
        "page_id long, url string, html string")
    pages = pages.unionByName(read(spark, FOLDER, "pages").select(F.col("page_id") + 100, "url", "html").toDF(*pages.columns))
    rows = pages.collect()
    best = {}
    for r in rows:
        if r.page_id is not None:
            best[r.html or ""] = max(best.get(r.html or "", r.page_id), r.page_id)
    expected = []
    for r in rows:
        payload = (r.html or "").encode()
        first = best.get(r.html or "") == r.page_id
        expected.append((r.page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                         "response" if first else "revisit", None if first else best[r.html or ""]))
    same(warc.archive_and_read(pages).drop("payload").collect(), expected)
    assert warc.archive_and_read(pages.where("false")).count() == 0
    assert warc.surt("http://www.Ex.org/a?b") == "org,ex,www)/a?b"


def test_lookup_with_small_blocks_and_slices(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "SLICE", 4)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/p", f"text {i}") for i in range(60)],
                                  "page_id long, url string, html string")
    folder = str(tmp_path / "archives")
    warc.write_archives(pages, folder)
    blocks = warc.build_index(spark, folder)
    wanted = spark.createDataFrame([("http://h3.org/p",), ("http://h9.org/p",), ("http://h0.org/p",)], "url string")
    found = warc.read_records(spark, warc.lookup(blocks, wanted)).collect()
    assert sorted(r.page_id for r in found) == [i for i in range(60) if i % 7 in (0, 3)]


def brute_classes(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return [(i, len(sets[k]), least.get(top(k))) for k, (i, _) in enumerate(rows)]


def test_ngram_join(spark, odd, empty):
    for df in docs_of(spark, odd).values():
        for n, num, den in ((3, 90, 100), (5, 8, 10)):
            same(ngram_join.classes(df, n, num, den).collect(), brute_classes(rows_of(df), n, num, den))
    assert ngram_join.classes(empty).count() == 0


def test_ngram_join_when_all_shingles_are_frequent(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", -1)
    monkeypatch.setattr(ngram_join, "LARGE", 4)
    monkeypatch.setattr(ngram_join.math, "sqrt", lambda x: -(x + 5) / 5)
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 300)}" for _ in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 50)}"
        rows.append((i, " ".join(words[:rng.choice((150, 150, 140, 80, 20))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(ngram_join.classes(df, 3, 90, 100).collect(), brute_classes(rows, 3, 90, 100))


def test_sketch_counters_that_run_over(spark):
    docs = spark.range(0, 70_000, 1, 1).select("id", F.lit("one two three").cast("binary").alias("text"))
    rows = ngram_join._measure(docs, 3).where("slice is not null").collect()
    assert sum(int(ngram_join.unpack(bytes(r.counts)).sum()) for r in rows) == 70_000 and len(rows) > 1


def test_components(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in components(chain).collect()} == {0}
    assert components(chain.where("false")).count() == 0


def test_decontaminate(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, " ".join(f"word{k}" for k in range(9))),
                                   (5, "line two is here\nline three is here"), (6, "THE naïve")], "item_id long, text string")
    given = read(spark, FOLDER, "benchmark")
    for df, tests in ((odd, items), (read(spark, FOLDER, "documents"), given)):
        expected = []
        for i, t in rows_of(df):
            w = WORD.findall(lower(t))
            for r in tests.collect():
                q = WORD.findall(lower(r.text))
                n = min(len(q), 5)
                if n:
                    want = {tuple(q[k:k + n]) for k in range(len(q) - n + 1)}
                    have = want & {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
                    if 10 * len(have) >= 8 * len(want):
                        expected.append((i, r.item_id, len(want), len(have)))
        same(decontaminate.contaminated(df, tests).collect(), expected)
        left = decontaminate.drop_contaminated(df, tests)
        assert left.columns == df.columns and left.count() + len({repr(e[0]) for e in expected}) <= df.count()
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0


def test_decontaminate_in_blocks(spark, monkeypatch):
    docs, items = read(spark, FOLDER, "documents"), read(spark, FOLDER, "benchmark")
    whole = decontaminate.contaminated(docs, items).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 300)
    same(decontaminate.contaminated(docs, items).collect(), [tuple(r) for r in whole])


def brute_lines(rows):
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    packed = lambda x: x.to_bytes(8, "little", signed=True)
    chunks = {}
    for key in {(i, t) for i, t in rows if t is not None}:
        lines = key[1].split("\n")
        h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in lines]
        cut, out = 0, []
        for k in range(len(lines)):
            rolled = signed(xxhash.xxh64_intdigest(packed(h[k]), xxhash.xxh64_intdigest(packed(h[k - 1]), 42))) if k else 1
            if rolled % 2 == 0 or k == len(lines) - 1:
                out.append("\n".join(lines[cut:k + 1]))
                cut = k + 1
        chunks[key] = out
    first = {}
    order = {}
    for key, out in chunks.items():
        rank = (key[0] is not None, key[0] or 0)
        tie = signed(xxhash.xxh64_intdigest(key[1].encode(), 42))
        for place, c in enumerate(out):
            if "\n" in c and any(x.isalnum() for x in c):
                spot = (rank, place, tie)
                if c not in first or spot < first[c]:
                    first[c] = spot
        order[key] = (rank, tie)
    result = []
    for i, t in rows:
        if t is None:
            result.append((i, None, 0, 0))
            continue
        rank, tie = order[i, t]
        kept, gone = [], []
        for place, c in enumerate(chunks[i, t]):
            (gone if c in first and first[c] != (rank, place, tie) else kept).append(c)
        result.append((i, "\n".join(kept), len(gone), sum(c.count("\n") + 1 for c in gone)))
    return result


def test_line_dedup(spark, odd, empty):
    for df in docs_of(spark, odd).values():
        got = line_dedup.dedup_lines(df)
        assert got.columns == [*df.columns, "_removed_chunks", "_removed_lines"]
        same(got.select("doc_id", "text", "_removed_chunks", "_removed_lines").collect(), brute_lines(rows_of(df)))
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_passages(rows):
    """Windows by dictionary; also counts nothing but what the docstring says."""
    content = re.compile(r"[^\W_]")
    docs, first, gone = {}, {}, {}
    for key in {(i, t) for i, t in rows if t is not None}:
        units = []
        for line in key[1].split("\n"):
            if units and not content.search(line):
                units[-1] += "\n" + line
            else:
                units.append(line)
        docs[key] = units
    for (i, t), units in docs.items():
        tie = xxhash.xxh64_intdigest(t.encode(), 42)
        tie -= (1 << 64) if tie >= 1 << 63 else 0
        for k, u in enumerate(units):
            if k or content.search(u):
                windows = [(2 * k, u + "\n" + units[k + 1].split("\n")[0])] if k + 1 < len(units) else []
                for place, w in windows + [(2 * k + 1, u)] * ("\n" in u):
                    first.setdefault(w, []).append(((i is not None, i or 0, place, tie), (i, t), place))
    for found in first.values():
        _, key0, place0 = min(found, key=lambda x: x[0])
        for _, key, place in found:
            if (key, place) != (key0, place0) and (key, place) != (key0, place0 + 2):
                gone.setdefault(key, set()).update([place // 2] if place % 2 else [place // 2, place // 2 + 1])
    out = []
    for i, t in rows:
        out_of = gone.get((i, t), set())
        if not out_of:
            out.append((i, t, 0, 0))
            continue
        text = "\n".join(u for k, u in enumerate(docs[i, t]) if k not in out_of)
        text = text if content.search(text) else ""
        n = t.count("\n") + 1 - (text.count("\n") + 1 if text else 0)
        out.append((i, text, sum(k - 1 not in out_of for k in out_of), n))
    return out


def test_passages(spark, odd, empty):
    for df in docs_of(spark, odd).values():
        got = line_dedup.dedup_passages(df)
        assert got.columns == [*df.columns, "_removed_chunks", "_removed_lines"]
        same(got.select("doc_id", "text", "_removed_chunks", "_removed_lines").collect(), brute_passages(rows_of(df)))
    assert line_dedup.dedup_passages(empty).count() == 0
    rows = [(0, "x\nx\nx"), (1, "\n\nhead a\n\n--\n\n\ntail b"), (2, "\n\nhead a\n\n--\n\n\ntail b"), (3, "own\nx\nx\nown too"),
            (4, "y\n\nz"), (5, "new\ny\n\nz\n\n\nlast")]
    got = line_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {
        0: "x\nx\nx", 1: rows[1][1], 2: "", 3: "own\nown too", 4: "y\n\nz", 5: "new\nlast"}


def test_passages_by_chunks(spark):
    lines = [f"line {i} of the passage" for i in range(40)]
    docs = line_dedup.with_units(line_dedup._keyed(spark.createDataFrame(
        [(1, "\n".join(["alpha", "beta", *lines])), (2, "\n".join(["gamma", *lines, "delta"])), (3, "alone"), (4, "")],
        "doc_id long, text string"), "doc_id", "text"), "text").select("_key", "_units")
    chunks = line_dedup.chunk_removals(docs)
    found = sorted((r.a, r.b) for r in chunks.where("_key.id = 2").collect())
    assert chunks.where("_key.id != 2").count() == 0 and found and all(b - a >= 2 for a, b in found)
    assert sum(b - a for a, b in found) >= 30  # only what lies beside the first and last boundary is left to windows
    spans = line_dedup._chunked(docs).where("_key.id = 1").first()._spans
    assert [(s.a, s.b) for s in spans][0][0] == 0 and all(x.b == y.a for x, y in zip(spans, spans[1:])) and spans[-1].b == 42
    windows = line_dedup.window_removals(docs, chunks).where("_key.id = 2").select("a", "b").collect()
    units = {u for a, b in [*found, *windows] for u in range(a, b)}
    assert units == set(range(1, 41)) and not any(a <= x and y <= b for x, y in windows for a, b in found)


def test_passages_with_clashing_columns(spark, odd):
    names = ["_key", "_places", "_units", "_gone", "_left", "_removed_lines", "_removed_chunks", "row", "id", "removed_lines"]
    plain_docs = odd.select("doc_id", "text")
    clashing = plain_docs.withColumns({c: F.lit(f"own {c}") for c in names})
    got = line_dedup.dedup_passages(clashing)
    expected = line_dedup.dedup_passages(plain_docs)
    same(got.select(expected.columns).collect(), [tuple(r) for r in expected.collect()])
    kept = [c for c in names if not c.startswith("_removed")]
    assert got.select(kept).distinct().collect() == [tuple(f"own {c}" for c in kept)]
    left = corpus_pipeline.lines(spark, clashing, FOLDER)
    assert left.columns == clashing.columns and left.select(names).distinct().collect() == [tuple(f"own {c}" for c in names)]
    same(left.select("doc_id", "text").collect(), [tuple(r) for r in corpus_pipeline.lines(spark, plain_docs, FOLDER).collect()])


def test_planted_passages(spark):
    """Passages of 2 to 6 lines in different surroundings: the first stays, the others go whole."""
    rng, n = random.Random(9), iter(range(10 ** 6))
    own = lambda: [f"own {next(n)}" for _ in range(rng.randint(1, 6))]
    planted = [[f"passage {p} line {k}" for k in range(size)] for p, size in enumerate([2, 3, 4, 5, 6] * 8)]
    rows, expected = [], []
    for p in planted * 3:
        a, b = own(), own()
        i = len(rows)
        rows.append((i, "\n".join(a + p + b)))
        expected.append((i, "\n".join(a + (p if i < len(planted) else []) + b)))
    got = line_dedup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.select("doc_id", "text").collect(), expected)


def brute_quality(text):
    words, lines, seen, dup = WORD.findall(text or ""), (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    covered = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)), failed


def test_quality_rules(spark, odd, empty):
    labels = read(spark, FOLDER, "labels")
    for df in docs_of(spark, odd).values():
        got = quality_rules.apply_rules(df, labels).collect()
        same([(r.doc_id, *(r[b] for b in quality_rules.BASE), r.base_failed) for r in got],
             [(i, *base, failed) for i, t in rows_of(df) for base, failed in [brute_quality(t)]])
        assert not any(r.kept and r.base_failed for r in got)
        kept = quality_rules.keep_good(df, labels)
        assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    verdict = {r.doc_id: r for r in got}
    for r in labels.collect():
        if r.doc_id in verdict and not verdict[r.doc_id].base_failed and not r.toxic:
            assert verdict[r.doc_id].kept == (r.quality == 1)
    assert quality_rules.apply_rules(empty, labels).count() == 0
    assert quality_rules.apply_rules(odd, labels.where("false")).where("kept = base_failed").count() == 0


def toxic_verdicts(spark, fitted_on, judged):
    """Counts by ``(toxic, kept)`` of documents labelled good that pass the base rules."""
    folder = "/root/testdata/sf0.1"
    labels = read(spark, folder, "labels")
    got = (quality_rules.apply_rules(read(spark, folder, "documents"), labels.where(fitted_on)).where("not base_failed")
           .join(labels.where("quality = 1").where(judged), "doc_id").groupBy("toxic", "kept").count().collect())
    n = {(r.toxic, r.kept): r["count"] for r in got}
    print(n)
    return n


def test_quality_rules_find_toxic(spark):
    n = toxic_verdicts(spark, "true", "true")
    assert n.get((1, False), 0) > 0.8 * (n.get((1, False), 0) + n.get((1, True), 0)), n
    assert n.get((0, False), 0) < 0.01 * n[0, True], n


def test_quality_rules_on_labels_not_fitted_on(spark):
    n = toxic_verdicts(spark, "doc_id % 2 = 0", "doc_id % 2 = 1")  # measured: 148 of 190 toxic ones go, 6 of 1,475 others
    assert n.get((1, False), 0) > 0.75 * (n.get((1, False), 0) + n.get((1, True), 0)), n
    assert n.get((0, False), 0) < 0.01 * n[0, True], n


def brute_scores(words, ratios):
    """Mean and word score by plain loops; the bins come from the operator."""
    found = quality_rules.all_bins(words).tolist()
    pairs = [ratios[b] for b in found if b < quality_rules.BINS]
    single = sorted(ratios[b] for b in found if b >= quality_rules.BINS)
    lowest = single[:len(single) // 100 + 1]
    return sum(pairs) / len(pairs) if pairs else 0.0, sum(lowest) / len(lowest) if lowest else 0.0


def brute_logs(counts):
    b, w = quality_rules.BINS, quality_rules.WORD_BINS
    sums = [sum(n for k, n in counts.items() if (k >= b) == single) for single in (False, True)]
    return lambda k: math.log((counts[k] + 0.5) / (sums[k >= b] + 0.5 * (w if k >= b else b)))


def test_quality_verdicts(spark):
    labels, docs = read(spark, FOLDER, "labels"), read(spark, FOLDER, "documents")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    half = {r.doc_id: r.half for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half")).collect()}
    words = {i: Texts([(t or "").encode()]).words(0) for i, t in rows_of(docs)}
    failed = {i: quality_rules.fails(w) for i, w in words.items()}
    counts = [Counter(), Counter(), Counter()]
    for i, w in words.items():
        found = quality_rules.all_bins(w).tolist()
        counts[2].update(found)
        if i in trusted:
            counts[half[i]].update(found)
    raw = brute_logs(counts[2])

    class Ratios(dict):
        def __init__(self, target):
            self.target = brute_logs(target)

        def __missing__(self, k):
            self[k] = self.target(k) - raw(k)
            return self[k]

    other = [Ratios(counts[1]), Ratios(counts[0])]
    held_out = [brute_scores(words[i], other[half[i]]) for i in words if i in trusted and not failed[i]]

    def low(scores):
        steps = sorted(math.floor(s * 1024) for s in scores)
        return steps[int(0.005 * len(steps))] / 1024
    mean_least, word_least = low([m for m, _ in held_out]) - 0.05, low([w for _, w in held_out])
    ratios = Ratios(counts[0] + counts[1])
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs, labels).collect()}
    for i, w in words.items():
        mean, word = brute_scores(w, ratios)
        assert abs(got[i].score - mean) < 1e-9 and abs(got[i].word_score - word) < 1e-9
        assert got[i].kept == (not failed[i] and mean >= mean_least and word >= word_least), i


def test_trusted_sample(spark):
    rows = [(i, 1, 0) for i in range(500)] + [(1, 0, 0), (2, 1, 1), (3, None, 0), (4, 1, None), (None, 1, 0)] + [(7, 1, 0)] * 90
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    everyone = {r._id for r in quality_rules.trusted_ids(labels, 1000).collect()}
    assert everyone == set(range(500)) - {1, 2, 3}
    few = [r._id for r in quality_rules.trusted_ids(labels, 200).collect()]
    assert len(set(few)) == len(few) == 200 and set(few) <= everyone
    assert quality_rules.trusted_ids(labels.where("false"), 10).count() == 0


def test_quality_rules_fit_on_all_trusted(spark):
    ids = spark.range(50_100)  # all documents are trusted, so the target's counts are those of the corpus
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7, F.lit(" x")).alias("text"))
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    ratio, _, word_ratio, _ = quality_rules.fit(docs, labels)
    assert not ratio.any() and not word_ratio.any()


def brute_windows(rows, n=50):
    first, out = {}, []
    data = [(-(1 << 63) if i is None else i, (t or "").encode(), i) for i, t in rows]
    for order, b, _ in data:
        for s in range(len(b) - n + 1):
            if first.get(b[s:s + n], 1 << 63) > order:
                first[b[s:s + n]] = order
    for order, b, i in data:
        mask = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first[b[s:s + n]] < order:
                mask[s:s + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(b, mask) if not m)).hexdigest()))
    return out


def test_suffix_dedup(spark, odd, empty, monkeypatch):
    for df in docs_of(spark, odd).values():
        same(suffix_dedup.remove_repeats(df).collect(), brute_windows(rows_of(df)))
    assert suffix_dedup.remove_repeats(empty).count() == 0
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)  # long texts go in pieces
    assert suffix_dedup.Runs([b"ab" * 400]).n.sum() == 751


SCHEMA = {"add": {"x": ("long", True), "note": ("string", False)}}


def test_chat(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "add", '{"x": 1, "note": "n"}', None), (1, "b", 2, "add", '{"x":"1"}', "a"), (1, "c", 4, "add", "{}", "b"),
        (1, "d", 6, "sub", "{}", "c"), (1, "e", 8, "add", "[1]", "missing"), (2, "x", 0, "add", '{"x":2}', "y"),
        (2, "y", 2, "add", '{"x":2}', "x"), (2, "z", 4, "add", '{"x":2}', "y"), (3, "k", 0, "add", '{"x":1}', None),
        (3, "k", 2, "add", '{"x":1,"y":{"b":1,"a":[2, 1]}}', None), (3, "l", 4, "add", '{"x":1}', None),
        (None, "a", 0, "add", None, None), (4, None, 0, "add", '{"x":1}', None)],
        "conv_id long, call_id string, turn long, name string, arguments string, after string")
    results = spark.createDataFrame([(1, "a", 1, "r1"), (1, "zz", 1, "lost"), (3, "l", 4, "early"), (3, "k", 5, "rk"), (None, "a", 1, "n")],
                                    "conv_id long, call_id string, turn long, content string")
    got = chat.link_calls(calls, results, SCHEMA).collect()
    by = {(r.conv_id, r.call_id, r.call_turn): r for r in got}
    assert len(got) == 15
    assert [by[1, c, t].level for c, t in (("a", 0), ("b", 2), ("c", 4), ("d", 6), ("e", 8))] == [0, 1, 2, 3, 0]
    assert by[1, "a", 0].status == "ok" and by[3, "l", 4].status == "result_before_call"
    assert by[1, "b", 2].problems == ["x is no long"] and by[1, "c", 4].problems == ["missing x"]
    assert by[1, "d", 6].problems == ["unknown tool"] and by[1, "e", 8].problems == ["no JSON object"]
    assert {by[2, c, t].status for c, t in (("x", 0), ("y", 2), ("z", 4))} == {"cycle"}
    assert by[3, "k", 2].repeated_id and by[3, "k", 2].problems == ["unknown y"]
    assert by[1, "zz", None].status == "no_call"
    assert json.loads(by[3, "k", 2].record)["arguments"] == {"x": 1, "y": {"a": [2, 1], "b": 1}}
    assert '"arguments":{"x":1,"y":{"a":[2,1],"b":1}}' in by[3, "k", 2].record
    assert chat.link_calls(calls.where("false"), results.where("false"), SCHEMA).count() == 0


def test_conversations(spark):
    rows = read(spark, FOLDER, "conversations").collect()
    users = {(r.conv_id, r.turn) for r in rows if r.role == "user"}
    answers = {(r.conv_id, r.turn) for r in rows if r.role == "assistant"}

    def level(c, t):
        return 1 + level(c, t - 2) if (c, t - 2) in users else 0
    got = QUERIES["op1_chat_format"](spark, FOLDER).collect()
    same([(r.conv_id, r.call_turn, r.level, r.status) for r in got if r.status != "no_call"],
         [(c, t, level(c, t), "ok" if (c, t + 1) in answers else "no_result") for c, t in users])


def test_pipeline(spark, odd):
    docs = read(spark, FOLDER, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= n, name
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == n
    same(corpus_pipeline.run(spark, FOLDER).select("doc_id").collect(), [(r.doc_id,) for r in docs.collect()])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, FOLDER).count() >= 0
        assert stage(spark, odd.where("false"), FOLDER).count() == 0
