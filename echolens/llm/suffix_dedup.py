"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Every window of ``LENGTH`` bytes that also starts in a document with a smaller id is covered. Suffixes are sorted by
most-significant-digit passes and only as deep as ``LENGTH`` bytes; a suffix alone in its group leaves at once, and groups
left after the last pass are exactly the repeated windows.

The first digit of a window is its anchor: of its ``GRAM``-byte grams the one with the least hash, the leftmost of equals. Equal
windows have equal anchors at equal places, so this digit is as good as leading bytes, but neighbouring windows share
it, and a window run with one anchor travels as one context of at most ``WIDTH`` bytes instead of window by window.

1. Texts that occur again whole are set aside: all but the first are covered entirely.
2. Documents are dealt to partitions of bounded size. Each sends the set of its anchor hashes, by hash range; back
   come those that occur more than once anywhere.
3. Each partition sends the contexts of its repeated anchors, each different context once, with the smallest id that has it. A hash
   range radix-sorts their windows by eight-byte digits and answers with the smallest id per window.
4. Each partition covers the windows whose smallest id is below the document's.

Since partitions send sets, a passage that most documents hold costs a row per partition, not per document. All
exchanges are shuffles of one plan, so lost executors cost recomputation only.

A null text is empty. Texts shorter than ``LENGTH`` keep all. A null id counts as smaller than all others. Rows with the same id do
not cover each other. Texts are bytes in UTF-8; what is kept need not be valid UTF-8.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import written
from echolens.llm.words import mix

LENGTH = 50
GRAM = 16
GRAMS = LENGTH - GRAM + 1
WIDTH = LENGTH + GRAMS - 1      # bytes of a context: its windows all hold the anchor
CHUNK = 1 << 20
PARTITION_BYTES = 8 << 20
BROADCAST_ROWS = 200_000

_PLACE_BITS = np.uint64(22)
_PLACES = np.uint64((1 << 22) - 1)
_rng = np.random.Generator(np.random.PCG64(4242))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = np.dtype([("h", ">u8"), ("lead", "u1"), ("n", "u1"), ("bytes", "u1", WIDTH)])


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of each run of GRAM bytes; sums of twice as many bytes from two sums."""
    h, step, factor = _BYTE[data], 1, 0x9E3779B97F4A7C15
    while step < GRAM:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor % (1 << 64)
    return mix(h)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (n - size)], x[n - size:]) if n > size else x


class Runs:
    """Window runs of some texts: text number, first window, number of windows, anchor's distance, anchor hash, row."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray | None = None, contexts: bool = False):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        found = []
        for owner, at, data, starts, sizes in self._chunks(texts):
            run = self._runs(data, starts, sizes)
            if run is None:
                continue
            seg, first, n, lead, h = run
            if wanted is not None:
                keep = np.isin(h, wanted)
                seg, first, n, lead, h = seg[keep], first[keep], n[keep], lead[keep], h[keep]
            rows = np.zeros(len(h) if contexts else 0, _ROW)
            if contexts:
                rows["h"], rows["lead"], rows["n"] = h, lead, n
                reach = np.arange(WIDTH)
                taken = data[np.minimum(first[:, None] + reach, len(data) - 1)]
                rows["bytes"] = taken * (reach < (n + LENGTH - 1)[:, None])
            found.append((owner[seg], first - starts[seg] + at[seg], n, h, rows))
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, _ROW)]
        self.text, self.first, self.n, self.h, self.rows = (
            [np.concatenate(x) for x in zip(*found)] if found else empty)

    @staticmethod
    def _chunks(texts):
        """Short texts together, long ones by overlapping pieces; windows never cross texts."""
        held, size = [], 0

        def out():
            sizes = np.array([len(x[2]) for x in held])
            return (np.array([x[0] for x in held]), np.array([x[1] for x in held]),
                    np.frombuffer(b"".join(x[2] for x in held), np.uint8), np.cumsum(sizes) - sizes, sizes)
        for i, text in enumerate(texts):
            for at in range(0, len(text) - LENGTH + 1, CHUNK):
                piece = text[at:at + CHUNK + LENGTH - 1]
                held.append((i, at, piece))
                size += len(piece)
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    @staticmethod
    def _runs(data, starts, sizes):
        h = grams(data)
        place = np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_min((h >> _PLACE_BITS << _PLACE_BITS) | place, GRAMS) & _PLACES).astype(np.int64)
        count = sizes - LENGTH + 1
        seg = np.repeat(np.arange(len(starts)), count)
        window = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count) + starts[seg]
        own = anchor[window]
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (seg[1:] != seg[:-1]))))
        first = window[new]
        return (seg[new], first, np.diff(np.append(new, len(own))), own[new] - first, h[own[new]])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    n = len(arrays[0])
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(n, -1).T.tobytes() for a in arrays]
    return zlib.compress(b"".join(planes), 1)


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, at, out = len(raw) // sum(widths), 0, []
    for t, w in zip(types, widths):
        out.append(np.ascontiguousarray(raw[at:at + n * w].reshape(w, n).T).view(t).reshape(n))
        at += n * w
    return out


def _message(rows: list[tuple]) -> pa.Table:
    """Rows ``(to, sender, kind, data)``."""
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(
        (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["to", "sender", "kind", "data"])


MESSAGE = "to long, sender long, kind int, data binary"
REPEATED, ANSWER = 1, 2


def _by_range(h: np.ndarray, bits: int):
    """Pieces of ascending hashes by leading bits: (range, slice)."""
    ranges = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1]))) if len(h) else []
    for a, b in zip(cut, [*cut[1:], len(h)]):
        yield int(ranges[a]), slice(a, b)


def _texts(table: pa.Table) -> list[bytes]:
    return table.column("text").to_pylist()


def _partition(table: pa.Table) -> int:
    return table.column("p")[0].as_py()


def windows_minima(rows: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """For different contexts, sorted, and the smallest id of each: the smallest id of each of their windows.

    Most-significant digits first: anchor hash and distance, then eight bytes at a time to the full length.
    """
    n = rows["n"].astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    out = np.repeat(least, n)
    hashes = rows["h"].astype(np.uint64)
    same = hashes[1:] == hashes[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    keep = np.repeat(shared, n)  # a context alone with its anchor has no equal window
    row = np.repeat(np.arange(len(rows)), n)[keep]
    window = (np.arange(first[-1]) - np.repeat(first[:-1], n))[keep]
    at = np.flatnonzero(keep)
    distance = rows["lead"].astype(np.int64)[row] - window
    group = np.unique(hashes[row], return_inverse=True)[1] * WIDTH + distance
    flat = rows["bytes"]
    for digit in range(0, LENGTH, 8):
        width = min(8, LENGTH - digit)
        key = np.zeros((len(row), 8), np.uint8)
        key[:, :width] = flat[row[:, None], window[:, None] + np.arange(digit, digit + width)]
        key = key.view(">u8").reshape(-1).astype(np.uint64)
        order = np.lexsort((key, group))
        group, key, row, window, at = group[order], key[order], row[order], window[order], at[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1]))) if len(row) else np.zeros(0, bool)
        group = np.cumsum(new)
        alone = new & np.concatenate((new[1:], [True])) if len(row) else new
        group, row, window, at = group[~alone], row[~alone], window[~alone], at[~alone]
    if len(row):
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        low = np.minimum.reduceat(least[row], starts)
        out[at] = np.repeat(low, np.diff(np.append(starts, len(row))))
    return np.split(out, first[1:-1])


def _contexts(table: pa.Table, wanted: np.ndarray):
    """Runs of repeated anchors, the different contexts among them in ascending order, which each run has, smallest ids."""
    order = np.asarray(table.column("ord").to_numpy())
    runs = Runs(_texts(table), wanted, contexts=True)
    raw = np.ascontiguousarray(runs.rows).view(np.dtype((np.void, _ROW.itemsize)))
    distinct, which = np.unique(raw, return_inverse=True)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, which.reshape(-1), order[runs.text])
    return runs, distinct.view(_ROW), which.reshape(-1), least


def _wanted(answers: pa.Table) -> np.ndarray:
    kinds = answers.column("kind").to_pylist()
    found = [unpack(d, np.uint64)[0] for k, d in zip(kinds, answers.column("data").to_pylist()) if k == REPEATED]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    docs = (df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
            .withColumn("ord", F.coalesce("id", F.lit(-(1 << 63)).cast("long"))).withColumn("h", F.xxhash64("text")))
    same = ["h", "g", "n_bytes"]
    base = written(docs.select("id", "ord", "h", F.xxhash64("text", F.lit(1)).alias("g"),
                               F.octet_length("text").cast("long").alias("n_bytes"),
                               F.when(F.octet_length("text") < LENGTH, F.sha2("text", 256)).alias("sha")), "texts")
    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    firsts = base.groupBy(*same).agg(F.min("ord").alias("first"))
    copies = written(base.join(firsts, same).where("ord > first"), "copies")
    named = copies.select("ord", "h").distinct()
    named = F.broadcast(named) if copies.count() <= BROADCAST_ROWS else named
    n_parts = max(16, total // PARTITION_BYTES) | 1
    bits = max(4, int(total // PARTITION_BYTES).bit_length())
    parted = (docs.join(named, ["ord", "h"], "left_anti")
              .select("id", "ord", "text", F.pmod("h", F.lit(n_parts)).alias("p")))

    def send_anchors(table: pa.Table) -> pa.Table:
        p = _partition(table)
        h, counts = np.unique(Runs(_texts(table)).h, return_counts=True)
        return _message([(r, p, 0, pack(h[s], np.minimum(counts[s], 2).astype(np.uint8)))
                         for r, s in _by_range(h, bits)])

    def repeated_anchors(table: pa.Table) -> pa.Table:
        senders = table.column("sender").to_pylist()
        sent = [unpack(d, np.uint64, np.uint8) for d in table.column("data").to_pylist()]
        h = np.concatenate([x[0] for x in sent])
        distinct, where = np.unique(h, return_inverse=True)
        twice = distinct[np.bincount(where, weights=np.concatenate([x[1] for x in sent])) > 1]
        out = []
        for p, (mine, _) in zip(senders, sent):
            found = mine[np.isin(mine, twice, assume_unique=True)]
            if len(found):
                out.append((p, 0, REPEATED, pack(found)))
        return _message(out)

    def send_contexts(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows or not answers.num_rows:
            return _message([])
        _, rows, _, least = _contexts(texts, _wanted(answers))
        return _message([(r, _partition(texts), 0, pack(rows[s], least[s]))
                         for r, s in _by_range(rows["h"].astype(np.uint64), bits)])

    def sort_windows(table: pa.Table) -> pa.Table:
        senders = table.column("sender").to_pylist()
        sent = [unpack(d, np.dtype((np.void, _ROW.itemsize)), np.int64) for d in table.column("data").to_pylist()]
        distinct, where = np.unique(np.concatenate([x[0] for x in sent]), return_inverse=True)
        where = where.reshape(-1)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, where, np.concatenate([x[1] for x in sent]))
        minima = windows_minima(distinct.view(_ROW), least)
        bucket, out, at = table.column("to")[0].as_py(), [], 0
        for p, (rows, low) in zip(senders, sent):
            mine, at = where[at:at + len(rows)], at + len(rows)
            told = [i for i, j in enumerate(mine) if (minima[j] < low[i]).any()]
            if told:
                values = np.concatenate([minima[mine[i]] for i in told])
                out.append((p, bucket, ANSWER, len(told).to_bytes(4, "big") + zlib.compress(
                    np.array(told, np.uint32).tobytes() + values.tobytes(), 1)))
        return _message(out)

    def cover(texts: pa.Table, answers: pa.Table) -> pa.Table:
        raw = _texts(texts) if texts.num_rows else []
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        covered = np.zeros(begins[-1], bool)
        if raw and answers.num_rows:
            runs, rows, which, least = _contexts(texts, _wanted(answers))
            n = rows["n"].astype(np.int64)
            first = np.concatenate(([0], np.cumsum(n)))
            minima = np.repeat(least, n)
            ranges = {r: s.start for r, s in _by_range(rows["h"].astype(np.uint64), bits)}
            for kind, bucket, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "sender", "data"))):
                if kind == ANSWER:
                    k, body = int.from_bytes(data[:4], "big"), zlib.decompress(data[4:])
                    told = np.frombuffer(body, np.uint32, k).astype(np.int64) + ranges[bucket]
                    minima[np.concatenate([np.arange(first[i], first[i + 1]) for i in told])] = np.frombuffer(
                        body, np.int64, offset=4 * k)
            # windows of all runs against the smallest id of their window
            run = np.repeat(np.arange(len(which)), runs.n)
            window = np.arange(len(run)) - np.repeat(np.cumsum(runs.n) - runs.n, runs.n)
            order = np.asarray(texts.column("ord").to_numpy())
            hit = minima[first[which[run]] + window] < order[runs.text[run]]
            start = (begins[runs.text] + runs.first)[run[hit]] + window[hit]
            edge = (np.bincount(start, minlength=begins[-1] + 1) - np.bincount(start + LENGTH, minlength=begins[-1] + 1))
            covered = np.cumsum(edge)[:-1] > 0
        removed, spans, digests = [], [], []
        for i, t in enumerate(raw):
            mask = covered[begins[i]:begins[i + 1]]
            removed.append(int(mask.sum()))
            spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            kept = np.frombuffer(t, np.uint8)[~mask].tobytes() if removed[-1] else t
            digests.append(hashlib.sha256(kept).hexdigest())
        return pa.table([texts.column("id") if raw else pa.array([], pa.int64()), pa.array(sizes, pa.int64()),
                         pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                        names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    by_part = parted.groupBy("p")
    repeated = (by_part.applyInArrow(send_anchors, MESSAGE)
                .groupBy("to").applyInArrow(repeated_anchors, MESSAGE))
    answered = (by_part.cogroup(repeated.groupBy("to")).applyInArrow(send_contexts, MESSAGE)
                .groupBy("to").applyInArrow(sort_windows, MESSAGE))
    result = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    covered = (by_part.cogroup(repeated.unionByName(answered).groupBy("to")).applyInArrow(cover, result))
    whole = copies.select(
        "id", "n_bytes", F.when(F.col("n_bytes") >= LENGTH, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(F.col("n_bytes") >= LENGTH, 1).otherwise(0).cast("long").alias("n_spans"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("kept_sha256"))
    return covered.unionByName(whole).withColumnRenamed("id", id_col)
