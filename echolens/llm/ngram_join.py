"""N-gram Jaccard self-join by token-combination prefixes, and its connected classes.

A document is the set of its n-word shingles; two documents link when their sets' Jaccard similarity reaches
``num / den``. Documents with the same set collapse into one node first.

Token classes. Shingle hashes are counted over the whole corpus in a sketch of ``2 ** BITS`` counters. Shingles whose
counter is far above the mean are frequent, all others rare. The sketch only orders tokens, so its collisions cost time,
never results; its bitmap of ``2 ** BITS`` bits is what goes to every task.

Prefixes. All sets are ordered alike: rare tokens first, by hash. If the overlap needed is o of n, at most e = n - o
tokens of a set are missing from a partner's. A rare token shared is found through itself. Frequent tokens are dealt to
parts, and two of them in one part make a combination; in a part of b tokens all but one may be missing before
a combination is lost. So the prefix goes on until rare tokens plus (b - 1) of each part reach e + 1; then partners share a rare token
or a combination. How far it has to go depends on the partner's size, and is shortest for sets of like size; so a signature
carries the reach from which on it belongs to the prefix, and two sets only meet where it lies within both of theirs. Parts depend on the size class of a set, so that combinations stay in proportion to the set; a set near
the border of its class is indexed for the next one too. Sets of under 32 shingles index frequent tokens singly.

Links. Nodes that share a signature are candidates. In large buckets neighbours in a random order are verified
first, in sub-buckets of bounded size; what links becomes one class. Then every remaining pair of a bucket that lies in different
classes and whose sizes allow a link is verified: members outside a bucket's most common class meet all others, so a bucket
of copies costs no square. Pairs are made only where 128 parity bits of each set leave a link possible. Verification
then bounds the overlap by 64-bin histograms and counts it exactly.

Sets are known by 64-bit fingerprints. Documents without words have no set and link with nothing. Null texts are empty.
Rows with the same id and text are one document; a null id takes part in links but never names a class.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.components import extended
from echolens.llm.tables import batch_of, in_batches, written
from echolens.llm.words import Texts, mix, parts, shingles

BITS = 24
FREQUENT = 24           # a counter up to this never makes a shingle frequent
SLICES = 64
FLUSH = 1 << 19
HELD = 1 << 15          # sets counted at a time, so that no count exceeds 16 bits
FAN_IN = 128            # pieces of the sketch summed at a time
SINGLES_BELOW = 5       # size classes 2**0..2**4 index frequent tokens one by one
PART_TOKENS = 8         # tokens of a set per part, at the lower end of its size class
LARGE = 16              # buckets from this size on are linked by neighbours first
FEW = 8                 # large buckets of a node whose neighbours are tried in a round
SUB_BUCKET = 1000
ROUNDS = 3
BROADCAST_ROWS = 200_000

_PAIR = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def needed(n: int, num: int, den: int) -> int:
    """Tokens of a set of n that any partner has."""
    return -(-num * n // den)


def fingerprint(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def histogram(found: np.ndarray) -> bytes:
    return np.minimum(np.bincount((found & np.uint64(63)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def pack(counts: np.ndarray) -> bytes:
    """Counters byte by byte: all lowest bytes, then the next ones, which are mostly zeros."""
    return zlib.compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def parity(found: np.ndarray) -> np.ndarray:
    """128 bits as two integers: whether an odd number of tokens falls into each bin."""
    odd = np.bincount((found >> np.uint64(6) & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(found: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix signatures of a sorted set, and the reach from which on each belongs to the prefix.

    ``frequent`` tells by leading hash bits. The reach is one more than the tokens that a partner may lack: at most
    ``n - needed + 1``, less for a partner of like size.
    """
    n = len(found)
    want = n - needed(n, num, den) + 1
    common = frequent[(found >> np.uint64(64 - BITS)).astype(np.int64)]
    rare, common = found[~common], found[common]
    if len(rare) >= want:
        return rare[:want], np.arange(1, want + 1)
    out, reach, want = [rare], [np.arange(1, len(rare) + 1)], want - len(rare)
    low, high = needed(n, num, den).bit_length() - 1, (n * den // num).bit_length() - 1
    if low < SINGLES_BELOW:
        out.append(common[:want])
        reach.append(len(rare) + np.arange(1, len(out[-1]) + 1))
    for level in range(max(low, SINGLES_BELOW), high + 1):
        n_parts = (1 << level) // PART_TOKENS
        part = (mix(common ^ _PAIR[2]) % np.uint64(n_parts)).astype(np.int64)
        new = np.zeros(len(common), np.int64)
        new[np.unique(part, return_index=True)[1]] = 1
        covered = np.arange(1, len(common) + 1) - np.cumsum(new)
        k = int(np.searchsorted(covered, want)) + 1
        order = np.argsort(part[:k], kind="stable")
        tokens, part = common[:k][order], part[:k][order]
        since = (len(rare) + 1 + np.concatenate(([0], covered[:k - 1])))[order]  # a token is in as long as less is covered
        step = 1
        while step < len(tokens):
            same = part[step:] == part[:-step]
            if not same.any():
                break
            out.append(mix(tokens[:-step][same] * _PAIR[0] + tokens[step:][same] * _PAIR[1] + np.uint64(level)))
            reach.append(since[step:][same])
            step += 1
    out, reach = np.concatenate(out), np.concatenate(reach)
    order = np.lexsort((reach, out))
    out, first = np.unique(out[order], return_index=True)
    return out, reach[order][first]


def needed_overlap(num: int, den: int, na: str, nb: str) -> str:
    """Partners share at least ``num / (num + den) * (na + nb)`` tokens."""
    return f"(({num} * ({na} + {nb}) + {num + den - 1}) div {num + den})"


def within_reach(num: int, den: int) -> str:
    """Whether a signature lies in both prefixes that two sets of ``na`` and ``nb`` tokens need for each other.

    If they must share ``o`` tokens, the one may lack ``na - o`` of the other's.
    """
    need = needed_overlap(num, den, "na", "nb")
    return f"wa <= na - {need} + 1 and wb <= nb - {need} + 1"


def _sets(part, n: int):
    texts = Texts([t or b"" for t in part.column(1).to_pylist()], lower=True)
    return [shingles(texts.words(i), n) for i in range(len(texts))]


def _measure(docs: DataFrame, n: int) -> DataFrame:
    """Rows of two kinds: ``(id, n, f, hist, lo, hi)`` of documents, and ``(slice, counts)`` of the sketch per task."""
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("hist", pa.binary()),
                     ("lo", pa.int64()), ("hi", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary())])

    def pieces(total):
        for k, piece in enumerate(np.split(total, SLICES)):
            if piece.any():
                yield batch_of(out, [*[[None]] * 6, [k], [pack(piece)]])

    def add(held, total):
        """Counts to the 16-bit counters, which are sent and begun anew before one runs over."""
        places, counts = np.unique(np.concatenate(held), return_counts=True)
        if len(counts) and int(total[places].max()) + int(counts.max()) > 0xFFFF:
            yield from pieces(total)
            total[:] = 0
        total[places] += counts.astype(np.uint16)

    def run(batches):
        total, held, size = np.zeros(1 << BITS, np.uint16), [], 0
        for part in parts(batches):
            sets = _sets(part, n)
            for s in sets:  # a part has at most 4096 sets, and a counter gets one of a shingle
                held.append((s >> np.uint64(64 - BITS)).astype(np.uint32))
                size += len(s)
            if size > FLUSH or len(held) > HELD:
                yield from add(held, total)
                held, size = [], 0
            empty, bits = [None] * len(sets), [parity(s) for s in sets]
            yield batch_of(out, [part.column(0), [len(s) for s in sets], [fingerprint(s) if len(s) else None for s in sets],
                                 [histogram(s) if len(s) else None for s in sets],
                                 [b[0] for b in bits], [b[1] for b in bits], empty, empty])
        if held:
            yield from add(held, total)
        yield from pieces(total)

    return in_batches(docs, run, "id long, n long, f long, hist binary, lo long, hi long, slice int, counts binary")


def _frequent(sketch: DataFrame, total: int) -> np.ndarray:
    """The bitmap of frequent counters: at most ``SLICES`` rows of fixed size come to the driver."""
    mean = total / (1 << BITS)
    limit = max(FREQUENT, mean + 5 * math.sqrt(mean) + 4)  # above what chance puts into a counter
    width = (1 << BITS) // SLICES

    def summed(table: pa.Table) -> np.ndarray:
        out = np.zeros(width, np.uint64)
        for piece in table.column("counts").to_pylist():
            out += unpack(piece)
        return out

    def partial(table: pa.Table) -> pa.Table:
        return pa.table({"slice": table.column("slice")[:1],
                         "counts": pa.array([pack(summed(table))], pa.binary())})

    def marked(table: pa.Table) -> pa.Table:
        return pa.table({"slice": table.column("slice")[:1],
                         "counts": pa.array([np.packbits(summed(table) > limit).tobytes()], pa.binary())})

    ddl = "slice int, counts binary"
    pieces = -(-sketch.count() // SLICES)
    while pieces > FAN_IN:  # a tree of sums, each over a bounded number of pieces
        pieces = -(-pieces // FAN_IN)
        sketch = (sketch.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(pieces)))
                  .groupBy("slice", "salt").applyInArrow(partial, ddl))
    rows = sketch.groupBy("slice").applyInArrow(marked, ddl).collect()
    out = np.zeros(1 << BITS, bool)
    for k, bits in rows:
        out[k * width:(k + 1) * width] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return out


def _index(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    out = pa.schema([("sig", pa.int64()), ("f", pa.int64()), ("n", pa.int64()), ("w", pa.int32())])
    packed = zlib.compress(np.packbits(frequent).tobytes())

    def run(batches):
        marks = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).astype(bool)
        for part in parts(batches):
            rows = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
            for s in _sets(part, n):
                if len(s):
                    found, reach = signatures(s, marks, num, den)
                    rows.append((found, np.full(len(found), fingerprint(s)), np.full(len(found), len(s)), reach))
            sigs, owners, sizes, reach = (np.concatenate(x) for x in zip(*rows))
            yield batch_of(out, [sigs.view(np.int64), owners, sizes, reach.astype(np.int32)])

    return in_batches(docs, run, "sig long, f long, n long, w int")


class _Verifier:
    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int):
        self.docs, self.nodes, self.n, self.num, self.den = docs, nodes, n, num, den

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``(a, b)`` whose sizes and histograms allow a link."""
        num, den = self.num, self.den
        side = lambda x: self.nodes.select(F.col("f").alias(x), F.col("n").alias(f"n_{x}"),
                                           F.col("hist").alias(f"h_{x}"))
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def run(batches):
            for batch in batches:
                a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
                ha, hb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 64).astype(np.int32)
                          for k in (4, 5))
                # the bins' differences are at most what the two sets do not share
                fits = np.abs(ha - hb).sum(1) * (num + den) <= (den - num) * (na + nb)
                yield batch_of(out, [a[fits], b[fits]])

        sized = (pairs.join(side("a"), "a").join(side("b"), "b")
                 .where(f"n_a * {den} >= n_b * {num} and n_b * {den} >= n_a * {num}")
                 .select("a", "b", "n_a", "n_b", "h_a", "h_b"))
        return in_batches(sized, run, "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that link, by exact overlap of the two sets."""
        n, num, den = self.n, self.num, self.den
        pairs = written(self.possible(pairs), "possible")
        involved = pairs.select(F.col("a").alias("f")).union(pairs.select("b")).distinct()
        where = written(self.nodes.join(involved, "f").select("f", "id"), "involved")
        if where.count() <= BROADCAST_ROWS:  # else the texts are shuffled to meet it
            where = F.broadcast(where)
        texts = (self.docs.join(where, self.docs["id"].eqNullSafe(where["id"]))
                 .select(where["f"], self.docs["text"]))
        out = pa.schema([("f", pa.int64()), ("tokens", pa.binary())])

        def tokens(batches):
            for part in parts(batches):
                kept = [(f, s.tobytes()) for f, s in zip(part.column(0).to_pylist(), _sets(part, n))
                        if len(s) and fingerprint(s) == f]  # an id may have several texts
                yield batch_of(out, [[k[0] for k in kept], [k[1] for k in kept]])

        # not written: both sides of the join read the one shuffle by f
        sets = in_batches(texts, tokens, "f long, tokens binary").dropDuplicates(["f"])
        side = lambda x: sets.select(F.col("f").alias(x), F.col("tokens").alias(f"t_{x}"))

        def count(batches):
            for batch in batches:
                kept = []
                for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if den * shared >= num * (len(x) + len(y) - shared):
                        kept.append((a, b))
                yield batch_of(pa.schema([("a", pa.int64()), ("b", pa.int64())]), [[k[0] for k in kept], [k[1] for k in kept]])

        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")
        return written(in_batches(both, count, "a long, b long"), "links")


def reachable(index: DataFrame, num: int, den: int) -> DataFrame:
    """Signatures of several sets, without the rows whose reach excludes even the bucket's smallest set."""
    shared = (index.groupBy("sig").agg(F.min("f").alias("x"), F.max("f").alias("y"), F.min("n").alias("low"))
              .where("x != y").select("sig", "low"))
    need = needed_overlap(num, den, "n", "low")
    return index.join(shared, "sig").where(f"w <= n - {need} + 1").select("sig", "f", "n", "w").distinct()


def _large(index: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of large buckets that meet sets of their own size, with the size of the bucket."""
    sizes = index.groupBy("sig").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE)
    return index.where(f"w <= n - {needed_overlap(num, den, 'n', 'n')} + 1").join(sizes, "sig").select("sig", "f", "size")


def _neighbours(large: DataFrame, seed: int) -> DataFrame:
    """Pairs of neighbours, in a random order, that differ in class, from large buckets of several classes.

    A node takes part in a few of its large buckets, the same ones as its copies do where they share them. This only
    saves work: whatever is not linked here meets in the last step.
    """
    from pyspark.sql import Window
    several = (large.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"))
               .where("x != y").select("sig"))
    order = Window.partitionBy("sig", "sub").orderBy("draw")
    few = Window.partitionBy("f").orderBy(F.xxhash64(F.lit(seed), "sig"), "sig")
    draw = F.xxhash64(F.lit(seed), "f", "sig")
    rows = (large.join(several, "sig", "left_semi").withColumn("place", F.row_number().over(few))
            .where(F.col("place") <= FEW).withColumn("draw", draw)
            .withColumn("sub", F.pmod(F.xxhash64(F.lit(seed), "draw"), F.ceil(F.col("size") / SUB_BUCKET)))
            .withColumn("other", F.lead("f").over(order)).withColumn("its", F.lead("label").over(order))
            .where("other is not null and label != its"))
    return rows.select(F.least("f", "other").alias("a"), F.greatest("f", "other").alias("b")).distinct()


def classes(df: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row: the smallest id of its class of linked documents."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    measured = written(_measure(docs, n), "sets")
    rows = measured.where("slice is null").select("id", "n", "f", "hist", "lo", "hi")
    nodes = written(rows.where("f is not null").groupBy("f")
                    .agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "hist", "lo", "hi")]), "nodes")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = _frequent(measured.where("slice is not null").select("slice", "counts"), total)
    index = written(_index(docs, n, num, den, frequent), "index")
    index = written(reachable(index, num, den), "buckets")
    large = written(_large(index, num, den), "large")

    verifier = _Verifier(docs, nodes, n, num, den)
    labels = None

    def labelled(rows):
        if labels is None:
            return rows.withColumn("label", F.col("f"))
        return (rows.join(labels.withColumnRenamed("node", "f"), "f", "left")
                .withColumn("label", F.coalesce("label", "f")))

    for seed in range(ROUNDS):
        pairs = written(_neighbours(labelled(large), seed), "neighbours")
        if pairs.isEmpty():
            break
        labels = extended(labels, verifier.links(pairs))

    # all pairs of different classes: the members outside a bucket's most common class meet all others
    members = written(labelled(index), "members")
    most = (members.groupBy("sig", "label").agg(F.count("*").alias("k"))
            .groupBy("sig").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels"))
            .where("labels > 1").select("sig", F.col("top.label").alias("top")))
    mixed = members.join(most, "sig").join(nodes.select("f", "lo", "hi"), "f")
    side = lambda x, y: [F.col(c).alias(d) for c, d in (
        ("f", x), ("label", f"l{x}"), ("n", f"n{x}"), ("w", f"w{x}"), ("lo", f"lo_{x}"), ("hi", f"hi_{x}"))] + y
    left = mixed.where("label != top").select("sig", *side("a", []))
    right = mixed.select("sig", *side("b", ["top"]))
    # a bin of odd difference holds a token that the two do not share
    near = f"(bit_count(lo_a ^ lo_b) + bit_count(hi_a ^ hi_b)) * {num + den} <= {den - num} * (na + nb)"
    pairs = (left.join(right, "sig")
             .where(f"la != lb and (lb = top or a < b) and {within_reach(num, den)} and {near}")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = extended(labels, verifier.links(pairs))

    named = (rows.join(labels.withColumnRenamed("node", "f"), "f", "left")
             .select("id", "n", F.coalesce("label", "f").alias("label")))
    smallest = (named.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id")))
    return (named.join(smallest, "label", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")))
