"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets: class c holds 2**c to 2**(c+1) - 1
shingles. For each class, documents are seen as overlapping windows of twice the class's largest size, so
an item that lies in a document lies whole in some window, and a window's size is bounded by
the items' instead of the document's. Containment of at least ``NUM / DEN`` within such a window means a
Jaccard similarity of at least 0.19, so among ``HASHES`` MinHash values item and window share one but for
a chance of 0.81 ** 64 < 2e-6. Each shared value gives a candidate; candidates are verified
by exact containment of the item's shingles in the whole document.

Items are taken in blocks of at most ``BLOCK_SHINGLES`` shingles, so what goes to the tasks at once has a
fixed bound; a benchmark of more blocks is searched in as many passes over the documents. Documents
are only mapped, never shuffled.

Shingles are of ``N`` words, A-Z lower-cased. An item of fewer words is one shingle of all of them and is
contained where those words stand in a row. Items without words, null texts and empty texts match nothing.
Repeated rows are searched each on its own; an item id that occurs twice counts as two items.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import batch_of, in_batches, written
from echolens.llm.words import Texts, mix, parts, shingles, windows

N = 5
NUM, DEN = 8, 10
HASHES = 64
BLOCK_SHINGLES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def _values(found: np.ndarray, k: int) -> np.ndarray:
    """Value of hash function k: a multiplication keeps the 32 mixed bits a permutation."""
    x = found * _A[k] + _B[k]
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


class SizeClass:
    """The items of one size class and the table of their MinHash values."""

    def __init__(self, words: int, largest: int, items: list[tuple[int, np.ndarray]]):
        self.words, self.largest, self.items = words, largest, items
        self.bits = max(14, len(items).bit_length() + 4)
        self.seen = np.zeros((HASHES, 1 << self.bits), bool)
        self.owners: list[dict[int, list[int]]] = [{} for _ in range(HASHES)]
        for j, (_, found) in enumerate(items):
            short = (found >> np.uint64(32)).astype(np.uint32)
            for k in range(HASHES):
                low = int(_values(short, k).min())
                self.seen[k, low & ((1 << self.bits) - 1)] = True
                self.owners[k].setdefault(low, []).append(j)


def size_classes(items: list[tuple[int, bytes]]) -> list[SizeClass]:
    by_size: dict[tuple[int, int], list] = {}
    for item_id, text in items:
        words = Texts([text], lower=True).words(0)
        if len(words):
            found = shingles(words, N)
            largest = (1 << len(found).bit_length()) - 1
            by_size.setdefault((min(len(words), N), largest), []).append((item_id, found))
    return [SizeClass(n, largest, found) for (n, largest), found in sorted(by_size.items())]


def hits(raw: list[bytes], classes: list[SizeClass]) -> list[tuple[int, int, int, int]]:
    """``(text number, item id, shingles of the item, of these in the text)`` of verified pairs."""
    texts = Texts(raw, lower=True)
    out = []
    for n in sorted({c.words for c in classes}):
        grams = [windows(texts.words(i), n) for i in range(len(texts))]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        if not sizes.sum():
            continue
        whole = [c for c in classes if c.words == n]
        short = (np.concatenate(grams) >> np.uint64(32)).astype(np.uint32)
        first = np.concatenate(([0], np.cumsum(sizes)))
        cuts = []
        for c in whole:  # blocks of the class's largest size; a window is a block and the next one
            count = -(-sizes // c.largest)
            owner = np.repeat(np.arange(len(sizes)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            cuts.append((first[owner] + place * c.largest, owner, set()))
        for k in range(HASHES):
            values = _values(short, k)
            for c, (cut, owner, candidates) in zip(whole, cuts):
                low = np.minimum.reduceat(values, cut)
                joined = low.copy()
                np.minimum(low[:-1], low[1:], out=joined[:-1], where=owner[:-1] == owner[1:])
                for w in np.flatnonzero(c.seen[k][joined & np.uint32((1 << c.bits) - 1)]):
                    for j in c.owners[k].get(int(joined[w]), ()):
                        candidates.add((int(owner[w]), j))
        for c, (_, _, candidates) in zip(whole, cuts):
            for i, j in sorted(candidates):
                item_id, found = c.items[j]
                shared = int(np.isin(found, grams[i]).sum())
                if DEN * shared >= NUM * len(found):
                    out.append((i, item_id, len(found), shared))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Bounded blocks of items, in id order; the driver holds one at a time."""
    block, size = [], 0
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    for item_id, text in rows.where(F.col(text_col).isNotNull()).toLocalIterator():
        text = bytes(text)
        size += len(text.split())
        block.append((item_id, text))
        if size >= BLOCK_SHINGLES:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(id, item id, n_shingles, n_shared)`` of each document that contains a test item."""
    docs = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    out = pa.schema([(id_col, pa.int64()), (item_col, pa.int64()), ("n_shingles", pa.int64()),
                     ("n_shared", pa.int64())])
    ddl = f"`{id_col}` long, `{item_col}` long, n_shingles long, n_shared long"

    def search(block):
        def run(batches):
            classes = size_classes(block)
            for part in parts(batches):
                found = hits([t or b"" for t in part.column(1).to_pylist()], classes)
                if found:
                    ids = part.column(0).to_pylist()
                    yield batch_of(out, [[ids[f[0]] for f in found],
                                         *([f[k] for f in found] for k in (1, 2, 3))])
        return in_batches(docs, run, ddl)

    blocks = _blocks(items, item_col, item_text)
    found = search(next(blocks, []))
    for block in blocks:
        found = written(found.unionByName(search(block)), "contaminated")
    return found


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text contains no test item."""
    place = df.columns.index(text_col)

    def keep(block):
        def run(batches):
            classes = size_classes(block)
            for batch in batches:
                texts = batch.column(place).cast(pa.binary())
                mask, at = np.ones(batch.num_rows, bool), 0
                for part in parts([pa.RecordBatch.from_arrays([texts, texts], ["a", "b"])]):
                    for i, *_ in hits([t or b"" for t in part.column(1).to_pylist()], classes):
                        mask[at + i] = False
                    at += part.num_rows
                yield batch.filter(pa.array(mask))
        return run

    for block in _blocks(items, item_col, item_text):
        df = in_batches(df, keep(block), df.schema)
    return df
