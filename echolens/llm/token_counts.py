"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes a doubly linked list of symbols. A heap holds every adjacent pair that forms a piece;
the best pair (highest score, then leftmost) is popped and merged until none is left. The count is
the number of initial symbols minus the number of merges; a character without a piece of its own
counts once per UTF-8 byte. No token identifier is ever made.

Rows: one per input row, in any order, repeated rows repeated. A null text counts as empty: 0 bytes,
0 tokens. Texts are taken whole; memory grows with the longest single text only.
"""

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import TwoAgeCache, batch_of

SPACE = "▁"       # stands for a blank in the vocabulary
CACHE_ENTRIES = 600_000
CACHED_LENGTH = 64     # longer stretches of text are rarely met again


class PieceMerger:
    """Merging by the scores of a piece vocabulary with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece
        pieces = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank = {pieces.id_to_piece(i): -pieces.get_score(i) for i in range(len(pieces))
                     if not (pieces.is_unknown(i) or pieces.is_control(i) or pieces.is_byte(i)
                             or pieces.is_unused(i))}
        self.stretches = self._stretches()
        self.cache = TwoAgeCache(self.merge, CACHE_ENTRIES)

    def _stretches(self) -> re.Pattern:
        """Cuts a text only where no piece can lie across, which is read off the vocabulary: before a run
        of blanks, around line breaks, and between letters and other characters, where the letters
        are the largest alphabetic set that no piece joins with anything else."""
        joined = {pair for p in self.rank for pair in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:])}
        if any(SPACE in pair or "\n" in pair for pair in joined):
            return re.compile("(?s).+")
        letters = {c for p in self.rank for c in p if c.isalpha()}
        while drop := {a if a in letters else b for a, b in joined if (a in letters) != (b in letters)}:
            letters -= drop
        if not letters:
            return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        letter = "".join(map(re.escape, sorted(letters)))
        return re.compile(f"{SPACE}*[{letter}]+|{SPACE}*[^{letter}{SPACE}\n]+|{SPACE}+|\n")

    def merge(self, text: str) -> int:
        """Number of tokens of one stretch."""
        rank, n = self.rank, len(text)
        symbol = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(text[i:i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            left = symbol[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(symbol[j]) != size:
                continue  # one side has been merged meanwhile
            left = symbol[i] = left + symbol[j]
            symbol[j] = None
            merges += 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                r = rank.get(left + symbol[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, size + len(symbol[j])))
            j = before[i]
            if j >= 0:
                r = rank.get(symbol[j] + left)
                if r is not None:
                    heapq.heappush(heap, (r, j, size + len(symbol[j])))
        initial = n
        i = 0
        while i < n:
            if symbol[i] not in rank:  # only a single character can be without a piece
                initial += len(symbol[i].encode("utf-8")) - 1
            i = after[i]
        return initial - merges

    def count(self, text: str) -> int:
        if not text:
            return 0
        cache = self.cache
        found = self.stretches.findall(SPACE + text.replace(" ", SPACE))
        if max(map(len, found)) <= CACHED_LENGTH:
            return sum(map(cache.__getitem__, found))
        return sum(cache[s] if len(s) <= CACHED_LENGTH else self.merge(s) for s in found)


_MERGERS: dict[str, PieceMerger] = {}  # one per Python worker and vocabulary


def merger(model_file: str) -> PieceMerger:
    if model_file not in _MERGERS:
        _MERGERS[model_file] = PieceMerger(model_file)
    return _MERGERS[model_file]


def count_tokens(df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row; map-only, ``model_file`` lies on every host."""
    out = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                     ("over_limit", pa.bool_())])

    def run(batches):
        count = merger(model_file).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens = [count(t) if t else 0 for t in texts]
            yield batch_of(out, [batch.column(0), [len(t.encode("utf-8")) if t else 0 for t in texts],
                                 tokens, [n > limit for n in tokens]])

    return (df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
            .mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean"))
