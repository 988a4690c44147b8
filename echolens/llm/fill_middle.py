"""Fill-in-the-middle: texts cut in three at token boundaries and put together in another order.

A text's tokens are runs of ASCII letters and single other characters. A cut is drawn as a rank, the number of tokens
before it, and has to become an offset. The offsets of all boundaries are kept in a learned index: a greedy cone
fits straight segments of offset over rank, each through its first boundary and at most ``ERROR`` characters off any
other one; what a segment misses is stored as one signed byte per boundary. A lookup finds the segment of a rank by
binary search, predicts the offset and corrects it exactly. A text is gone through in blocks, so what is held beside it
is a byte per token and three numbers per segment.

Which cuts and which form a document gets hangs on its id and the seed alone. Map-only: each row is worked on where it
is read, however rows and ids are spread.

One row per input row. A null text counts as empty, an empty one and one that holds a marker stay plain; a null id is
hashed as an empty string; rows with equal ids get equal draws. Other columns are left out, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.tables import batch_of
from echolens.llm.words import parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE, SEED = 90, 20, 1  # percent of texts transformed, and of those in suffix-first form
ERROR = 100
BLOCK = 1 << 20
GALLOP = 64


class RankIndex:
    """Ascending offsets by rank, from blocks given to ``add``."""

    def __init__(self):
        self.n = 0
        self.ranks, self.bases, self.slopes, self.residuals = [], [], [], []

    def add(self, offsets: np.ndarray) -> None:
        """Offsets of the next ranks; a block's end closes its last segment."""
        at = 0
        while at < len(offsets):
            end, slope = segment(offsets, at)
            line = offsets[at] + np.rint(slope * np.arange(end - at)).astype(np.int64)
            self.ranks.append(self.n + at)
            self.bases.append(int(offsets[at]))
            self.slopes.append(slope)
            self.residuals.append((offsets[at:end] - line).astype(np.int8))
            at = end
        self.n += len(offsets)

    def offset(self, rank: int) -> int:
        k = int(np.searchsorted(self.ranks, rank, "right")) - 1
        steps = rank - self.ranks[k]
        return self.bases[k] + int(np.rint(self.slopes[k] * steps)) + int(self.residuals[k][steps])


def segment(offsets: np.ndarray, at: int) -> tuple[int, float]:
    """End and slope of the longest stretch from ``at`` that one line through its first point meets within ``ERROR``.

    The slopes still possible are a cone that each point narrows; the stretch ends where the cone is empty. Points are
    taken in doubling blocks.
    """
    low, high, end, n = -np.inf, np.inf, at + 1, GALLOP
    while end < len(offsets):
        stop = min(end + n, len(offsets))
        steps, rise = np.arange(end - at, stop - at), offsets[end:stop] - offsets[at]
        lows = np.maximum(np.maximum.accumulate((rise - ERROR) / steps), low)
        highs = np.minimum(np.minimum.accumulate((rise + ERROR) / steps), high)
        empty = lows > highs
        if empty.any():
            k = int(empty.argmax())
            if k:
                low, high = lows[k - 1], highs[k - 1]
            end += k
            break
        low, high, end, n = lows[-1], highs[-1], stop, 2 * n
    return end, 0.0 if end == at + 1 else float(low + high) / 2


def index_of(text: str) -> RankIndex:
    """The boundaries of all tokens of a text, its end included."""
    index, letter_before = RankIndex(), False
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        small = points | 32
        letter = (small >= 97) & (small <= 122) & (points < 128)
        inside = letter & np.concatenate(([letter_before], letter[:-1]))
        index.add(np.flatnonzero(~inside) + at)
        letter_before = bool(letter[-1])
    index.add(np.array([len(text)]))
    return index


def arranged(text: str, draws: list[int], rate: int, spm_rate: int) -> tuple:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    index = index_of(text)
    n = index.n - 1
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (index.offset(r) for r in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
              spm_rate: int = SPM_RATE) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` of every row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
                     draws.alias("_draws"))
    out = pa.schema([(id_col, pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches):
        for part in parts(batches):
            found = [arranged(t or "", d, rate, spm_rate)
                     for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield batch_of(out, [part.column(0), *zip(*found)])

    return rows.mapInArrow(
        run, f"`{id_col}` long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of. No marker begins inside another one, so each is found where it was put."""
    def halves(between: str):
        rest = F.substr(output, F.lit(4))
        first = F.substring_index(rest, between, 1)
        rest = F.substr(rest, F.length(first) + 4)
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substr(rest, F.length(second) + 4)

    prefix, suffix, middle = halves(SUFFIX)
    suffix_2, prefix_2, middle_2 = halves(PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
             .when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output))
