"""Line deduplication: repeated passages of lines, wherever they stand.

``dedup_passages``, used by the queries, goes from content-defined chunks to the passages around them. Lines without any
letter or digit belong to the line before them; such a unit is what chunks are made of. A rolling hash over ``WINDOW``
consecutive units ends a chunk where its value is 0 modulo ``MODULUS`` and the value before is not, so a chunk has two
units or more, and units put in or taken out move no boundary further on. A chunk of at least ``MIN_LINES`` lines that
occurs before, in a document with a smaller id or earlier in the same one, is removed with its units; equal hashes
are compared byte by byte.

What repeats but holds no whole chunk, or goes beyond one, is found by windows: a unit and the next line, or a
unit of several lines, in all places that do not lie inside a removed chunk. A window that
occurs before is removed with its units. So a passage
of at least two lines goes whole, whatever stands around it, and each line text stays at least once. Where a
window overlaps its own first occurrence, as in a line said three times, it stays. Lines without letter or digit
at the start of a text stay, unless nothing else is left: such a text becomes empty.

``dedup_lines`` works on content-defined chunks, and finds only repeats that hold whole chunks. Each line is hashed.
A rolling hash over ``WINDOW`` consecutive line hashes decides after which lines a chunk ends: where its value is 0
modulo ``MODULUS``. A boundary depends on the lines just before it only, so lines put in or taken out move no
boundary further on. A document's end closes its last chunk. A chunk of at least ``MIN_LINES`` lines that occurs
before is removed with its lines. A chunk without any letter or digit is never removed.

Windows and chunks meet by a 64-bit hash first, which needs no text in the shuffle. Only those whose hash repeats are
then compared, chunks by their bytes, windows by their SHA-256, since each line lies in two of them: one is removed
only if it equals its first occurrence. Both steps combine on the map side, so a text with very many copies is
gathered nowhere.

The other lines of a document stay in order; one that loses all its lines gets the empty text. Null texts stay
null, empty ones empty. A null id comes before all others. Rows with the same id and text are treated alike, as
one document.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 2
MODULUS = 2
MIN_LINES = 2
CONTENT = r"[\p{L}\p{N}]"
UNIT_BREAK = r"\n(?=[^\n\p{L}\p{N}]*+[\p{L}\p{N}])"


def chunk_ends(line_hashes: Column) -> Column:
    """Numbers of lines up to each chunk end, the last line always one."""
    def end(h: Column, i: Column) -> Column:
        rolled = h
        for k in range(1, WINDOW):
            rolled = F.xxhash64(F.get(line_hashes, i - k), rolled)
        return F.when((i >= WINDOW - 1) & (F.pmod(rolled, F.lit(MODULUS)) == 0), i + 1)
    inner = F.filter(F.transform(line_hashes, end), lambda x: x.isNotNull())
    return F.array_union(inner, F.array(F.size(line_hashes)))


def with_chunks(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_chunks array<string>``: the chunks of the text in order, without the break behind each."""
    starts = F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.size("_ends") - 1))
    return (df.withColumn("_lines", F.split(F.col(text_col), "\n", -1))
            .withColumn("_ends", chunk_ends(F.transform("_lines", lambda x: F.xxhash64(x))))
            .withColumn("_chunks", F.transform(
                F.arrays_zip(starts.alias("a"), F.col("_ends").alias("b")),
                lambda x: F.array_join(F.slice("_lines", x["a"] + 1, x["b"] - x["a"]), "\n")))
            .drop("_lines", "_ends"))


def n_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def removable(chunk: Column) -> Column:
    """Long enough, and not of blanks and signs only."""
    return (n_lines(chunk) >= MIN_LINES) & chunk.rlike(CONTENT)


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.withColumn("_key", F.struct(F.col(id_col).cast("long").alias("id"),
                                          F.xxhash64(F.col(text_col).cast("string")).alias("h")))


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_key struct<id, h>, _places array<int>)``: the chunks to remove from each document."""
    docs = with_chunks(_keyed(df, id_col, text_col).select("_key", F.col(text_col).cast("string").alias("text")),
                       "text").select("_key", "_chunks")
    slim = (docs.select("_key", F.posexplode(F.transform(
        "_chunks", lambda c: F.when(removable(c), F.xxhash64(c)))).alias("place", "h"))
        .where(F.col("h").isNotNull()))
    return (_repeats(docs, slim, lambda place: F.get("_chunks", place))
            .groupBy("_key").agg(F.collect_set("place").alias("_places")))


def _repeats(docs: DataFrame, slim: DataFrame, text_at: Callable[[Column], Column], overlap: int = 0,
             without: DataFrame | None = None) -> DataFrame:
    """``(_key, place)``: the places whose text occurs before, but not ``overlap`` places before in the same
    document. ``slim`` holds ``(_key, place, h)``; rows that share ``without``'s columns are left out."""
    repeated = slim.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    suspects = slim.join(repeated, "h", "left_semi")
    if without is not None:
        suspects = suspects.join(without, without.columns, "left_anti")
    suspects = suspects.groupBy("_key").agg(F.collect_set("place").alias("_suspects"))
    texts = (docs.join(suspects, "_key").select("_key", F.explode("_suspects").alias("place"), *docs.columns[1:])
             .select("_key", "place", text_at(F.col("place")).alias("chunk")))
    first = texts.groupBy("chunk").agg(F.min(F.struct("_key.id", "place", "_key.h")).alias("first"))
    at = lambda place: F.struct("_key.id", place.alias("place"), "_key.h").eqNullSafe(F.col("first"))
    return (texts.join(first, "chunk")
            .where(~at(F.col("place")) & ~at(F.col("place") - overlap)).select("_key", "place"))


def with_units(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_units array<string>``: each line with the lines without letter or digit behind it."""
    return df.withColumn("_units", F.split(F.col(text_col), UNIT_BREAK, -1))


def _next_line(i: Column) -> Column:
    return F.substring_index(F.get("_units", i + 1), "\n", 1)


def _chunked(docs: DataFrame) -> DataFrame:
    """Adds ``_spans array<struct<a, b>>`` to rows with ``_units``: chunks as numbers of units, ``b`` not included; none but
    the last has a single unit."""
    def marked(_, i: Column) -> Column:
        rolled = F.xxhash64(*[F.get("_units", i - k) for k in reversed(range(WINDOW))])
        return (i >= WINDOW - 1) & (F.pmod(rolled, F.lit(MODULUS)) == 0)

    def end(mark: Column, i: Column) -> Column:
        return F.when(mark & ~F.coalesce(F.get("_marks", i - 1), F.lit(False)), i + 1)
    inner = F.filter(F.transform("_marks", end), lambda x: x.isNotNull())
    return (docs.withColumn("_marks", F.transform("_units", marked))
            .withColumn("_ends", F.array_union(inner, F.array(F.size("_marks"))))
            .withColumn("_spans", F.arrays_zip(
                F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.size("_ends") - 1)).alias("a"), F.col("_ends").alias("b")))
            .drop("_marks", "_ends"))


def _solid(i: Column) -> Column:
    return (i > 0) | F.get("_units", i).rlike(CONTENT)


def _units_text(a: Column, n: Column) -> Column:
    return F.array_join(F.slice("_units", a + 1, n), "\n")


def chunk_removals(docs: DataFrame) -> DataFrame:
    """``(_key, a, b)``: the chunks that occur before, of rows ``(_key, _units)``."""
    def slim_row(c: Column) -> Column:
        several = (c["b"] - c["a"] >= MIN_LINES) | F.get("_units", c["a"]).contains("\n")
        return F.struct((F.shiftleft(c["a"].cast("long"), 32) + c["b"]).alias("place"),
                        F.when(several & _solid(c["a"]), F.xxhash64(F.slice("_units", c["a"] + 1, c["b"] - c["a"]))).alias("h"))
    slim = (_chunked(docs).select("_key", F.inline(F.transform("_spans", slim_row))).where(F.col("h").isNotNull()))
    first = lambda place: F.shiftright(place, 32).cast("int")
    last = lambda place: place.bitwiseAND((1 << 32) - 1).cast("int")
    found = _repeats(docs, slim, lambda place: _units_text(first(place), last(place) - first(place)))
    return found.select("_key", first(F.col("place")).alias("a"), last(F.col("place")).alias("b"))


def window_removals(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(_key, a, b)``: the units of windows that occur before; windows inside the removed ``chunks`` are left out, as
    each occurs in the first occurrence of its chunk."""
    def windows(c: Column) -> Column:
        return F.flatten(F.transform(F.sequence(c["a"], c["b"] - 1), lambda i: F.array(
            F.struct((2 * i).alias("place"), F.when(_solid(i) & (i < F.size("_units") - 1),
                                                    F.xxhash64(F.get("_units", i), _next_line(i))).alias("h"),
                     F.when(i + 1 < c["b"], c["a"]).otherwise(-1).alias("chunk")),
            F.struct((2 * i + 1).alias("place"), F.when(_solid(i) & F.get("_units", i).contains("\n"),
                                                        F.xxhash64(F.get("_units", i))).alias("h"), c["a"].alias("chunk")))))
    slim = (_chunked(docs).select("_key", F.inline(F.flatten(F.transform("_spans", windows)))).where(F.col("h").isNotNull()))

    def text_at(place: Column) -> Column:
        i = F.shiftright(place, 1)
        unit = F.get("_units", i)
        window = F.when(place % 2 == 1, unit).otherwise(F.concat(unit, F.lit("\n"), _next_line(i)))
        return F.unhex(F.sha2(window.cast("binary"), 256))
    i = F.shiftright("place", 1)
    return _repeats(docs, slim, text_at, overlap=2, without=chunks.select("_key", F.col("a").alias("chunk"))).select(
        "_key", i.alias("a"), F.when(F.col("place") % 2 == 1, i + 1).otherwise(i + 2).alias("b"))


def passage_removals(docs: DataFrame) -> DataFrame:
    """``(_key, _removed array<struct<a, b>>)``: the units to remove from documents ``(_key, _units)``, ``b`` not included."""
    chunks = chunk_removals(docs).repartition("_key")
    return (chunks.unionByName(window_removals(docs, chunks))
            .groupBy("_key").agg(F.collect_set(F.struct("a", "b")).alias("_removed")))


def cut_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row struct of the other columns of df, text, removed_chunks, removed_lines long)``: what is left of each text, and
    how many stretches of units and lines went. The other columns are packed, so no name of theirs can clash."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("row"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    keyed = _keyed(packed, "id", "text")
    # the one shuffle of texts: chunks, windows and the cut all read it
    docs = with_units(keyed, "text").select("_key", "_units").repartition("_key")
    joined = (docs.groupBy("_key").agg(F.first("_units").alias("_units")).join(passage_removals(docs), "_key", "left")
              .withColumn("text", F.array_join("_units", "\n")))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("_removed", lambda r: F.sequence(r["a"], r["b"] - 1)))))
    changed = F.col("_removed").isNotNull()
    kept = F.array_except(F.sequence(F.lit(0), F.size("_units") - 1), "_gone")
    left = F.array_join(F.transform(kept, lambda i: F.get("_units", i)), "\n")
    cut = (joined.withColumn("_gone", gone)
           .withColumn("_left", F.when(changed, left))
           .withColumn("_left", F.when(F.col("_left").rlike(CONTENT), F.col("_left")).otherwise(""))
           .select("_key", F.when(changed, F.col("_left")).otherwise(F.col("text")).alias("text"),
                   F.when(changed, F.size(F.filter("_gone", lambda g, i: (i == 0) | (F.get("_gone", i - 1) < g - 1))))
                   .otherwise(0).cast("long").alias("removed_chunks"),
                   F.when(changed, n_lines(F.col("text")) - F.when(F.col("_left") == "", 0).otherwise(
                       n_lines(F.col("_left")))).otherwise(0).cast("long").alias("removed_lines")))
    return keyed.select("_key", "row").join(cut, "_key").drop("_key")


def dedup_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df``, the text without repeated passages, and ``_removed_chunks`` (stretches of units),
    ``_removed_lines`` (long), which say how much went and stand for columns of ``df`` so named."""
    counts = {"_removed_chunks": F.col("removed_chunks"), "_removed_lines": F.col("removed_lines")}
    cut = cut_passages(df, id_col, text_col)
    return cut.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in df.columns if c not in counts],
                      *[v.alias(c) for c, v in counts.items()])


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df``, the text without repeated chunks, and ``_removed_chunks``,
    ``_removed_lines`` (long), which say how much went."""
    keyed = _keyed(df, id_col, text_col)
    joined = keyed.join(removals(df, id_col, text_col), "_key", "left")
    gone = lambda c, i: F.coalesce(F.array_contains("_places", i), F.lit(False))
    left = F.filter("_chunks", lambda c, i: ~gone(c, i))
    went = F.filter("_chunks", gone)
    changed = F.col("_places").isNotNull()
    return (with_chunks(joined, text_col)
            .withColumn(text_col, F.when(changed, F.array_join(left, "\n")).otherwise(F.col(text_col)))
            .withColumn("_removed_chunks", F.when(changed, F.size("_places")).otherwise(0).cast("long"))
            .withColumn("_removed_lines", F.when(changed, F.aggregate(
                went, F.lit(0), lambda n, c: n + n_lines(c))).otherwise(0).cast("long"))
            .drop("_key", "_places", "_chunks"))
