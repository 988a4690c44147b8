"""File sources and sinks: messages in, classified tables and reports out."""

import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from echolens.sources.shared import place

MESSAGE_SCHEMA = ("msg_id bigint, author string, text string, ts timestamp, url string")
OVERFLOW = "_overflow"

# Accepted extensions and size bounds in bytes.
EXTENSIONS = [".csv", ".xlsx", ".xls", ".json", ".parquet"]
MAX_BYTES = 500 * 1024 * 1024
LARGE_BYTES = 10 * 1024 * 1024

LONGEST_CONTENT = "spark.sql.sources.binaryFile.maxLength"
PIECE = 8 << 20  # bytes of a longer file in memory at once


def decoded(value: Column, encoding: str) -> Column:
    """Text of raw bytes; Windows-1252 is ISO-8859-1 with signs in place of most control characters."""
    if encoding.upper() in ("UTF-8", "US-ASCII"):
        return value
    if encoding.lower() not in ("windows-1252", "cp1252"):
        return F.decode(value.cast("binary"), encoding)
    signs = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    signs = {control: sign for control, sign in signs.items() if sign}
    return F.translate(F.decode(value.cast("binary"), "ISO-8859-1"), "".join(signs), "".join(signs.values()))


def csv_lines(spark: SparkSession, path: str, encoding="UTF-8") -> DataFrame:
    """``(path, block, line, value, quotes)``: the lines of all files as their splits hold them. ``line`` rises
    within a block; blocks are told by their first byte."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"), decoded(F.col("value"), encoding).alias("value"))
            .withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))))


def _numbered(lines: DataFrame) -> DataFrame:
    """Adds ``before``: the quotes of the block's earlier lines."""
    earlier = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))


def csv_blocks(lines: DataFrame) -> DataFrame:
    """``(path, block, inside, records)``: whether a block begins inside quotes (1) or not (0), and how many records
    begin in the blocks before it. One row per split from here on."""
    even = F.col("before") % 2 == 0
    found = (_numbered(lines.drop("value")).groupBy("path", "block")
             .agg(F.sum("quotes").alias("quotes"), F.count_if(even).alias("even"), F.count_if(~even).alias("odd")))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("odd"))
    return (found.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
            .withColumn("records", F.coalesce(F.sum(begun).over(earlier), F.lit(0)))
            .select("path", "block", "inside", "records"))


def csv_records(spark: SparkSession, path: str, encoding="UTF-8") -> DataFrame:
    """``(path, record, value)``: the records of all files, numbered from 1 within a file.

    A quoted field may hold line breaks, so a line begins a record only if the quotes before it are even. The first
    pass sums quotes by block, which tells for each block, by sums over the blocks before it, where it
    begins; the second one numbers the records block by block. Only the lines of records over several lines
    are gathered.
    """
    lines = csv_lines(spark, path, encoding)
    blocks = csv_blocks(lines).withColumnsRenamed({"path": "_path", "block": "_block"})
    so_far = Window.partitionBy("path", "block").orderBy("line")
    begins = (F.col("inside") + F.col("before")) % 2 == 0
    numbered = (_numbered(lines).join(blocks, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
                .withColumn("begins", begins)
                .withColumn("record", F.col("records") + F.sum(F.col("begins").cast("int")).over(so_far)))
    whole = F.col("begins") & (F.col("quotes") % 2 == 0)
    one = numbered.where(whole).select("path", "record", "value")
    several = (numbered.where(~whole).groupBy("path", "record")
               .agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
               .select("path", "record", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
    return one.unionByName(several).withColumn("value", F.regexp_replace("value", "\r\\z", ""))


def read_messages_csv(spark: SparkSession, path: str, schema, encoding="UTF-8") -> DataFrame:
    """Read CSV with a header. Rows with too many fields are skipped, short rows are kept with
    nulls, quoted fields may hold line breaks and doubled quotes.

    One large file is read by as many tasks as it has splits. Quotes must be balanced within a record, as in every
    file that doubles the quotes inside a field, and the encoding must hold ASCII characters as single bytes.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    wide = StructType(schema.fields + [StructField(OVERFLOW, StringType())])
    row = F.from_csv(F.col("value"), wide.toDDL(), {"escape": '"', "multiLine": "true"})
    return (csv_records(spark, path, encoding).where("record > 1 and value != ''").select(row.alias("row"))
            .where(F.col(f"row.{OVERFLOW}").isNull()).select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields]))


def write_messages_csv(df: DataFrame, path: str, encoding="UTF-8") -> None:
    """Write CSV that ``read_messages_csv`` reads back value by value, blanks included; only an
    empty string comes back as null."""
    (df.write.option("header", True).option("escape", '"').option("encoding", encoding)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .csv(path))


def detect_encoding(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """One row per file ``(path, encoding)``: UTF-8 if every line is valid UTF-8, else windows-1252 if a line that
    is not holds a byte from 80 to 9F, which in ISO-8859-1 is a control character, else ISO-8859-1.

    With ``by_folder`` the files of a folder are parts of one text, and ``path`` is the folder.
    Whole files are tested, not a sample, and split over tasks: the text source hands lines over
    as raw bytes. A leading byte-order mark is dropped by the readers, so UTF-8 covers both
    spellings.
    """
    valid = F.is_valid_utf8(F.col("value"))
    signs = F.when(~valid, F.hex(F.col("value").cast("binary")).rlike("^(?:..)*?[89]"))
    file = F.col("_metadata.file_path")
    lines = spark.read.text(path).select((F.regexp_replace(file, "/[^/]*$", "") if by_folder else file).alias("path"),
                                         valid.alias("valid"), signs.alias("signs"))
    return lines.groupBy("path").agg(
        F.when(F.bool_and("valid"), "UTF-8").when(F.bool_or("signs"), "windows-1252")
         .otherwise("ISO-8859-1").alias("encoding"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, modificationTime)`` of every file below ``path``; contents are not read.

    The scan leaves empty files out, so the names come from the listing that the source holds on
    the driver in any case, and a name without metadata has length 0.
    """
    found = _binary_files(spark, path)
    return (_names(found).join(found.select("path", "length", "modificationTime"), "path", "left")
                         .withColumn("length", F.coalesce("length", F.lit(0))))


def _binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _names(found: DataFrame) -> DataFrame:
    names = found.sparkSession.createDataFrame([(p,) for p in found.inputFiles()], "uri string")
    # the listing holds URIs: three slashes on local files, escaped characters
    plain = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    return names.select(F.regexp_replace(plain, "^file:/+", "file:/").alias("path"))


def check_files(files: DataFrame, max_bytes=MAX_BYTES) -> DataFrame:
    """Status, reason and warnings per listed file, from its metadata alone."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    reason = (F.when(F.length(name) == 0, "missing name")
               .when(F.col("length") > max_bytes, "too large")
               .when(F.col("length") == 0, "empty")
               .when(~extension.isin(*EXTENSIONS), "unsupported format"))
    warnings = F.filter(F.array(
        F.when(F.col("length") > LARGE_BYTES, "large file"),
        F.when(extension == ".xls", "old spreadsheet format")), lambda w: w.isNotNull())
    return files.select("path", name.alias("name"), extension.alias("extension"), "length",
                        reason.isNull().alias("valid"), reason.alias("reason"),
                        F.when(reason.isNull(), F.array_join(warnings, "; ")).alias("warnings"))


def append_manifest(files: DataFrame, manifest: str, imported_at: str, source: str) -> None:
    """Append one JSON line per imported file to the audit log."""
    name = F.element_at(F.split("path", "/"), -1)
    mime = (F.when(name.endswith(".csv"), "text/csv").when(name.endswith(".json"),
                                                           "application/json")
             .otherwise("application/octet-stream"))
    (files.select(F.lit(imported_at).alias("timestamp"), name.alias("filename"),
                  F.col("path").alias("saved_path"), F.col("length").alias("size_bytes"),
                  F.lit(source).alias("source_url"), mime.alias("mime_type"))
          .write.mode("append").json(manifest))


def _opened(path):
    """Arrow's file of a path of the binary file source, which does not escape names."""
    store, name = place(path if path.startswith("file:") else quote(path, safe="/:@[]"))
    return store.open_input_file(name)


def _opens(batches):
    """The paths that Arrow can open."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                _opened(path).close()
            except (OSError, ValueError, NotImplementedError):
                continue
            yield pa.RecordBatch.from_pydict({"path": [path]})


def _md5_by_pieces(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            found = hashlib.md5(usedforsecurity=False)
            with _opened(path) as file:
                while piece := file.read(PIECE):
                    found.update(piece)
            yield pa.RecordBatch.from_pydict({"path": [path], "md5": [found.hexdigest()]})


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """md5 of each file's bytes, one task-side read per file: each step of an MD5 needs the state after all bytes before,
    so a file is not divided.

    The binary file source holds a file as one value, and several copies of it on its way, so it reads only files of up
    to ``PIECE`` bytes. Longer ones are read piece by piece through Arrow's file systems (local and mounted paths, HDFS, S3,
    GCS), with as little memory. If Arrow can't open the store, the source reads them too, up to 2 GB
    (``spark.sql.sources.binaryFile.maxLength``), and a task then needs several times its longest file.
    """
    found = _binary_files(spark, path)
    most = min(PIECE, int(spark.conf.get(LONGEST_CONTENT)))
    longer = found.where(F.col("length") > most).select("path")
    if longer.limit(1).mapInArrow(_opens, "path string").isEmpty():  # no longer file, or none that Arrow opens
        hashed = found.select("path", F.md5("content").alias("md5"))
    else:
        hashed = (found.where(F.col("length") <= most).select("path", F.md5("content").alias("md5"))
                  .unionByName(longer.mapInArrow(_md5_by_pieces, "path string, md5 string")))
    return (_names(found).join(hashed, "path", "left")
                         .withColumn("md5", F.coalesce("md5", F.md5(F.lit("")))))


def export_classified(df: DataFrame, path: str, format="csv") -> None:
    if format == "csv":
        write_messages_csv(df, path)
    else:
        df.write.format(format).save(path)


def export_report_json(report: DataFrame, path: str) -> None:
    """Write a report, one row per document, as JSON text."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.text(path)
