"""WARC archives and a two-level capture index.

Archives. Every page becomes a record, a gzip member of its own. Of records with equal payloads, compared by SHA-1 and
length, the one with the largest page id is the response; the others are revisits without
payload that name it. Records are written by Spark's text writer, which reaches any store Spark reaches; one NUL
byte, padding that gzip readers skip, ends a member. A file holds at most ``RECORDS_PER_FILE`` records and may be of any
size, as no file is ever loaded whole. Tasks open archives through Arrow's file systems (local and mounted paths, HDFS, S3, GCS).

Index. Archives are read in pieces of ``PIECE`` bytes for (key, file, offset, length). The key is the URL with its host reversed, so
captures of a site are neighbours. Captures are sorted by key, by ranges, and every ``BLOCK`` of them is one compressed
block; the sparse directory holds the first key of each block.

Lookup. A binary search in the directory names the blocks that can hold a key; only these are unpacked,
and what they say is read from the archives by offset and length; ranges that touch are read at once. The directory is searched in slices of ``SLICE`` entries,
so what goes to the tasks at once is bounded whatever the number of captures.

One record per input row. A null html is an empty payload; a null url is the key ``-``. A null page id comes before
all others; repeated rows of the responding page are all responses. Line breaks and blanks in a URL are percent-encoded in headers.
"""

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from itertools import groupby
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm.tables import batch_of, written
from echolens.sources.shared import place as _place
from echolens.sources.shared import shared_folder

RECORDS_PER_FILE = 4000
BLOCK = 1000
SLICE = 200_000
PIECE = 1 << 18
READ_AT_ONCE = 8 << 20
BYTES_PER_TASK = 32 << 20
PADDING = "\0"
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture


def plain_url(url: str) -> str:
    """Blanks, control characters and all beyond ASCII percent-encoded; once done, it changes nothing."""
    return quote(url, safe="".join(map(chr, range(33, 127))))


def surt(url: str | None) -> str:
    """Reversed host, then path and query: ``http://www.ex.org/a?b`` gives ``org,ex,www)/a?b``."""
    if not url:
        return "-"
    url = plain_url(url)
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/")
    return key + ("?" + parts.query if parts.query else "") + ("#" + parts.fragment if parts.fragment else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str):
    found = name[len("<urn:page:"):-1]
    return int(found) if found else None


def record(page_id, url, payload: bytes, digest: str, response_id) -> bytes:
    """The gzip member of one record."""
    revisit = page_id != response_id
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
            % len(payload))
    block = http if revisit else http + payload
    head = ["WARC/1.1", "WARC-Type: " + ("revisit" if revisit else "response"),
            f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + plain_url(url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_name(response_id)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(block)}"]
    whole = "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def _headers(head: bytes) -> dict:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}


def parse(member: bytes) -> dict:
    """Headers of a record, lower-cased, with its HTTP payload size and, for responses, payload."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    found = _headers(head)
    http, _, payload = rest[:int(found["content-length"])].partition(b"\r\n\r\n")
    for x in http.decode("latin-1").split("\r\n")[1:]:
        name, _, value = x.partition(": ")
        found["http-" + name.lower()] = value
    found["payload"] = payload
    return found


def members(stream):
    """``(offset, length, headers)`` of the gzip members of an archive, which is read piece by piece."""
    held, at = b"", 0  # what was read and not used, and its offset
    while True:
        record = held.lstrip(PADDING.encode())
        at += len(held) - len(record)
        held = record or stream.read(PIECE)
        if not held:
            return
        if not record:
            continue
        reader, begin, head = zlib.decompressobj(31), at, b""
        while not reader.eof:
            held = held or stream.read(PIECE)
            if not held:
                raise ValueError("an archive ends within a record")
            text = reader.decompress(held)
            if b"\r\n\r\n" not in head:
                head += text
            at += len(held) - len(reader.unused_data)
            held = reader.unused_data
        yield begin, at - begin, _headers(head.partition(b"\r\n\r\n")[0])


def read_ranges(file, ranges):
    """Bytes of sorted ``(offset, length)``; those that touch, but for padding, are one read."""
    run = []
    for offset, length in [*ranges, (None, 0)]:
        if run and (offset is None or not 0 <= offset - sum(run[-1]) <= len(PADDING)
                    or offset + length - run[0][0] > READ_AT_ONCE):
            start = run[0][0]
            whole = file.read_at(sum(run[-1]) - start, start)
            yield from (whole[o - start:o - start + n] for o, n in run)
            run = []
        run.append((offset, length))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write ``(page_id, url, html)`` as archives; payloads are shuffled once, to meet their response."""
    slim = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                      ("digest", pa.string())])

    def digested(batches):
        for batch in batches:
            payloads = [p or b"" for p in batch.column(2).to_pylist()]
            yield batch_of(slim, [batch.column(0), batch.column(1), payloads, map(base32_sha1, payloads)])

    rows = (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                         F.col("html").cast("string").cast("binary"))
            .mapInArrow(digested, "page_id long, url string, payload binary, digest string"))
    same = ["digest", "n_bytes"]
    rows = rows.withColumn("n_bytes", F.octet_length("payload"))
    best = rows.select("page_id", *same).groupBy(*same).agg(F.max("page_id").alias("response_id"))

    def records(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(
                [record(*r) for r in zip(*(c.to_pylist() for c in batch.columns))], pa.binary())], ["record"])

    (rows.join(best, same).select("page_id", "url", "payload", "digest", "response_id")
     .mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", PADDING).option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """``(block, first_key, captures, data)``: compressed blocks of the sorted captures of all archives."""
    found = pa.schema([("key", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def scan(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _place(path)
                rows = []
                with fs.open_input_stream(name) as stream:
                    for offset, length, headers in members(stream):
                        rows.append((surt(headers.get("warc-target-uri")), path, offset, length))
                        if len(rows) == RECORDS_PER_FILE:
                            yield batch_of(found, list(zip(*rows)))
                            rows = []
                if rows:
                    yield batch_of(found, list(zip(*rows)))

    packed = pa.schema([("first_key", pa.string()), ("captures", pa.int64()), ("data", pa.binary())])

    def pack(batches):
        def block(lines):
            text = "\n".join(f"{k}\t{p}\t{o}\t{n}" for k, p, o, n in lines)
            return batch_of(packed, [[lines[0][0]], [len(lines)], [zlib.compress(text.encode("utf-8"))]])
        held = []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield block(held)

    # contents are not selected, so Spark lists the files and deals them by size
    files = spark.read.format("binaryFile").load(folder).select("path")
    captures = written(files.mapInArrow(scan, "key string, path string, offset long, length long"),
                       "captures")
    order = ["key", "path", "offset"]  # unique, so one URL with very many captures spans many blocks
    return written(captures.repartitionByRange(*order).sortWithinPartitions(*order)
                   .mapInArrow(pack, "first_key string, captures long, data binary")
                   .withColumn("block", F.monotonically_increasing_id()), "blocks")


def _slices(blocks: DataFrame):
    """Bounded, sorted slices of the directory, each with the first key behind it."""
    held = []
    for row in blocks.select("first_key", "block").orderBy("first_key", "block").toLocalIterator():
        if len(held) == SLICE:
            yield held, row[0]
            held = held[-1:]  # its block may reach into the next slice's first key
        held.append((row[0], row[1]))
    if held:
        yield held, None


def lookup(blocks: DataFrame, urls: DataFrame) -> DataFrame:
    """``(key, path, offset, length)`` of all captures of the URLs in column ``url``."""
    keys = written(urls.select("url").mapInArrow(
        lambda batches: (batch_of(pa.schema([("key", pa.string())]), [map(surt, b.column(0).to_pylist())])
                         for b in batches), "key string").distinct(), "keys")
    named = None
    for entries, behind in _slices(blocks):
        firsts, numbers = [e[0] for e in entries], [e[1] for e in entries]

        def search(batches, firsts=firsts, numbers=numbers):
            for batch in batches:
                hit = set()
                for key in batch.column(0).to_pylist():
                    # from the last block that starts before the key to the last that starts with it
                    hit.update(numbers[max(bisect_left(firsts, key) - 1, 0):bisect_right(firsts, key)])
                yield batch_of(pa.schema([("block", pa.int64())]), [sorted(hit)])

        mine = keys.where(F.col("key") >= firsts[0])
        if behind is not None:
            mine = mine.where(F.col("key") <= behind)
        part = mine.mapInArrow(search, "block long").distinct()
        named = part if named is None else written(named.unionByName(part).distinct(), "named")
    out = "key string, path string, offset long, length long"
    if named is None:
        return urls.sparkSession.createDataFrame([], out)

    def unpack(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                lines = [x.split("\t") for x in zlib.decompress(data).decode("utf-8").split("\n")]
                yield batch_of(pa.schema([("key", pa.string()), ("path", pa.string()), ("offset", pa.int64()),
                                          ("length", pa.int64())]),
                               [[x[0] for x in lines], [x[1] for x in lines], [int(x[2]) for x in lines],
                                [int(x[3]) for x in lines]])

    return blocks.join(named, "block", "left_semi").select("data").mapInArrow(unpack, out).join(keys, "key", "left_semi")


def read_records(spark: SparkSession, captures: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, payload)`` of captures, by range reads.

    Captures are dealt by file and stretch of the file, some ``BYTES_PER_TASK`` to a task, and read in order of
    offset. The payload of a revisit is null. A response whose payload has another digest than its header says
    is an error.
    """
    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def row(member):
        x = parse(member)
        digest = x["warc-payload-digest"].removeprefix("sha1:")
        response = x["warc-type"] == "response"
        if response and base32_sha1(x["payload"]) != digest:
            raise ValueError(f"record {x['warc-record-id']} is damaged")
        return (_page(x["warc-record-id"]), int(x["http-content-length"]), digest, x["warc-type"],
                None if response else _page(x["warc-refers-to"]), x["payload"] if response else None)

    def fetch(batches):
        for batch in batches:
            wanted = zip(*(c.to_pylist() for c in batch.columns))
            for path, ranges in groupby(wanted, key=lambda r: r[0]):
                fs, name = _place(path)
                with fs.open_input_file(name) as file:
                    rows, size = [], 0
                    for member in read_ranges(file, (r[1:] for r in ranges)):
                        rows.append(row(member))
                        size += len(rows[-1][5] or b"")
                        if size > READ_AT_ONCE:
                            yield batch_of(out, list(zip(*rows)))
                            rows, size = [], 0
                    if rows:
                        yield batch_of(out, list(zip(*rows)))

    captures = written(captures.select("path", "offset", "length"), "wanted")
    size = captures.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // BYTES_PER_TASK))
    return (captures.repartition(tasks, "path", F.floor(F.col("offset") / (BYTES_PER_TASK // 8)))
            .sortWithinPartitions("path", "offset")
            .mapInArrow(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                               "refers_to long, payload binary"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, index the archives, look every URL up and read its records back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder)
    blocks = build_index(spark, folder)
    captures = lookup(blocks, pages.select(F.col("url").cast("string").alias("url")))
    return read_records(spark, captures)
