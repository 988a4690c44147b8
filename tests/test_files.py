import hashlib
import random

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from echolens.sources import files

SCHEMA = "msg_id bigint, author string, text string"


def test_csv_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'msg_id,author,text\n1,ann,"two\nlines, ""quoted"""\n2,bob\n3,eve,ok,extra\n4,,é\n',
        encoding="utf-8")
    got = files.read_messages_csv(spark, str(tmp_path), SCHEMA).orderBy("msg_id").collect()
    assert [tuple(r) for r in got] == [(1, "ann", 'two\nlines, "quoted"'), (2, "bob", None),
                                       (4, None, "é")]


def plain_csv(spark, path):
    """As the source reads a file whole."""
    wide = SCHEMA + ", _overflow string"
    return (spark.read.schema(wide).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
            .where("_overflow is null").drop("_overflow"))


def odd_csv(n, seed=1):
    rng, lines = random.Random(seed), ["msg_id,author,text"]
    for i in range(n):
        field = "".join(rng.choice(["a", "é", " ", ",", '""', "\n", "\n\n", "line\n", "\\"]) for _ in range(rng.randint(0, 30)))
        lines.append(rng.choice([f'{i},bob,"{field}"', f'{i},"{field}","{field}"', f"{i},ann,plain", f"{i},short", "",
                                 f"{i},a,b,too,many", f'{i},"","q""uote"']))
    return "\n".join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("split", ["60b", "500b", "3k", "1m"])
def test_one_file_by_several_tasks(spark, tmp_path, split):
    (tmp_path / "a.csv").write_text(odd_csv(400), encoding="utf-8")
    (tmp_path / "b.csv").write_text(odd_csv(90, 2), encoding="utf-8")
    (tmp_path / "c.csv").write_text("msg_id,author,text", encoding="utf-8")
    (tmp_path / "d.csv").write_text('msg_id,author,text\n1,x,"' + "long\n" * 700 + '"\n2,y,z', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    expected = sorted(map(str, plain_csv(spark, str(tmp_path)).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = sorted(map(str, files.read_messages_csv(spark, str(tmp_path), SCHEMA).collect()))
        tasks = files.csv_lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == expected and len(got) > 300
    assert tasks > 4 or split == "1m"


def test_line_ends_of_two_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'msg_id,author,text\r\n1,a,"x\r\ny"\r\n\r\n2,b,\xe9\r\n')
    got = files.read_messages_csv(spark, str(tmp_path), SCHEMA, "ISO-8859-1").orderBy("msg_id").collect()
    assert [tuple(r) for r in got] == [(1, "a", "x\r\ny"), (2, "b", "é")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "empty.csv").write_bytes(b"")
    assert files.read_messages_csv(spark, str(tmp_path / "e"), SCHEMA).count() == 0


def test_encoding_of_a_text_in_several_files(spark, tmp_path):
    for lang, contents in {"fr": [b"plain", "été".encode("latin-1")], "en": [b"plain", b"too"],
                           "de": ["ü".encode(), "€ ü".encode("cp1252")]}.items():
        (tmp_path / f"lang={lang}").mkdir()
        for k, content in enumerate(contents):
            (tmp_path / f"lang={lang}" / f"part-{k}.csv").write_bytes(content)
    found = {r.path.rsplit("=", 1)[1]: r.encoding
             for r in files.detect_encoding(spark, str(tmp_path), by_folder=True).collect()}
    assert found == {"fr": "ISO-8859-1", "en": "UTF-8", "de": "windows-1252"}


def test_encodings(spark, tmp_path):
    (tmp_path / "utf8.csv").write_bytes("msg_id,author,text\n1,a,été\n".encode())
    (tmp_path / "bom.csv").write_bytes("msg_id,author,text\n1,a,été\n".encode("utf-8-sig"))
    (tmp_path / "latin.csv").write_bytes("msg_id,author,text\n1,a,été\n".encode("latin-1"))
    (tmp_path / "windows.csv").write_bytes("msg_id,author,text\n1,a,été\n2,b,l’œuvre à 5 €\n".encode("cp1252"))
    found = {r.path.rsplit("/", 1)[1]: r.encoding
             for r in files.detect_encoding(spark, str(tmp_path)).collect()}
    assert found == {"utf8.csv": "UTF-8", "bom.csv": "UTF-8", "latin.csv": "ISO-8859-1",
                     "windows.csv": "windows-1252"}
    windows = files.read_messages_csv(spark, str(tmp_path / "windows.csv"), SCHEMA, "windows-1252").orderBy("msg_id")
    assert [r.text for r in windows.collect()] == ["été", "l’œuvre à 5 €"]
    for name, encoding in found.items():
        r = files.read_messages_csv(spark, str(tmp_path / name), SCHEMA, encoding).first()
        assert tuple(r) == (1, "a", "été")


def test_round_trip_keeps_odd_values(spark, tmp_path):
    data = [(1, " a ", 'x"y\n,z'), (2, "b", None), (3, None, "back\\slash"), (4, "é", "\\")]
    df = spark.createDataFrame(data, SCHEMA)
    files.write_messages_csv(df, str(tmp_path / "out"))
    got = files.read_messages_csv(spark, str(tmp_path / "out"), SCHEMA).orderBy("msg_id")
    assert [tuple(r) for r in got.collect()] == data


def test_file_checks_and_manifest(spark, tmp_path):
    for name, size in (("a +é.csv", 10), ("b.csv", 0), ("c.exe", 5), ("d.xls", 5), ("e.json", 2000)):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    listed = files.list_files(spark, str(tmp_path / "in"))
    got = {r.name: (r.valid, r.reason, r.warnings)
           for r in files.check_files(listed, max_bytes=1000).collect()}
    assert got == {"a +é.csv": (True, None, ""), "b.csv": (False, "empty", None),
                   "c.exe": (False, "unsupported format", None),
                   "d.xls": (True, None, "old spreadsheet format"),
                   "e.json": (False, "too large", None)}
    for _ in range(2):
        files.append_manifest(listed, str(tmp_path / "log"), "2024-01-01", "test")
    assert spark.read.json(str(tmp_path / "log")).count() == 10
    hashes = {r.path.rsplit("/", 1)[1]: r.md5
              for r in files.file_hashes(spark, str(tmp_path / "in")).collect()}
    assert hashes["b.csv"] == "d41d8cd98f00b204e9800998ecf8427e"


def test_hashes_of_files_longer_than_the_source_reads(spark, tmp_path):
    contents = {"a +%é.csv": b"x" * 5000, "b.csv": b"", "c.csv": b"y" * 100, "d.csv": bytes(range(256)) * 9}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set(files.LONGEST_CONTENT, "100")
    try:
        found = files.file_hashes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(files.LONGEST_CONTENT)
    assert ({r.path.rsplit("/", 1)[1]: r.md5 for r in found}
            == {name: hashlib.md5(content).hexdigest() for name, content in contents.items()})


def test_longer_files_are_never_one_value(spark, tmp_path):
    contents = {"long.csv": b"x" * (files.PIECE + 1), "piece.csv": b"z" * files.PIECE, "short.csv": b"y", "empty.csv": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    hashed = files.file_hashes(spark, str(tmp_path))
    spark.conf.set(files.LONGEST_CONTENT, files.PIECE)  # from now on the source refuses longer values
    try:
        found = hashed.collect()
    finally:
        spark.conf.unset(files.LONGEST_CONTENT)
    assert ({r.path.rsplit("/", 1)[1]: r.md5 for r in found}
            == {name: hashlib.md5(content).hexdigest() for name, content in contents.items()})


def test_hashes_in_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 100)
    contents = {"a +%é.csv": b"x" * 5000, "b.csv": b"", "c.csv": b"y" * 100}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    link = "fs.viewfs.mounttable.hashes.link./in"
    spark.conf.set(link, f"file://{tmp_path}")
    try:
        found = files.file_hashes(spark, "viewfs://hashes/in").collect()
    finally:
        spark.conf.unset(link)
    assert ({r.path.rsplit("/", 1)[1]: r.md5 for r in found}
            == {name: hashlib.md5(content).hexdigest() for name, content in contents.items()})


def test_odd_names_in_a_store(tmp_path, monkeypatch):
    (tmp_path / "a b%20?#+é.csv").write_bytes(b"odd")
    monkeypatch.setattr(files, "place", lambda uri: pyarrow.fs.FileSystem.from_uri(uri.replace("store://bucket", "file://")))
    with files._opened(f"store://bucket{tmp_path}/a b%20?#+é.csv") as file:
        assert file.read() == b"odd"


def test_report_json(spark, tmp_path):
    report = spark.range(1).select(F.lit(3).alias("n"), F.create_map(F.lit("a"), F.lit(1))
                                   .alias("m"))
    files.export_report_json(report, str(tmp_path / "r"))
    r = spark.read.schema(report.schema).json(str(tmp_path / "r")).first()
    assert (r.n, r.m) == (3, {"a": 1})
