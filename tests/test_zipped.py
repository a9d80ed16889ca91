"""Archives as a data source: what is read, what is left unread, what is written."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

from quillwork.sources import archives as A
from quillwork.sources import zipped as Z


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(archive({"word/document.xml": "one", "word/styles.xml": "s", "media/": ""}))
    (tmp_path / "sub" / "b.docx").write_bytes(archive({"word/document.xml": "two"}))
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / "empty.docx").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(b"x")
    return str(tmp_path)


def told(df):
    return sorted((r.doc_id, r.part_uri, bytes(r.content) if r.content is not None else None, r.error is not None) for r in df.collect())


def test_reads_what_the_other_reader_reads(spark, folder):
    Z.register(spark)
    rows = spark.read.format("archives").load(folder)
    key = lambda r: (r[0], r[1] or "", r[2] or b"", r[3])
    got = sorted([(r.doc_id, r.part_uri, bytes(r.content) if r.content is not None else None, r.error is not None) for r in rows.collect()], key=key)
    assert got == sorted([("a.docx", "word/document.xml", b"one", False), ("a.docx", "word/styles.xml", b"s", False), ("a.docx", "media/", None, False), ("sub/b.docx", "word/document.xml", b"two", False), ("broken.docx", None, None, True), ("empty.docx", None, None, True)], key=key)
    # Spark's own reader of files passes over one without bytes
    plain = A.entries(A.archives(spark, folder)).drop("doc_id", "error")
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, rows.where("doc_id <> 'empty.docx'").drop("doc_id", "error").collect()))
    assert [r.entries for r in A.guarded(rows).where("doc_id = 'a.docx'").collect()] == [2]


def test_filters_are_taken_over(spark, folder, capsys):
    Z.register(spark)
    rows = spark.read.format("archives").load(folder)
    one = rows.where("part_uri = 'word/document.xml'")
    assert told(one) == [("a.docx", "word/document.xml", b"one", False), ("sub/b.docx", "word/document.xml", b"two", False)]
    one.explain("formatted")
    assert "PushedFilters: [EqualTo(part_uri,word/document.xml)]" in capsys.readouterr().out
    assert told(rows.where("part_uri in ('word/styles.xml', 'x') and doc_id = 'a.docx'")) == [("a.docx", "word/styles.xml", b"s", False)]
    assert told(rows.where("part_uri like 'word/%' and uncompressed_bytes = 1")) == [("a.docx", "word/styles.xml", b"s", False)]
    assert rows.where("part_uri is null").count() == 2


def test_one_part_of_many_inflates_one(tmp_path, monkeypatch):
    (tmp_path / "big.zip").write_bytes(archive({f"part{i}": "x" * 1000 for i in range(2000)}))
    read, seen = zipfile.ZipFile.read, []
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, e, *a: seen.append(e.filename) or read(self, e, *a))
    reader = Z.ArchiveReader(str(tmp_path), 1 << 20, True)
    left = list(reader.pushFilters([EqualTo(("part_uri",), "part7"), IsNotNull(("part_uri",)), EqualTo(("content",), b"x")]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "EqualTo"]
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert seen == ["part7"] and sum(b.num_rows for b in batches) == 1


def test_files_are_packed_by_size_and_pruned_by_name(tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.zip").write_bytes(archive({"p": "x"}))
    names = lambda r: [[n for n, _ in p.names] for p in r.partitions()]
    assert names(Z.ArchiveReader(str(tmp_path), 1, True)) == [[f"{i}.zip"] for i in range(10)]
    assert len(names(Z.ArchiveReader(str(tmp_path), 128 << 20, True))) == 1
    pruned = Z.ArchiveReader(str(tmp_path), 1, True)
    assert not list(pruned.pushFilters([In(("doc_id",), ("3.zip", "4.zip")), StringStartsWith(("doc_id",), "3")]))
    assert names(pruned) == [["3.zip"]]


def test_directories_alone_and_entries_over_the_limit(spark, folder, tmp_path, monkeypatch):
    Z.register(spark)
    rows = spark.read.format("archives").option("content", "false").load(folder)
    assert rows.where("content is not null").count() == 0 and rows.where("part_uri is not null").count() == 4
    monkeypatch.setattr(Z, "MAX_ENTRY_BYTES", 2)
    reader = Z.ArchiveReader(folder, 1 << 20, True)
    bodies = {r["doc_id"]: (r["content"], r["error"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist() if r["part_uri"] == "word/document.xml"}
    assert set(bodies.values()) == {(None, "entry too large")}


def test_written_archives_come_back(spark, tmp_path):
    Z.register(spark)
    path = str(tmp_path / "out")
    names = ["a", "_b", ".c", "d/e", "f g", "ü%20", "_.x"]
    docs = spark.createDataFrame([(n, archive({"p": n})) for n in names], "doc_id string, content binary").withColumn("other", F.lit(1))
    docs.write.format("archives").mode("append").save(path)
    back = spark.read.format("archives").load(path)
    assert sorted((r.doc_id, bytes(r.content).decode()) for r in back.collect()) == sorted((n, n) for n in names)
    docs.limit(0).write.format("archives").mode("append").save(path)
    spark.createDataFrame([("a", archive({"p": "new"}))], "doc_id string, content binary").write.format("archives").mode("append").save(path)
    assert [bytes(r.content) for r in spark.read.format("archives").load(path).where("doc_id = 'a'").collect()] == [b"new"]
    with pytest.raises(Exception, match="only appended"):
        docs.write.format("archives").mode("overwrite").save(path)
    with pytest.raises(Exception, match="needs a doc_id"):
        spark.createDataFrame([(None, b"")], "doc_id string, content binary").write.format("archives").mode("append").save(path)
