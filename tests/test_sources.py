import base64
import gzip
import io
import json
import tarfile
import zipfile

from stratalens.sources import archives


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


def _tar(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for k, v in entries.items():
            i = tarfile.TarInfo(k)
            i.size = len(v)
            t.addfile(i, io.BytesIO(v))
    return out.getvalue()


def test_archives_nest(spark):
    har = json.dumps({"log": {"entries": [{"request": {"url": "https://h.example/a.js?x=1"}, "response": {"content": {"text": base64.b64encode(b"var a").decode(), "encoding": "base64"}}}]}}).encode()
    rows = [("a.zip", _zip({"x.py": b"1", "in.zip": _zip({"y.py": b"2"})})), ("b.tgz", gzip.compress(_tar({"z.c": b"3"}))), ("c.har", har), ("d.txt", b"plain"), ("e.zip", b"PK\x03\x04broken"), ("f", None)]
    got = {r.path: bytes(r.content) for r in archives.archives(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.zip!x.py"] == b"1" and got["a.zip!in.zip!y.py"] == b"2" and got["b.tar!z.c"] == b"3"
    assert got["h.example/a.js"] == b"var a" and got["d.txt"] == b"plain" and "e.zip" in got and got["f"] == b""


def test_directory_and_strings(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "no.bin").write_bytes(b"skipped text")
    (tmp_path / "yes.bin").write_bytes(b"\x00\x01hello world\x00ab\xff")
    files = archives.directory(spark, str(tmp_path))
    assert [r.value for r in archives.strings(files).collect()] == ["hello world"]
    (tmp_path / "list.txt").write_text(f"# comment\n{tmp_path}/yes.bin\n")
    assert archives.text(archives.filelist(spark, str(tmp_path / "list.txt"))).count() == 1


def test_stream(spark, tmp_path):
    from stratalens.streaming import ingest

    src = tmp_path / "in"
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a', 3.0D UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'b', 1.0D").coalesce(1).write.parquet(str(src))
    s = ingest.windowed_counts(ingest.new_files(spark, str(src), "ts timestamp, event_type string, value double"))
    q = s.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.event_type, r.n, r.mean) for r in spark.sql("SELECT * FROM counts").collect()] == [("a", 2, 2.0)]
