"""Archives: exact round trip, revisits, and magic inside payloads."""

import base64
import hashlib

from pyspark.sql import functions as F

from leafquire.llm import warc

FALSE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    rows = [(i, f"http://x/{i}", f"<p>page {i} é 中</p>\r\n\r\nmore\n") for i in range(40)]
    rows += [(40, None, None), (41, "u\r\nWARC-Type: x", ""), (42, "u", FALSE), (43, "u", FALSE + FALSE + "WARC/1.0\r\n"), (44, "u", "WARC/1.0"), (45, "u", "\r\n\r\n"),
             (46, "u", "x" * 300_000), (47, "u", rows[3][2]), (48, "u", rows[3][2]), (49, "u", FALSE), (50, "u", "WARC/1.0\r\nContent-Length: 9\r\n")]
    return rows


def expected(rows):
    first, out = {}, {}
    for k, _, h in sorted(rows):
        first.setdefault(h or "", k)
    for k, _, h in rows:
        data = (h or "").encode()
        again = first[h or ""] != k
        out[k] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)
    return out


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, payload int, head string").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # many tasks for each file
    try:
        warc.write_archives(df, str(tmp_path / "w"))
        got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).withColumn("page_id", warc.page_of(F.col("record_id"))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = expected(rows)
    assert set(got) == set(want)
    for k, _, h in rows:
        assert got[k].record_type == want[k][2]
        assert bytes(got[k].payload).decode() == ("" if want[k][2] == "revisit" else (h or "")), k
        assert got[k].error is None
        assert got[k].payload_digest == f"sha1:{want[k][1]}"


def test_query(spark, tmp_path):
    rows = pages()
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op6_warc(spark, sf).collect()}
    assert got == expected(rows)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{sf}/none/pages.parquet")
    assert warc.op6_warc(spark, f"{sf}/none").count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op6_warc(spark, sf).collect()}
    assert got == expected(rows)


def test_null_and_repeated_keys(spark, tmp_path):
    rows = [(None, None, "a"), (None, None, "b"), (1, None, "a"), (1, None, "a"), (2, None, "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kinds = sorted((str(r.page_id), r.html, r.record_type, r.refers_to) for r in warc.describe(df).collect())
    assert kinds == [("1", "a", "response", None), ("1", "a", "response", None), ("2", "a", "revisit", 1), ("None", "a", "revisit", 1), ("None", "b", "response", None)]
    warc.write_archives(df, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 5


def test_long_headers_and_many_line_breaks(spark, tmp_path):
    lines = "x: y\r\n" * 200_000
    rows = [(1, "u", warc.MAGIC + "\r\n" * 200_000), (2, "u", warc.MAGIC + lines), (3, "u", warc.MAGIC + lines + "Content-Length: 7\r\n\r\n"), (4, "u", warc.MAGIC * 5_000),
            (5, "u", warc.MAGIC + "Content-Length: 99999999999999999999\r\n\r\nz"), (6, "u", warc.MAGIC + "content-length:  5\r\n\r\nhello\r\n\r\n" + warc.MAGIC), (7, "u", "plain")]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op6_warc(spark, sf).collect()}
    assert got == expected(rows)


def test_splits_do_not_matter(spark, tmp_path):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    warc.write_archives(df, str(tmp_path / "w"))
    seen = []
    for first, then in (("2000", "70000"), ("70000", "2000")):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            rows = warc.read_archives(spark, str(tmp_path / "w"))  # some steps run here
            spark.conf.set("spark.sql.files.maxPartitionBytes", then)
            seen.append(sorted((r.record_id, bytes(r.payload)) for r in rows.collect()))  # and the others here
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(seen[0]) == len(pages())


def test_one_id_with_several_pages(spark, tmp_path):
    rows = [(1, None, "a"), (1, None, "bbb"), (2, None, "bbb"), (3, None, "a")]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.op6_warc(spark, sf).collect())
    assert got == [(1, 1, "response", 0), (1, 3, "response", 0), (2, 3, "revisit", 1), (3, 1, "revisit", 1)]


def _file(tmp_path, name, *records):
    """Records as ``(version, headers, content, stated length)``, written byte for byte."""
    folder = tmp_path / name
    folder.mkdir()
    out = b""
    for i, (version, headers, content, length) in enumerate(records):
        out += b"WARC/" + version + b"\r\nWARC-Record-ID: <urn:page:%d>\r\n" % i + headers + (b"" if length is None else b"Content-Length: " + length + b"\r\n") + b"\r\n" + content + b"\r\n\r\n"
    (folder / "a.warc").write_bytes(out)
    return str(folder)


def _read(spark, path):
    return {warc_id(r.record_id): (bytes(r.payload), r.error) for r in warc.read_archives(spark, path).collect()}


def warc_id(urn):
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


def test_bad_lengths(spark, tmp_path):
    for i, bad in enumerate((b"abc", b"9" * 25, b"-3", b"1.5", None)):
        path = _file(tmp_path, f"bad{i}", (b"1.0", b"", b"first", b"5"), (b"1.0", b"", b"second", bad), (b"1.0", b"", b"third", b"5"))
        got = _read(spark, path)
        assert set(got) == {0, 1} and got[0] == (b"first", None)
        assert got[1][1] == "length" and got[1][0].startswith(b"second\r\n\r\nWARC/1.0\r\n") and got[1][0].endswith(b"third\r\n\r\n")
    got = _read(spark, _file(tmp_path, "short", (b"1.0", b"", b"first", b"5"), (b"1.0", b"", b"second", b"600")))
    assert got == {0: (b"first", None), 1: (b"second\r\n\r\n", "short")}
    folder = tmp_path / "header"
    folder.mkdir()
    (folder / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 4\r\n")
    assert _read(spark, str(folder)) == {7: (b"", "header")}


def test_versions_and_bytes(spark, tmp_path):
    raw = bytes(range(256)) * 40
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    kind = b"content-type: application/http; msgtype=response\r\n"
    false = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 2\r\n\r\nno\r\n\r\n"
    contents = [(b"1.1", b"", b"hello\xff\xfe\x80"), (b"1.1", b"", raw), (b"1.0", kind, http + raw), (b"1.12", b"", false + b"WARC/1.x" + false), (b"1.0", kind, http), (b"1.1", b"", b"a\r\n\r\nb")]
    path = _file(tmp_path, "mixed", *((v, h, c, str(len(c)).encode()) for v, h, c in contents))
    for size in ("500", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = _read(spark, path)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {i: (c[len(http) :] if h else c, None) for i, (_, h, c) in enumerate(contents)}


def test_archives_are_split(spark, tmp_path):
    """The query's plain archives are read by many tasks each."""
    df = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('<p>', id, '</p>'), 400) AS html").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert warc.candidates(spark, str(tmp_path / "w")).select("file", "block").distinct().count() > 10
        assert warc.read_archives(spark, str(tmp_path / "w")).where("error IS NULL").count() == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
