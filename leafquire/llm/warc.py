"""WARC archives: writing them, and reading them back by their chain of records."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leafquire.llm.shared import discard, materialize, table, work_dir

MAGIC = "WARC/1.0\r\n"
#: What all versions begin with; digits and a line end follow.
MARK = "WARC/1."
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of at least this many bytes are revisited when they repeat.
LEAST_REVISIT = 0
#: Up to this many revisiting rows (about 80 bytes each) go to all tasks.
BROADCAST_REVISITS = 500_000


@F.pandas_udf(T.StringType())
def _base32(digest: pd.Series) -> pd.Series:
    """Bare upper-case base32 of a hexadecimal digest."""
    return digest.map(lambda x: None if x is None else base64.b32encode(bytes.fromhex(x)).decode())


def _octets(text: Column) -> Column:
    return F.octet_length(text.cast("binary"))


def _line(name: str, value: Column) -> Column:
    """A header line; line breaks in the value are percent-encoded; none for null."""
    clean = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def describe(pages: DataFrame, key: str = "page_id", body: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Add ``payload``, ``payload_bytes``, ``payload_sha1`` (hex), ``record_type`` and ``refers_to``.

    Of rows whose payloads are equal and have at least ``least`` bytes, the one with the
    smallest key is the response and the others revisit it; a null payload is the empty
    one; rows with a null key revisit the keyed one, or are responses if none is keyed.
    Rows that repeat the smallest key are all responses.
    """
    out = pages.drop("payload", "payload_bytes", "payload_sha1", "refers_to", "record_type").withColumn("payload", F.coalesce(F.col(body), F.lit("")))
    out = out.withColumn("payload_bytes", _octets(F.col("payload")).cast("long")).withColumn("payload_sha1", F.sha1(F.col("payload").cast("binary")))
    thin = out.select(F.col(key).alias("own"), "payload_sha1", "payload_bytes")
    first = thin.where(F.col("payload_bytes") >= least).groupBy("payload_sha1").agg(F.min("own").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    later = thin.join(first.drop("n"), "payload_sha1").where(~F.col("refers_to").eqNullSafe(F.col("own"))).select("own", F.col("payload_sha1").alias("of"), "refers_to").distinct()
    later = materialize(later)
    few = later.count() <= BROADCAST_REVISITS  # beyond that the payloads are shuffled to them
    same = out["payload_sha1"].eqNullSafe(later["of"]) & out[key].eqNullSafe(later["own"])
    out = out.join(F.broadcast(later) if few else later, same, "left").drop("of", "own")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))


def record(row_key: str, url: str, date: str = DATE) -> Column:
    """A described row as one WARC record without its closing blank lines."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END)
    )
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("payload"))).otherwise(http)
    return F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col(row_key).cast("string"), F.lit("null")), F.lit(">"))),
        _line("WARC-Target-URI", F.col(url)),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("payload_sha1")))),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", _octets(block)),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST_REVISIT, compression: str = "none") -> None:
    """Write one record for each row. Each task writes one archive file.

    With ``compression="gzip"`` an archive is read by one task; plain ones are split.

    The text writer's separator is the two line breaks that end a WARC record, so its
    files are archives byte for byte, in any file system that Spark can write to.
    """
    slim = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))
    records = describe(slim, least=least).select(record("page_id", "url").alias("value"))
    records.write.mode("overwrite").option("lineSep", END).option("compression", compression).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives where a magic may begin: ``path, file, block, at, piece, size``.

    The text reader splits files into tasks and lines at ``MARK``, wherever it stands.
    A piece is what follows one mark up to the next, byte for byte; in file order, the
    running sum of the pieces' bytes gives each one's offset. ``size`` is the bytes that
    follow the mark. What precedes a file's first mark is left out.
    """
    raw = spark.read.option("lineSep", MARK).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("piece"),
    )
    return raw.withColumn("size", F.octet_length("piece").cast("long"))


def chains(pieces: DataFrame) -> DataFrame:
    """``file, block, at, start, next`` of each candidate: where its own length says the successor starts.

    ``pieces`` has ``file, block, at, size`` and ``declared``: the bytes from the mark
    to the record's end that its header states, null if there is no whole header. Offsets
    add up in two steps, inside each block and over the blocks of a file.
    """
    unit = F.col("size") + len(MARK)
    inside = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(unit).alias("bytes"), F.min("at").alias("first"))
    over = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("bytes").over(over), F.lit(0)))
    placed = pieces.withColumn("within", F.coalesce(F.sum(unit).over(inside), F.lit(0))).join(blocks.select("file", "block", "base"), ["file", "block"])
    # The piece before the first mark is empty; its own separator is not in the file.
    start = F.col("base") + F.col("within") - len(MARK)
    return placed.select("file", "block", "at", start.alias("start"), (start + F.col("declared")).alias("next"))


def reachable(edges: DataFrame) -> DataFrame:
    """``(file, start)`` of the records that a file's start reaches, by pointer jumping.

    Each round adds the places that the known ones reach over 2**k records and doubles
    every pointer, so a file of n records takes log2(n) rounds. Pointers that hit no
    candidate end. Rows with a null pointer reach nothing.
    """
    jump = materialize(edges.select("file", "start", "next"))
    known = materialize(edges.where("start = 0").select("file", "start").distinct())
    count = known.count()
    while True:
        ahead = known.join(jump, ["file", "start"]).where("next IS NOT NULL").select("file", F.col("next").alias("start"))
        more = materialize(known.union(ahead.join(jump.select("file", "start"), ["file", "start"], "left_semi")).distinct())
        now = more.count()
        discard(known)
        known = more
        if now == count:
            discard(jump)
            return known
        count = now
        over = jump.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        doubled = materialize(jump.join(over, ["file", "next"], "left").select("file", "start", F.col("far").alias("next")))
        discard(jump)
        jump = doubled


def reached(edges: DataFrame) -> DataFrame:
    """``edges`` with ``run`` and ``ok``: whether a record is on its file's chain.

    Records that follow each other as stated form a run, and a run is left by its last
    pointer alone. So pointers need to jump only between the places where runs are
    entered: the file's start and where some run's last pointer lands. A record counts if its
    run is entered at it or before it. What jumps is one row per false candidate or
    broken record, not one per record.
    """
    order = W.partitionBy("file").orderBy("start")
    broken = F.when(F.lag("next").over(order).eqNullSafe(F.col("start")), 0).otherwise(1)
    rows = edges.withColumn("_b", broken).withColumn("run", F.sum("_b").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_b")
    rows = materialize(rows)
    ends = rows.groupBy("file", "run").agg(F.max_by("next", "start").alias("out"))
    landed = ends.where("out IS NOT NULL").select("file", F.col("out").alias("start")).union(rows.where("start = 0").select("file", "start")).distinct()
    entries = rows.select("file", "run", "start").join(landed, ["file", "start"]).join(ends, ["file", "run"])
    entries = materialize(entries.select("file", "run", "start", F.col("out").alias("next")))
    entered = reachable(entries).join(entries.select("file", "start", "run"), ["file", "start"]).groupBy("file", "run").agg(F.min("start").alias("entry"))
    marked = rows.join(entered, ["file", "run"], "left")
    return marked.withColumn("ok", F.coalesce(F.col("start") >= F.col("entry"), F.lit(False))).drop("entry")


def _head(text: Column) -> Column:
    """What precedes the first empty line; the whole text if there is none. No pattern, so any length will do."""
    return F.substring_index(text, END, 1)


def _header(name: str) -> Column:
    """The value of the first header line of that name, whatever its case; null if there is none."""
    mark = f"{name.lower()}:"
    line = F.get(F.filter(F.split("head", "\r\n"), lambda x: F.lower(F.substring(x, 1, len(mark))) == mark), F.lit(0))
    value = F.trim(F.substring(line, len(mark) + 1, 2**31 - 1))
    return F.when(value != "", value)


def _stated() -> Column:
    """The record's ``Content-Length``; null if there is none, or none that is a number of bytes."""
    length = _header("Content-Length")
    return F.when(length.rlike("^[0-9]{1,18}$"), length.try_cast("long"))


def declared(pieces: DataFrame) -> DataFrame:
    """Add ``declared``: the bytes from the mark to the record's end that its header states.

    Null without a version behind the mark, a whole header or a usable length: such a
    place has no successor.
    """
    rows = pieces.withColumn("head", _head(F.col("piece")))
    whole = (F.octet_length("piece") > F.octet_length("head")) & F.substring("piece", 1, 5).rlike("^[0-9]{1,3}\r\n")
    return rows.withColumn("declared", F.when(whole, len(MARK) + F.octet_length("head") + 4 + _stated() + len(END))).drop("head")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, record_type, record_id, target_uri, payload_digest, refers_to, payload, error``.

    Records of all versions 1.x are read. A magic inside a payload makes a candidate like
    any other, but nothing reaches it from the start of its file. The pieces from one
    reached record to the next are that record, put together again; they alone are
    shuffled, whole records stay where they are read. The archives are read once: the
    pieces are written with their places, so a later step cannot meet them split in
    another way. Files are assumed to begin with a record; an empty file has none.

    ``payload`` is binary, the bytes as they stand: of records whose content is HTTP what
    follows its header, of others the whole content. ``error`` is null for whole records.
    A record without a usable length (``length``) ends its file's chain, and what follows
    is its payload, as no later place is known to be a record; ``header``: there is no
    empty line behind the header, so there is no payload; ``short``: the file ends
    before the stated length.
    """
    raw = materialize(declared(candidates(spark, path)), compression="zstd")
    thin = raw.select("file", "block", "at", "size", "declared")
    marks = reached(materialize(chains(thin).where("start >= 0")))
    upto = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    owner = materialize(marks.withColumn("owner", F.max(F.when(F.col("ok"), F.col("start"))).over(upto)).select("file", "block", "at", "start", "ok", "owner"))
    split = owner.where("NOT ok AND owner IS NOT NULL").select("file", "owner").distinct()
    parts = materialize(owner.join(split, ["file", "owner"], "left_semi"))
    # What is no whole record: pieces to put together, pieces that nothing owns, and what precedes a file's first mark.
    other = parts.select("file", "block", "at").union(owner.where("owner IS NULL").select("file", "block", "at"))
    other = materialize(other.union(thin.where("size = 0").select("file", "block", "at")))
    alone = raw.join(other, ["file", "block", "at"], "left_anti").select("path", F.col("piece").alias("text"))
    pieces = raw.select("path", "file", "block", "at", "piece").join(parts, ["file", "block", "at"])
    joined = pieces.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("parts"))
    joined = joined.select("path", F.array_join(F.col("parts.piece"), MARK).alias("text"))
    records = alone.unionByName(joined).withColumn("head", _head(F.col("text"))).withColumn("stated", _stated())
    after = F.octet_length("text") - F.octet_length("head") - 4
    error = F.when(after < 0, "header").when(F.col("stated").isNull(), "length").when(after < F.col("stated"), "short")
    # A record is one value, so it has less than 2 GB.
    length = F.least(F.coalesce("stated", F.greatest(after, F.lit(0))), F.lit(2**31 - 1)).cast("int")
    block = F.substring(F.col("text").cast("binary"), F.octet_length("head") + 5, length)
    # The content of an HTTP record begins with the answer's own header.
    http = F.coalesce(F.lower(_header("Content-Type")).startswith("application/http"), F.lit(False))
    answer = F.when(http, F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)).otherwise(0)
    return records.select(
        "path", _header("WARC-Type").alias("record_type"), _header("WARC-Record-ID").alias("record_id"), _header("WARC-Target-URI").alias("target_uri"),
        _header("WARC-Payload-Digest").alias("payload_digest"), _header("WARC-Refers-To").alias("refers_to"),
        F.substring(block, answer + 1, F.octet_length(block)).alias("payload"), error.alias("error"),
    )


def page_of(urn: Column) -> Column:
    number = F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1)
    return F.when(number != "", number.cast("long"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path).withColumn("page_id", page_of(F.col("record_id"))).withColumn("refers_to", page_of(F.col("refers_to")))
    back = materialize(back.select(
        "page_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("own_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("stated"), F.sha1("payload").alias("own_sha1"),
    ))
    responses = back.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("of_bytes"), F.col("stated").alias("of_digest")).dropDuplicates(["refers_to", "of_digest"])
    revisit = F.col("record_type") == "revisit"
    same = (back["refers_to"] == responses["refers_to"]) & (back["stated"] == responses["of_digest"])
    return back.join(responses, same, "left").select(
        "page_id", F.when(revisit, F.col("of_bytes")).otherwise(F.col("own_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated")).otherwise(_base32(F.col("own_sha1"))).alias("payload_digest"), "record_type", back["refers_to"],
    )
