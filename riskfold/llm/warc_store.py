"""Operator 2: content-addressed WARC archive.

``write_archive`` stores two Parquet tables under a folder:

* ``payloads``: every distinct payload once, as a zstd frame, under the SHA-256
  address of its bytes.  Equal addresses must have equal lengths, else the write fails.
* ``records``: per page the exact bytes of its record header, with the address
  of its payload.

``read_records`` joins the two and returns the original records byte for byte;
it recomputes every digest and fails on a payload that does not match its
address, or on a Content-Length that is not the number of bytes rebuilt.

Payloads are compressed where they are read and expanded where their records are
rebuilt, so that both shuffles, by address, move frames.

Of the pages with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, the
one with the largest page_id is the response and the others are revisits that
refer to it; smaller payloads are always responses.

Skew: per payload only (address, count, largest page_id) is aggregated, with
map-side combine.  A payload used by many records is replicated once per
``RECORDS_PER_SLICE`` records in the reading join, and its records are dealt
over those slices, so that no join key holds more than about that many rows.

Defined results: null html is the empty payload; a null url gives a record
without WARC-Target-URI, line breaks in a url are percent-encoded; of rows that
repeat the largest page_id the first is the response; a null page_id is the
smallest; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm.common import join_groups, ship_package, stage

MIN_REVISIT_BYTES = 1000
RECORDS_PER_SLICE = 1000
BATCH_BYTES = 4 << 20  # expanded payloads in a batch, one payload at least
#: Fixed value: the WARC 1.1 profile of a revisit by equal payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _packed(payloads: DataFrame) -> DataFrame:
    """(address, payload, n) with payloads as zstd frames."""
    import pyarrow as pa

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            frames = pa.array([pack(x.as_py()) for x in batch.column(1)], pa.binary())
            yield pa.record_batch([batch.column(0), frames, batch.column(2)], ["address", "payload", "n"])

    return payloads.mapInArrow(run, "address binary, payload binary, n int")


def _unpacked(records: DataFrame) -> DataFrame:
    """(address, header, payload) with zstd frames expanded, one payload at a time."""
    import pyarrow as pa

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            start = size = 0
            out: list[bytes] = []
            for k, frame in enumerate(batch.column(2)):
                out.append(expand(frame.as_py()))
                size += len(out[-1])
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    yield pa.record_batch([batch.column(0)[start:k + 1], batch.column(1)[start:k + 1], pa.array(out, pa.binary())],
                                          ["address", "header", "payload"])
                    start, size, out = k + 1, 0, []

    return records.mapInArrow(run, "address binary, header binary, payload binary")


def payload_of(html: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")


def _record_id(page: Column, row: Column) -> Column:
    """A stable urn:uuid for one input row."""
    h = F.md5(F.concat_ws("/", F.lit("record"), F.coalesce(page.cast("string"), F.lit("null")), row.cast("string")))
    parts = [F.substring(h, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(date: str) -> Column:
    """The header block, blank line included.  Fields that do not apply are left out."""
    revisit = F.col("refers_row").isNotNull()
    url = F.replace(F.replace(F.col("url").cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))  # null value: null field, which concat_ws skips

    fields = [
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("__llm_row"))),
        field("WARC-Page-ID", F.col("page_id").cast("string")),
        field("WARC-Target-URI", url),
        field("WARC-Date", F.lit(date)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        field("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, field("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("refers_row")))),
        F.when(revisit, field("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string"))),
        F.when(revisit, field("WARC-Profile", F.lit(REVISIT_PROFILE))),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    ]
    return F.encode(F.concat_ws("", *fields), "UTF-8")


def write_archive(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the archive of ``pages`` (page_id, url, html) into ``folder``."""
    ship_package(pages.sparkSession)
    payload = payload_of()
    facts = stage(pages.select("page_id", "url", F.monotonically_increasing_id().alias("__llm_row"),
                               F.unhex(F.sha2(payload, 256)).alias("address"), F.sha1(payload).alias("sha1"),
                               F.octet_length(payload).cast("long").alias("payload_bytes")), "page-facts")
    total = facts.count()
    order = F.struct("page_id", F.bitwise_not(F.col("__llm_row")))
    groups = stage(facts.groupBy("address").agg(
        F.count(F.lit(1)).alias("users"),
        F.max_by(F.struct(F.col("page_id").alias("keep_id"), F.col("__llm_row").alias("keep_row")), order).alias("k"))
        .select("address", "users", "k.*"), "payload-groups")
    slices = F.ceil(F.col("users") / RECORDS_PER_SLICE).cast("int")
    is_revisit = (F.col("payload_bytes") >= MIN_REVISIT_BYTES) & (F.col("__llm_row") != F.col("keep_row"))
    typed = (join_groups(facts, groups, "address", "users", total)
             .withColumns({"refers_to": F.when(is_revisit, F.col("keep_id")),
                           "refers_row": F.when(is_revisit, F.col("keep_row")),
                           "slice": F.pmod(F.xxhash64("__llm_row"), slices).cast("int")}))
    typed.select("page_id", "address", "slice", _header(date).alias("header")).write.parquet(f"{folder}/records")
    # any copy is as good as another; the map side keeps one a task before the shuffle
    whole = F.when(F.min("n") == F.max("n"), F.any_value("payload")).otherwise(
        F.raise_error(F.lit("two payloads share a SHA-256 address")))
    packed = _packed(pages.select(F.unhex(F.sha2(payload, 256)).alias("address"), payload.alias("payload"),
                                  F.octet_length(payload).alias("n")))
    stored = packed.groupBy("address").agg(whole.alias("payload"), F.count(F.lit(1)).alias("users"))
    stored.write.option("compression", "none").parquet(f"{folder}/payloads")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(header, payload, content): every record's exact header bytes, the full
    payload it stands for, and the bytes that follow its header."""
    records = spark.read.schema("page_id long, address binary, slice int, header binary").parquet(f"{folder}/records")
    payloads = spark.read.schema("address binary, payload binary, users long").parquet(f"{folder}/payloads")
    last = F.ceil(F.col("users") / RECORDS_PER_SLICE).cast("int") - 1
    sliced = payloads.select("address", "payload", F.explode(F.sequence(F.lit(0), last)).alias("slice"))
    joined = records.select("address", "slice", "header").join(sliced, ["address", "slice"]).select("address", "header", "payload")
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("address"), F.col("payload")).otherwise(
        F.raise_error(F.lit("a stored payload does not match its address")))
    head = F.decode("header", "UTF-8")
    stands = F.when(F.contains(head, F.lit("WARC-Type: revisit\r\n")), F.lit(b"")).otherwise(F.col("payload"))
    length = F.regexp_extract(head, r"\r\nContent-Length: (\d+)\r\n", 1).cast("long")
    whole = F.when(length == F.octet_length("content"), F.col("header")).otherwise(
        F.raise_error(F.lit("a record is not as long as its header says")))
    ship_package(spark)
    return (_unpacked(joined).select("header", sound.alias("payload")).withColumn("content", stands)
            .select(whole.alias("header"), "payload", "content"))


def record_bytes(records: DataFrame) -> DataFrame:
    """Whole WARC records: header, content, and the two line ends that close a record."""
    return records.select(F.concat("header", "content", F.lit(b"\r\n\r\n")).alias("record"))


def record_fields(records: DataFrame) -> DataFrame:
    """What the records read back say: ids and types from the header bytes, length
    and digest from the payload bytes."""
    head = F.decode("header", "UTF-8")

    def value(name: str) -> Column:
        got = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(got != "", got)

    return records.select(
        value("WARC-Page-ID").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), value("WARC-Type").alias("record_type"),
        value("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"))
