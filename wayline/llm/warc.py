"""A content-addressed web archive: payload bytes once by SHA-256, exact record headers apart, records by join.

A folder holds `payloads` (digest, payload) and `headers` (the text of each record's header, with the
digest it points to). The first page with a payload, by id, is the response, later ones are revisits
that refer to it; payloads under MIN_BYTES are always responses. Reading verifies every payload
against its digest, takes all fields from the header text, and joins the payload back on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import shared_folder

#: Smaller payloads get no revisit records.
MIN_BYTES = 100
#: Dates are part of a header; a fixed one keeps archives of equal pages equal.
DATE = "1970-01-01T00:00:00Z"
#: Field of records whose url had line ends.
ENCODED = "X-Target-URI-Encoding"
END = "\r\n\r\n"


#: Digests of more records than this, or than a 4096th of all records if that is more, are joined by broadcast: at most 4096.
HOT_RECORDS = 1000


def _hot(index: DataFrame) -> DataFrame:
    """The digests of very many records: no more than 4096 rows."""
    limit = max(HOT_RECORDS, index.count() >> 12)
    found = index.groupBy("digest").count().where(F.col("count") > limit).select("digest").toArrow()
    return F.broadcast(index.sparkSession.createDataFrame([(d,) for d in found.column("digest").to_pylist()], "digest string"))


def _by_digest(rows: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows joined with a table of small rows by digest; the records of a hot digest stay where they are."""
    few = F.broadcast(table.join(hot, "digest", "left_semi"))
    return rows.join(few, "digest").unionByName(rows.join(hot, "digest", "left_anti").join(table, "digest"))


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _field(header: Column, name: str) -> Column:
    """Value of a header field, null if absent; the first line end ends it."""
    return F.when(header.contains(f"\r\n{name}: "), F.substring_index(F.substring_index(header, f"\r\n{name}: ", -1), "\r\n", 1))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row. Null html is an empty payload, a null url leaves its field out.

    A header is made of lines, so a url with line ends is percent-encoded, `%` included, and a line says so; all
    other urls stand as they are. Rows without an id get no record id and never serve as a target. Repeated
    rows get a record each, of one type. An empty table writes an empty archive. Payloads of any length
    are one row; those of many pages are merged inside the tasks before any is moved. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), _payload(F.col(html_col)).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # hot payloads shrink before the shuffle: one row per task and digest
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    index = rows.select("id", "url", "digest", F.octet_length("payload").cast("bigint").alias("size"), F.xxhash64("payload").alias("check"))
    first = index.groupBy("digest").agg(F.min("id").alias("first"), F.min("check").alias("x"), F.max("check").alias("y"))
    first = first.where(F.when(F.col("x") == F.col("y"), True).otherwise(F.raise_error(F.lit("two payloads with one digest")).cast("boolean")))
    rows = _by_digest(index, first.select("digest", "first"), _hot(index))
    again = (F.col("size") >= MIN_BYTES) & F.coalesce(F.col("id") != F.col("first"), F.col("first").isNotNull())
    name = lambda i: F.concat(F.lit("<urn:page:"), i.cast("string"), F.lit(">"))
    odd = F.coalesce(F.col("url").rlike(r"[\r\n]"), F.lit(False))
    url = F.when(odd, F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))).otherwise(F.col("url"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.coalesce(_line("WARC-Record-ID", name(F.col("id"))), F.lit("")),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        F.when(odd, _line(ENCODED, F.lit("percent"))).otherwise(F.lit("")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.when(again, _line("WARC-Refers-To", name(F.col("first")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"))
    rows.select(header.alias("header"), "digest").write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, content_length, header): parsed from the exact header texts."""
    header = spark.read.parquet(f"{folder}/headers").select("header")
    page = lambda f: F.regexp_extract(f, "^<urn:page:(-?\\d+)>$", 1).cast("bigint")
    h = F.col("header")
    raw = _field(h, "WARC-Target-URI")
    plain = F.replace(F.replace(F.replace(raw, F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    return header.select(
        page(_field(h, "WARC-Record-ID")).alias("page_id"), F.when(_field(h, ENCODED) == "percent", plain).otherwise(raw).alias("url"), _field(h, "WARC-Type").alias("record_type"),
        page(_field(h, "WARC-Refers-To")).alias("refers_to"), F.substring_index(_field(h, "WARC-Payload-Digest"), ":", -1).alias("digest"),
        _field(h, "Content-Length").cast("bigint").alias("content_length"), "header")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload, payload_bytes), each payload verified against its digest."""
    rows = spark.read.parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("digest"))).cast("bigint")
    right = F.sha2("payload", 256) == F.col("digest")
    return rows.select("digest", "payload", F.when(right, F.octet_length("payload").cast("bigint")).otherwise(wrong).alias("payload_bytes"))


def records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The original records (page_id, .., payload_bytes, payload, record as in a WARC file), revisits with the payload that they point to.

    A response meets its payload in a join; without `payloads`, revisits get the size of theirs only. The content length and
    the digest in the header must be those of what the record then holds.
    """
    heads, stored = read_headers(spark, folder), read_payloads(spark, folder)
    again = F.col("record_type") == "revisit"
    hot = _hot(heads.select("digest"))
    # only small payloads have many responses, and those of a hot digest are no more than 4096
    small = F.col("payload_bytes") < MIN_BYTES
    few = stored.where(small).join(hot, "digest", "left_semi")
    first = heads.where(~again).join(F.broadcast(few), "digest").unionByName(
        heads.where(~again).join(F.broadcast(few.select("digest")), "digest", "left_anti").join(stored, "digest"))
    if payloads:
        later = heads.where(again).join(stored, "digest")
    else:
        sizes = stored.select("digest", "payload_bytes")
        later = _by_digest(heads.where(again), sizes, hot).withColumn("payload", F.lit(None).cast("binary"))
    block = F.when(again, F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    rows = first.unionByName(later.select(*first.columns)).withColumn("record", F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(END), "UTF-8")))
    inside = F.substring("record", F.octet_length(F.encode("header", "UTF-8")) + 1, F.col("content_length").cast("int"))
    right = (F.octet_length("record") == F.octet_length(F.encode("header", "UTF-8")) + F.col("content_length") + len(END)) & (again | (F.sha2(inside, 256) == F.col("digest")))
    wrong = F.raise_error(F.concat(F.lit("the record differs from its header: "), F.col("header"))).cast("binary")
    return rows.withColumn("record", F.when(right, F.col("record")).otherwise(wrong))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new archive, read it back and rebuild every record.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_bytes, record_sha256): the last two of the whole
    record. Empty tables, repeated rows, nulls and long payloads: see `write_archive`.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archive(pages, folder)
    return records(spark, folder, payloads=False).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url",
        F.octet_length("record").cast("bigint").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
