"""A content-addressed archive of WARC records.

The archive is a folder of two Parquet tables. ``payloads`` holds the bytes of each distinct payload once,
under their SHA-256; ``headers`` holds, for each record, the exact bytes before its payload (WARC header,
blank line, HTTP header, blank line) and the address. Joining both gives the records back byte for byte.

The address is verified twice. On writing, all payloads of an address must agree in length and in a second,
unrelated hash; on reading, the stored bytes are digested again. Either failing ends the job.

Payloads are merged to one for each address within tasks before they are shuffled, so copies cost nothing
there, and what tells records apart (ids, addresses) is shuffled without payloads. In both joins one side
has every address once; an address that holds a large part of the records is a skewed join, which adaptive
execution splits.

Defined results: a null payload is an empty one; payloads under ``least`` bytes are never referred to;
the smallest id of a payload's rows is its response, null ids come last, and rows repeated with that id are
responses as well (their bytes are stored once all the same); a null url leaves its header line out, line
breaks in a url are percent-encoded; an empty table gives an archive without records. Other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import written

LINE = "\r\n"
BLANK = LINE + LINE
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGEST = "sha256:"


def _record_id(name: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(name.cast("string"), F.lit("")), F.lit(">"))


def _checked(holds: Column, value: Column, message: str) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(F.lit(message)))


def head(name: Column, url: Column, digest: Column, size: Column, refers_to: Column, date: str) -> Column:
    """The bytes before a payload: those of a revisit record where ``refers_to`` (a record id) is not null."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "), size.cast("string"), F.lit(BLANK))
    revisit = refers_to.isNotNull()
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size)
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit(LINE))
    warc = F.concat(
        F.lit(f"WARC/1.1{LINE}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", _record_id(name)),
        F.lit(f"WARC-Date: {date}{LINE}"), F.coalesce(line("WARC-Target-URI", uri), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit(DIGEST), digest)),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{LINE}"), line("WARC-Refers-To", refers_to))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{LINE}"), line("Content-Length", block.cast("string")), F.lit(LINE),
    )
    return F.concat(warc, http).cast("binary")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row into the archive at ``path``: a response, or a revisit where a row with a
    smaller id has the same payload of at least ``least`` bytes. ``payload`` is a text or binary column."""
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("size"))
    known = written(rows.select("id", "url", "digest", "size"), "digests")
    check = F.xxhash64("payload", "size")
    once = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("size").alias("size"), F.max("size").alias("most"), F.min(check).alias("low"), F.max(check).alias("high")
    )
    same = (F.col("size") == F.col("most")) & (F.col("low") == F.col("high"))
    once = once.select("digest", "size", _checked(same, F.col("payload"), "two payloads have one digest").alias("payload"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")

    first = known.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    apart, named = known.where(F.col("size") < least), known.where(F.col("size") >= least).join(first, "digest", "left")
    later = F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    every = named.withColumn("refers_to", F.when(later, _record_id(F.col("first_id")))).drop("n", "first_id").unionByName(apart.withColumn("refers_to", F.lit(None).cast("string")))
    made = head(F.col("id"), F.col("url"), F.col("digest"), F.col("size"), F.col("refers_to"), date)
    every.select(made.alias("head"), "digest", F.col("refers_to").isNull().alias("whole")).write.parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ``head``, the full ``payload`` it belongs to (also that of a revisit), and
    ``record``, the original bytes."""
    heads = spark.read.schema("head binary, digest string, whole boolean").parquet(f"{path}/headers")
    bodies = spark.read.schema("digest string, size long, payload binary").parquet(f"{path}/payloads")
    proven = (F.sha2("payload", 256) == F.col("digest")) & (F.length("payload") == F.col("size"))
    bodies = bodies.select("digest", _checked(proven, F.col("payload"), "a stored payload does not have its digest").alias("payload"))
    joined = heads.join(bodies, "digest", "left")
    payload = _checked(F.col("payload").isNotNull(), F.col("payload"), "a payload is missing")
    end = F.lit(BLANK.encode())
    return joined.select("head", payload.alias("payload"), F.concat("head", F.when(F.col("whole"), payload).otherwise(F.lit(b"")), end).alias("record"))


def parsed(rows: DataFrame, record: str = "record") -> DataFrame:
    """Add what the bytes of a WARC record say: ``record_id``, ``record_type``, ``target_uri``, ``digest``,
    ``refers_to`` (a record id), ``http_head`` and ``body`` (the bytes behind the HTTP header)."""
    raw = F.col(f"`{record}`")
    top = F.substring_index(raw.cast("string"), BLANK, 1)
    value = lambda field: F.nullif(F.regexp_extract("_top", rf"(?:^|\n){field}: ([^\r\n]*)", 1), F.lit(""))
    rows = rows.withColumn("_top", top)
    rows = rows.withColumn("_block", F.substring(raw, F.octet_length("_top") + 5, value("Content-Length").cast("int")))
    rows = rows.withColumn("http_head", F.substring_index(F.col("_block").cast("string"), BLANK, 1))
    return rows.select(
        *[c for c in rows.columns if c not in ("_top", "_block")], value("WARC-Record-ID").alias("record_id"), value("WARC-Type").alias("record_type"),
        value("WARC-Target-URI").alias("target_uri"), F.substring(value("WARC-Payload-Digest"), F.lit(len(DIGEST) + 1), F.lit(64)).alias("digest"),
        value("WARC-Refers-To").alias("refers_to"), F.substring(F.col("_block"), F.octet_length("http_head") + 5, F.length("_block")).alias("body"),
    )


def page_of(record_id: str) -> Column:
    """The page id in a record id; null if it has none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
