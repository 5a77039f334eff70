"""Content-addressed WARC archive.

``write`` makes two tables: payload bytes once by their SHA-256, bucketed by it, and the exact header bytes of
each record. ``read`` joins them, checks every payload against its digest and gives the records back byte by
byte; ``export`` writes them as WARC text files. A payload of at least ``least`` bytes that occurs again is a
revisit of its first record, the one of the smallest id; smaller payloads are always responses. Copies of a payload
are reduced to one row a task before they are shuffled, and digests alone tell copies apart.

Defined cases: a null payload is empty; a null id sorts before all others; rows with one id and payload are two
records, of which the one of the smaller URL is the response, and of rows equal in all three one is; null URLs are written as an empty target; an empty table makes an empty
archive; very long payloads are one record; further columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import stage_dir

LEAST = 100
#: fixed value: the revisit profile of WARC 1.1 for identical payload digests
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: date of records of pages whose time of capture is not known
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n"


def _uri(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = DATE) -> DataFrame:
    """id, digest, type, refers_to, header of each record."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    each = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("size"))
    # equal rows are one with a count before they are numbered, so that exactly one of them can be the response
    counted = each.groupBy("id", "url", "digest", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    # the first record of a payload, and of several rows of its id the first by URL
    order = F.struct(F.col("id").isNotNull(), "id", F.col("url").isNotNull(), "url")
    firsts = counted.filter(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("o"), F.sum("copies").alias("n")).filter("n > 1").select("digest", F.col("o.id").alias("first_id"), F.col("o.url").alias("first_url"), F.lit(True).alias("copied"))
    met = rows.join(firsts, "digest", "left")
    revisit = F.coalesce("copied", F.lit(False)) & ~(F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("copy") == 1))
    typed = met.withColumn("type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    line = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "type"), F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("id"))), F.lit(f"WARC-Date: {date}"),
            # a line break in a target would end its header line
            F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "%0A")),
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
            F.when(F.col("type") == "revisit", F.concat(F.lit("WARC-Profile: " + PROFILE + _END + "WARC-Refers-To: "), _uri(F.col("refers_to")))),
            F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(F.col("type") == "revisit", F.lit(0)).otherwise(F.col("size")).cast("string"))]
    header = F.concat(F.concat_ws(_END, *line), F.lit(_END + _END)).cast("binary")
    return typed.select("id", "digest", "type", "refers_to", header.alias("header"))


class Archive:
    """The two tables of an archive in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{stage_dir(spark)}/archive-{uuid.uuid4().hex}"
        self.payload_table = f"payloads_{uuid.uuid4().hex}"

    def write(self, pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> Archive:
        data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        stored = pages.select(F.sha2(data, 256).alias("digest"), data.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
        stored.write.option("path", f"{self.path}/payloads").bucketBy(parts, "digest").sortBy("digest").saveAsTable(self.payload_table)
        self.spark.range(1).select(F.lit(parts).alias("buckets")).write.parquet(f"{self.path}/layout")
        records(pages, page_id, url, payload, least).select("digest", "header").write.parquet(f"{self.path}/headers")
        return self

    def read(self) -> DataFrame:
        """header, payload of each record, the payload checked against its digest; also of an archive that another session wrote."""
        if not self.spark.catalog.tableExists(self.payload_table):
            parts = self.spark.read.parquet(f"{self.path}/layout").first()["buckets"]
            self.spark.sql(f"CREATE TABLE {self.payload_table} (digest STRING, payload BINARY) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {parts} BUCKETS LOCATION '{self.path}/payloads'")
        headers = self.spark.read.parquet(f"{self.path}/headers")
        met = headers.join(self.spark.table(self.payload_table), "digest", "left")
        true = F.sha2("payload", 256) == F.col("digest")
        return met.select("header", F.when(true, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload missing or changed: "), "digest"))).alias("payload"))

    def export(self, path: str) -> None:
        """WARC files; a revisit has no body."""
        body = F.when(F.col("header").cast("string").contains("\r\nWARC-Type: revisit\r\n"), F.lit("")).otherwise(F.col("payload").cast("string"))
        self.read().select(F.concat(F.col("header").cast("string"), body, F.lit(_END)).alias("record")).write.option("lineSep", _END).option("compression", "gzip").text(path)

    def drop(self) -> None:
        """Forget the table's name; the files stay with the folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.payload_table}")


def field(name: str) -> Column:
    """Value of a header line, null if there is none."""
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def parsed(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archive has them."""
    def number(name: str) -> Column:
        return F.regexp_extract(field(name), "<urn:page:(-?[0-9]*)>", 1).try_cast("long")

    return read.select(number("WARC-Record-ID").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.substring(field("WARC-Payload-Digest"), 8, 64).alias("payload_digest"),
                       field("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"))

