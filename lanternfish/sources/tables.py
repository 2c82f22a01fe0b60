"""Model tables, landed responses and seed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.text import mime_type

PAGES = """url string not null, domain_name string not null, port int not null, content_type string, charset string, lang string, title string, content_body string, feed_type string, size bigint not null,
last_indexed_at timestamp_ntz, last_crawled_at timestamp_ntz, last_crawl_success_at timestamp_ntz, last_status int, last_meta string, first_seen_at timestamp_ntz not null,
cross_site_links array<string>, internal_links array<string>, last_queued_at timestamp_ntz, indexed_content_hash string not null, raw_content_hash string not null"""
POSTINGS = "term string not null, url string not null, field string not null, tf int not null, positions array<int> not null"
LINKS = "url string not null, host string not null, port int not null, to_url string not null, to_host string not null, to_port int not null, is_cross_site boolean not null"
ROBOT_POLICIES = "host string not null, port int not null, disallowed string not null"
ROBOT_STATUS = "host string not null, port int not null, last_crawled_at timestamp_ntz not null, have_policy boolean not null"
PERMA_REDIRECTS = "from_url string not null, to_url string not null"
RESPONSES = "url string, status int, meta string, body binary, fetched_at timestamp_ntz"
TABLES = {"pages": PAGES, "postings": POSTINGS, "links": LINKS, "robot_policies": ROBOT_POLICIES, "robot_policies_status": ROBOT_STATUS, "perma_redirects": PERMA_REDIRECTS}


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none yet; safe to repeat."""
    for name, ddl in TABLES.items():
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_snapshot(df: DataFrame, root: str, name: str, version: int) -> str:
    """A new version beside the old ones; readers go on with theirs."""
    path = f"{root}/{name}/v{version:08d}"
    df.write.mode("error").parquet(path)
    return path


def newest(spark: SparkSession, root: str, name: str) -> int | None:
    """The number of the newest whole version of a table; None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    names = [x.getPath() for x in fs.listStatus(at)]
    return max((int(x.getName()[1:]) for x in names if x.getName()[1:].isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))), default=None)


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/v{newest(spark, root, name):08d}")


def write_next(df: DataFrame, root: str, name: str) -> str:
    return write_snapshot(df, root, name, (newest(df.sparkSession, root, name) or 0) + 1)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """url of each line that is not blank."""
    return spark.read.text(path).select(F.btrim("value").alias("url")).where("url <> ''")


# fixed values: types whose bodies are fetched, others are known by their headers only
BODY_TYPES = ("text/gemini", "text/plain", "text/markdown", "text/x-rst", "plaintext")


def read_responses(spark: SparkSession, path: str, max_bytes: int = 2_500_000) -> DataFrame:
    """Landed responses; bodies above max_bytes, and those of successful answers of other types than BODY_TYPES, count as not fetched."""
    d = spark.read.schema(RESPONSES).parquet(path)
    kind = mime_type(F.col("meta"))
    wanted = ~F.coalesce(F.col("status").between(20, 29), F.lit(False)) | (kind == "") | kind.isin(*BODY_TYPES)
    return d.withColumn("body", F.when(wanted & (F.octet_length("body") <= max_bytes), F.col("body")))


def as_json_rows(df: DataFrame) -> DataFrame:
    """A JSON object a row, for reports of any size; write it as text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def as_json_array(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: the rows of a report that is small by nature as a JSON array, in the given order; '[]' for none."""
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in df.columns if c not in order]]])
    return df.agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))
