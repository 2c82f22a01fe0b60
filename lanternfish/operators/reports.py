"""Reports over the page, link and redirect tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import urls as U
from lanternfish.operators import lifecycle as L


def domains_and_pages(pages: DataFrame) -> DataFrame:
    """One row (n_domains, n_pages) of the pages that are indexed."""
    return pages.where(F.col("content_body").isNotNull()).agg(F.countDistinct(F.lower("domain_name")).alias("n_domains"), F.count("*").alias("n_pages"))


def content_types(pages: DataFrame) -> DataFrame:
    """(content_type, n), most first; an empty type is shown as such, a null one is left out."""
    d = pages.where(F.col("content_type").isNotNull()).groupBy("content_type").agg(F.count("content_type").alias("n"))
    return d.select(F.when(F.col("content_type") == "", "<empty string>").otherwise(F.col("content_type")).alias("content_type"), "n").orderBy(F.desc("n"), "content_type")


def known_hosts(pages: DataFrame, lower: bool = True) -> DataFrame:
    """Distinct (domain_name, port); for readers lower-cased and of good names only."""
    host = F.lower("domain_name") if lower else F.col("domain_name")
    d = pages.select(host.alias("domain_name"), "port").distinct()
    return d.where(F.col("domain_name").rlike(r"^[^.:/][^:/]*$")) if lower else d


def known_feeds(pages: DataFrame, kind: str = "") -> DataFrame:
    """url of the feeds of a kind, atom if none is named; an unknown kind is an error."""
    kind = kind or "atom"
    if kind not in ("atom", "rss", "twtxt", "gemsub"):
        raise ValueError(f"no feeds of type {kind}")
    return pages.where(F.col("feed_type") == kind).select("url")


def known_security_txt(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("url").rlike(r".*://[^\/]+/.well-known/security.txt") & (F.col("content_type") == "text/plain")).select("url")


def perma_redirects(redirects: DataFrame) -> DataFrame:
    return redirects.select("from_url", "to_url")


def index_status(pages: DataFrame, now: Column) -> DataFrame:
    """One row: indexed domains and pages, and pages that are due."""
    due = L.older(F.col("last_crawled_at"), now, L.STALE) | F.col("last_crawled_at").isNull()
    indexed = F.col("content_body").isNotNull()
    return pages.agg(F.countDistinct(F.when(indexed, F.lower("domain_name"))).alias("n_domains"), F.count(F.when(indexed, 1)).alias("n_pages"), F.count(F.when(due, 1)).alias("n_due"))


def host_urls(hosts: DataFrame, protocol: str = "gemini") -> DataFrame:
    shown = F.when(F.col("port") == U.DEFAULT_PORTS[protocol], F.lit("")).otherwise(F.concat(F.lit(":"), F.col("port").cast("string")))
    return hosts.select(F.concat(F.lit(f"{protocol}://"), F.col("domain_name"), shown, F.lit("/")).alias("url"))


def seed_rows(urls: DataFrame, now: Column, key: tuple[str, ...] = ()) -> DataFrame:
    """New pages for the good ones of urls (url), in normal form, after the columns of key."""
    u = U.with_url(urls, "url", "_u").where("_u.good")
    return u.select(*key, U.format_url(F.col("_u")).alias("url"), F.col("_u.host").alias("domain_name"), U.url_port(F.col("_u")).alias("port"), F.lit(0).cast("long").alias("size"), now.alias("first_seen_at"), F.lit("").alias("indexed_content_hash"), F.lit("").alias("raw_content_hash"))


def add_seed(pages: DataFrame, url: str, now: Column) -> DataFrame:
    """pages with url where it is new and good."""
    return L.insert_if_absent(pages, seed_rows(pages.sparkSession.createDataFrame([(url,)], "url string"), now), ["url"])
