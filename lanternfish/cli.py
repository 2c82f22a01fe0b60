"""Command line over stored tables: python -m lanternfish.cli [--config FILE] populate_schema | indexstatus | purge PATTERN | seed FILE | crawl RESPONSES.

Tables are versions in folders; a command reads the newest version of each and writes the next one. Readers go on with theirs.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish import config
from lanternfish.operators import lifecycle as L
from lanternfish.operators import policy as P
from lanternfish.operators import reports as R
from lanternfish.sources import tables as T


def populate_schema(spark: SparkSession, root: str) -> None:
    """Empty first versions of the tables that are not there; safe to repeat."""
    for name in T.TABLES:
        if T.newest(spark, root, name) is None:
            T.write_snapshot(spark.createDataFrame([], T.TABLES[name]), root, name, 1)


def index_status(spark: SparkSession, root: str, now: dt.datetime) -> DataFrame:
    return R.index_status(T.current(spark, root, "pages"), F.lit(now).cast("timestamp_ntz"))


def purge(spark: SparkSession, root: str, pattern: str) -> int:
    """Drops pages and links like pattern; the number of pages that went."""
    pages, links, n = L.purge_index(T.current(spark, root, "pages"), T.current(spark, root, "links"), pattern)
    T.write_next(pages, root, "pages")
    T.write_next(links, root, "links")
    return n


def seed(spark: SparkSession, root: str, path: str, now: dt.datetime) -> None:
    """Pages for the good urls of a list that are not known."""
    pages, at = T.current(spark, root, "pages"), F.lit(now).cast("timestamp_ntz")
    T.write_next(L.insert_if_absent(pages, R.seed_rows(T.read_seeds(spark, path), at), ["url"]), root, "pages")


def crawl(spark: SparkSession, root: str, path: str, now: dt.datetime, force: bool = False) -> None:
    """One round over landed responses."""
    from lanternfish.operators.blocked_urls import blocked_urls

    old = {n: T.current(spark, root, n) for n in ("pages", "links", "robot_policies", "robot_policies_status", "perma_redirects")}
    none = spark.createDataFrame([], "host string, port int")
    new = L.crawl_round(*old.values(), T.read_responses(spark, path), F.lit(now).cast("timestamp_ntz"), P.prefix_rules(blocked_urls(spark)), none, force)
    for name, df in new.items():
        T.write_next(df, root, name)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lanternfish", description=__doc__)
    p.add_argument("--config", help="JSON file of settings")
    p.add_argument("--force-reindex", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("populate_schema")
    sub.add_parser("indexstatus")
    for name, what in (("purge", "pattern"), ("seed", "file"), ("crawl", "responses")):
        sub.add_parser(name).add_argument(what)
    a = p.parse_args(argv)
    if a.config:
        with open(a.config) as f:
            s = config.load(f.read())
    else:
        s = config.Settings()
    spark = SparkSession.builder.config(map=s.spark).getOrCreate()
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if a.command == "populate_schema":
        populate_schema(spark, s.tables)
    elif a.command == "indexstatus":
        r = index_status(spark, s.tables, now).first()
        print(f"{r['n_domains']} domains in index\n{r['n_pages']} pages in index\n{r['n_due']} pages need update")
    elif a.command == "purge":
        print(f"Deleted {purge(spark, s.tables, a.pattern)} pages from index")
    elif a.command == "seed":
        seed(spark, s.tables, a.file, now)
    else:
        crawl(spark, s.tables, a.responses, now, a.force_reindex or s.force_reindex)


if __name__ == "__main__":
    main()
