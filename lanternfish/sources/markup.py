"""Reports in line markup: one row of column markup a line or block, in order; write() puts them into a text file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import text as T
from lanternfish.operators import reports as R

# fixed values: links whose pages ask for input, and marks of those that don't
INPUT_PAGES = ("/search", "/backlinks", "/add_seed")


def counted(value: Column, label: Column, width: int = 8) -> Column:
    return F.concat(T.left_pad(value, width), F.lit(" : "), label)


def statistics(pages: DataFrame) -> DataFrame:
    """(place, markup): numbers of pages and domains, then one line a content type, most frequent first."""
    n = R.domains_and_pages(pages)
    head = n.select(F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("place"), counted(F.col("n_pages"), F.lit("pages")).alias("markup")), F.struct(F.lit(-1).cast("long").alias("place"), counted(F.col("n_domains"), F.lit("domains")).alias("markup")))).alias("x")).select("x.*")
    # one row a content type
    kinds = R.content_types(pages).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "content_type", "n"))).alias("rows"))
    lines = kinds.select(F.posexplode("rows").alias("place", "r")).select(F.col("place").cast("long").alias("place"), counted(F.col("r.n"), F.col("r.content_type")).alias("markup"))
    return head.unionByName(lines)


def hosts(known: DataFrame) -> DataFrame:
    """A link line for each url of known."""
    return known.select(F.concat(F.lit("=> "), F.col("url")).alias("markup"))


def backlinks(rows: DataFrame) -> DataFrame:
    """(is_cross_site, markup): a line with the number of links of either kind, and a link line each, by url. rows: url, is_cross_site."""
    kinds = rows.sparkSession.createDataFrame([(True, "cross-capsule"), (False, "internal")], "is_cross_site boolean, name string")
    counts = F.broadcast(kinds).join(rows.groupBy("is_cross_site").agg(F.count("*").alias("n")), "is_cross_site", "left")  # two rows
    heads = counts.select("is_cross_site", F.lit(0).alias("place"), F.lit("").alias("url"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" "), F.col("name"), F.lit(" backlinks")).alias("markup"))
    lines = rows.select("is_cross_site", F.lit(1).alias("place"), "url", F.concat(F.lit("=>"), F.col("url")).alias("markup"))
    return heads.unionByName(lines).orderBy(F.desc("is_cross_site"), "place", "url").select("is_cross_site", "markup")


def results(found: DataFrame, verbose: bool = False) -> DataFrame:
    """found (a page of search()) with column markup: the link line, the url under another title, score and time if verbose, the preview."""
    label = F.concat(F.lit("=> "), F.col("url"), F.lit(" "), F.col("title"), F.lit(" ("), T.content_label(F.col("content_type")), F.lit(", "), T.size_kb(F.col("size")).cast("string"), F.lit("KB)"))
    parts = [label, F.when(F.col("title") != F.col("url"), F.concat(F.lit("* "), F.try_url_decode(F.col("url"))))]
    if verbose:
        parts += [F.concat(F.lit("* Score: "), F.col("score").cast("string")), F.concat(F.lit("* Last Crawled: "), F.coalesce(F.date_format("last_crawl_success_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")))]
    return found.withColumn("markup", F.concat(F.concat_ws("\n", *parts, F.col("preview")), F.lit("\n")))


def ask_input(line: Column) -> Column:
    """A line for readers that send input with a request: links to pages that ask for input begin with '=:'."""
    asks = line.contains(INPUT_PAGES[0]) | line.contains(INPUT_PAGES[1]) | line.contains(INPUT_PAGES[2])
    return F.when(line.startswith("=>") & asks & ~line.contains("/doc") & ~line.contains("?"), F.replace(line, F.lit("=>"), F.lit("=:"))).otherwise(line)


def write(lines: DataFrame, path: str, order: list[str]) -> None:
    """The column markup as text, in the given order, in as many files as the sort has partitions."""
    lines.orderBy(*order).select("markup").write.mode("overwrite").text(path)
