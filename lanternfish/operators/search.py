"""Full-text search: postings, conjunctive match, cover-density rank, link boost, fusion, near-copy merge, paging, previews."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import text as T
from lanternfish.functions import urls as U
from lanternfish.operators import graph
from lanternfish.plans import querylang

WEIGHT = 0.1
TITLE_BOOST = 50
ROOT_LIMIT = 50_000
PER_PAGE = 10
BUCKETS = 256
# fixed values: words that the english analyzer leaves out
STOP = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()


def analyze(text: Column, analyzer: str = "simple") -> Column:
    """Terms in order. english: without stop words (their places stay empty) and with plain plural and -ing, -ed endings off."""
    terms = T.tokenize(text)
    if analyzer == "simple":
        return terms
    stem = lambda t: F.when(F.length(t) > 5, F.regexp_replace(F.regexp_replace(t, "(ing|ed)$", ""), "(?<=[^s])s$", "")).when(F.length(t) > 3, F.regexp_replace(t, "(?<=[^s])s$", "")).otherwise(t)
    return F.transform(terms, lambda t: F.when(t.isin(STOP), F.lit(None).cast("string")).otherwise(stem(t)))


def index_texts(pages: DataFrame) -> DataFrame:
    """url with title_text and body_text: title and url words, and those with the body after them."""
    title = F.concat_ws(" ", F.replace(F.col("title"), F.lit("."), F.lit(" ")), U.index_friendly(F.col("url")))
    return pages.select("url", title.alias("title_text"), F.concat_ws(" ", title, F.col("content_body")).alias("body_text"))


def postings(pages: DataFrame, analyzer: str = "simple", terms: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """(term, url, field, tf, positions from 1) of all terms, or of some. write_index() stores them in the place of an inverted index."""
    t = index_texts(pages)

    def field(f: str) -> DataFrame:
        places = F.transform(analyze(F.col(f"{f}_text"), analyzer), lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x.alias("term")))
        # wanted terms are picked before the rows multiply
        wanted = F.filter(places, lambda p: p["term"].isNotNull() & (p["term"].isin(list(terms)) if terms is not None else F.lit(True)))
        return t.select("url", F.lit(f).alias("field"), F.explode(wanted).alias("p")).select("url", "field", "p.pos", "p.term")

    return field("title").unionByName(field("body")).groupBy("term", "url", "field").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str, buckets: int = BUCKETS, salts: int = 8) -> None:
    """Stores postings in folders by bucket of the term. Rows are dealt by bucket and a salt of the url, so that a very common term is written by several tasks."""
    d = index.withColumn("bucket", bucket_of(F.col("term"), buckets))
    d.repartition("bucket", F.pmod(F.xxhash64("url"), F.lit(salts))).sortWithinPartitions("bucket", "term", "url").write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, terms: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stored postings, all or those of terms; only the terms' folders are read."""
    d = spark.read.parquet(path)
    if terms is not None:
        at = spark.range(1).select(F.array(*[bucket_of(F.lit(t), buckets) for t in terms]).alias("b")).first()["b"] if terms else []
        d = d.where(F.col("bucket").isin(at) & F.col("term").isin(list(terms)))
    return d.drop("bucket")


def update_index(index: DataFrame, pages: DataFrame, gone: DataFrame | None = None, analyzer: str = "simple") -> DataFrame:
    """index with the postings of pages, which are new or changed, in place of their old ones, and without the urls of gone; other pages' texts are not read."""
    out = pages.select("url") if gone is None else pages.select("url").unionByName(gone.select("url"))
    return index.join(out.distinct(), "url", "left_anti").select(*index.columns).unionByName(postings(pages, analyzer))


def terms_of(spark, query: str, analyzer: str = "simple") -> list[str]:
    got = spark.range(1).select(analyze(F.lit(query), analyzer).alias("t")).first()["t"]
    return list(dict.fromkeys(x for x in got if x is not None))


def cover_density(positions: list[list[int]], weight: float = WEIGHT) -> float:
    """Sum over the least intervals that hold all terms of (terms' weight) / (1 + words between)."""
    if not positions or not all(positions):
        return 0.0
    if len(positions) == 1:
        return weight * len(positions[0])
    events = sorted((p, t) for t, ps in enumerate(positions) for p in ps)
    last: dict[int, int] = {}  # of each term the place of its last event among all
    rank, begin = 0.0, -1
    for i, (p, t) in enumerate(events):
        last[t] = i
        if len(last) == len(positions):
            first = min(last.values())
            start = events[first][0]
            if start > begin:
                rank += weight / (1 + max(0, p - start - (i - first)))
                begin = start
    return rank


def cover_rank(positions: Column, n_terms: int, weight: float = WEIGHT) -> Column:
    """cover_density() as an expression of an array of sorted position arrays, one a term: one pass over the sorted hits."""
    if n_terms == 1:
        return weight * F.size(F.element_at(positions, 1))
    hits = F.flatten(F.transform(positions, lambda ps, t: F.transform(ps, lambda p: F.struct(p.cast("int").alias("p"), t.cast("int").alias("t")))))
    hits = F.transform(F.array_sort(hits), lambda h, i: F.struct(h["p"].alias("p"), h["t"].alias("t"), i.cast("int").alias("i")))
    none = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("p"))
    start = F.struct(F.array_repeat(none, n_terms).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("rank"))

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda x, t: F.when(t == h["t"], F.struct(h["i"].alias("i"), h["p"].alias("p"))).otherwise(x))
        first = F.array_min(last)  # the earliest of the terms' last hits; -1 while a term is missing
        cover = (first["i"] >= 0) & (first["p"] > s["begin"])
        between = F.greatest(F.lit(0), h["p"] - first["p"] - (h["i"] - first["i"]))
        return F.struct(last.alias("last"), F.when(cover, first["p"]).otherwise(s["begin"]).alias("begin"), (s["rank"] + F.when(cover, weight / (1 + between)).otherwise(0.0)).alias("rank"))

    return F.aggregate(hits, start, step, lambda s: s["rank"])


def match(index: DataFrame, terms: list[str]) -> DataFrame:
    """(url, text_rank) of the urls whose body has all terms; no terms match nothing."""
    if not terms:
        return index.select("url", F.lit(0.0).alias("text_rank")).where(F.lit(False))
    hits = index.where(F.col("term").isin(terms))
    if len(terms) == 1:
        rank = F.sum(F.when(F.col("field") == "title", WEIGHT * TITLE_BOOST * F.col("tf")).otherwise(WEIGHT * F.col("tf")))
        return hits.groupBy("url").agg(rank.alias("text_rank"), F.max(F.col("field") == "body").alias("_in")).where("_in").drop("_in")
    # at most one array a term
    by = hits.groupBy("url", "field").agg(F.collect_list("positions").alias("p"), F.count("*").alias("k")).where(F.col("k") == len(terms))
    ranked = by.withColumn("r", cover_rank(F.col("p"), len(terms)) * F.when(F.col("field") == "title", TITLE_BOOST).otherwise(1))
    return ranked.groupBy("url").agg(F.sum("r").alias("text_rank"), F.max(F.col("field") == "body").alias("_in")).where("_in").drop("_in")


def root_set(matched: DataFrame, limit: int = ROOT_LIMIT) -> DataFrame:
    return matched.orderBy(F.desc("text_rank"), "url").limit(limit)


def base_set(matched: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """Sources of cross-site links into any match, with the attributes of the page they link to."""
    into = links.where("is_cross_site").select(F.col("url").alias("source_url"), F.col("to_url").alias("url"))
    return matched.select("url").join(into, "url").join(pages.select("url", "content_type", "size", "content_hash"), "url").select(F.col("source_url").alias("url"), "content_type", "size", "content_hash")


def first_wins(root: DataFrame, base: DataFrame) -> DataFrame:
    """All nodes, of the root set where a url is in both."""
    only = base.join(root.select("url"), "url", "left_anti").groupBy("url").agg(F.min(F.struct(*[F.col(c) for c in base.columns if c != "url"])).alias("_v")).select("url", "_v.*")
    return root.unionByName(only, allowMissingColumns=True)


def size_discount(size: Column) -> Column:
    """Long pages weigh less: above 48 kB by a logarithm of full steps of 3 kB."""
    return F.when(size > 48000, 1 / F.log(F.exp(F.lit(1.0)) + F.floor((size - 48000) / 3000))).otherwise(F.lit(1.0))


def fuse(score: Column, top: Column, text_rank: Column, size: Column) -> Column:
    """Harmonic mean of the link boost and the discounted text rank."""
    boost = F.exp(score / F.when(top == 0, F.lit(1.0)).otherwise(top) * 6.5)
    rank = text_rank * size_discount(size)
    return F.when(boost + rank > 0, 2 * boost * rank / (boost + rank)).otherwise(0.0)


def canonical(url: str, strip: bool) -> str:
    for part in ("/~", "/users", "/user"):
        url = url.replace(part, "\x00")
    return url[:-1] if strip and url.endswith("/") else url


def merge_copies(rows: list[dict], better: bool = False) -> list[dict]:
    """rows of one content hash, in order: copies of one host, path or user page merge and keep the higher score; a mirror of a kept page goes.

    better: the row with the higher score stands for both, as in fold_copies(); otherwise the first one takes over the score.
    """
    kept: list[dict] = []
    for r in rows:
        if r["size"] == 0 or not r["content_hash"]:
            kept.append(r)
            continue
        for i, k in enumerate(kept):
            if k["size"] == 0:
                continue
            same = r["host"] == k["host"] or r["path"] == k["path"] or k["url"].endswith(r["host"] + r["path"]) or canonical(r["url"], True) == canonical(k["url"], False)
            if same and better:
                kept[i] = r if r["score"] > k["score"] else k
                break
            if same:
                k["score"] = max(k["score"], r["score"])
                break
            if r["url"].endswith(k["host"] + k["path"]):
                break
        else:
            kept.append(r)
    return kept


def canonical_url(url: Column) -> Column:
    """canonical() as an expression."""
    for part in ("/~", "/users", "/user"):
        url = F.replace(url, F.lit(part), F.lit("\x00"))
    return url


def fold_copies(rows: Column) -> Column:
    """merge_copies() of an ordered array of structs (url, host, path, ...), as an expression: of merged copies the one with the higher score stays."""

    def step(kept: Column, r: Column) -> Column:
        own = F.regexp_replace(canonical_url(r["url"]), "/$", "")
        # 1: the same page, 2: a mirror of a kept one
        same = lambda k: (r["host"] == k["host"]) | (r["path"] == k["path"]) | F.endswith(k["url"], F.concat(r["host"], r["path"])) | (own == canonical_url(k["url"]))
        kinds = F.transform(kept, lambda k: F.when(same(k), 1).when(F.endswith(r["url"], F.concat(k["host"], k["path"])), 2).otherwise(0))
        at = F.array_position(F.transform(kinds, lambda x: x > 0), True)
        return F.when(at == 0, F.concat(kept, F.array(r))).otherwise(F.transform(kept, lambda k, i: F.when((i + 1 == at) & (F.get(kinds, i) == 1) & (r["score"] > k["score"]), r).otherwise(k)))

    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def dedup(ranked: DataFrame) -> DataFrame:
    """ranked (url, host, path, content_hash, size, text_rank, score): rows of a hash are folded in the order of text rank. A hash's rows are copies among one query's matches.

    Rows of a hash whose host and path nobody else has are not told apart from others beforehand: the rules look at both, so a hash is one
    array of narrow structs.
    """
    cols = ["url", "host", "path", "content_hash", "size", "text_rank", "score"]
    unique = ranked.where("coalesce(size, 0) = 0 or coalesce(content_hash, '') = ''").select(*cols)
    copies = ranked.where("size > 0 and content_hash <> ''").groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct((-F.col("text_rank")).alias("_rank"), "url", F.lower("host").alias("host"), "path", "size", "score"))).alias("rows"))
    # most hashes have one row, and nothing to fold
    left = F.when(F.size("rows") == 1, F.col("rows")).otherwise(fold_copies(F.col("rows")))
    out = copies.select("content_hash", F.explode(left).alias("r")).select("r.url", "r.host", "r.path", "content_hash", "r.size", (-F.col("r._rank")).alias("text_rank"), "r.score")
    return out.unionByName(unique)


def page_of(df: DataFrame, page: int, order: list[Column], per_page: int = PER_PAGE) -> DataFrame:
    """The rows of a page from 1; a page past the end is empty."""
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def page_count(total: Column, per_page: int = PER_PAGE) -> Column:
    return F.ceil(total / per_page)


def headline(body: str | None, terms: list[str], min_words: int = 23, max_words: int = 37, first: int = 4999) -> str:
    """The fragment of max_words words at most with most hits, hits in brackets."""
    words = (body or "")[:first].split()
    if not words:
        return "No preview provided"
    hit = [any(t in terms for t in re.findall(r"[^\W_]+", w.lower())) for w in words]
    sums = np.concatenate([[0], np.cumsum(hit)])
    at = np.arange(len(words))
    best = int(np.argmax(sums[np.minimum(at + max_words, len(words))] - sums[at]))
    start = max(0, min(best, len(words) - min_words))
    return " ".join(f"[{w}]" if h else w for w, h in list(zip(words, hit))[start : start + max_words])


def search(pages: DataFrame, index: DataFrame, links: DataFrame, query: str, page: int = 1, algorithm: str = "salsa", local_graph: bool = False) -> DataFrame:
    """One page of results, best first: url, title, score, size, content_type, last_crawl_success_at, preview.

    local_graph ranks the query's graph in the driver's memory (see graph.rank).

    pages and index are read by column: ranking sees narrow columns only, and bodies are joined for the rows of the page alone.
    """
    spark = pages.sparkSession
    q = querylang.parse_query(query)
    terms = terms_of(spark, " ".join([q.text, *(f.value for f in q.titles if not f.negate)]))
    if not terms:
        raise ValueError("the query has no text")
    narrow = pages.select("url", "domain_name", "content_type", "size", F.col("indexed_content_hash").alias("content_hash"), "title", U.parse_url(F.col("url"))["path"].alias("path"))
    matched = match(index, terms)
    root = root_set(matched).join(narrow, "url")
    nodes = first_wins(root.select("url", "text_rank"), base_set(matched, links, narrow).select("url"))
    edges = graph.subgraph_edges(root.select("url"), nodes.select("url"), links)
    scores = graph.rank(nodes.select(F.col("url").alias("node")), edges, algorithm, local_graph)
    top = scores.agg(F.max("score").alias("top"))
    fused = root.join(scores.withColumnRenamed("node", "url"), "url", "left").crossJoin(F.broadcast(top))  # top: one row
    fused = fused.withColumn("score", fuse(F.coalesce("score", F.lit(0.0)), F.coalesce("top", F.lit(0.0)), F.col("text_rank"), F.col("size")))
    shown = dedup(fused.withColumnRenamed("domain_name", "host"))
    shown = shown.join(narrow.select("url", "domain_name", "content_type", "title"), "url").where(querylang.filter_column(q.filters))
    visible = page_of(shown.select("url", "score"), page, [F.desc("score"), F.col("url")])

    @F.pandas_udf("string")
    def preview(s):
        return s.map(lambda x: headline(x, terms))

    body = pages.select("url", "title", "size", "content_type", "last_crawl_success_at", "content_body")
    out = visible.join(body, "url").withColumn("preview", T.clean_preview(preview(F.substring("content_body", 1, 4999)))).drop("content_body")
    return out.withColumn("title", T.clean_title(F.col("title"))).orderBy(F.desc("score"), "url")
