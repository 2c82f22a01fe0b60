"""Link analysis on edge tables (src, dst): HITS and SALSA, backlinks, degrees. Edges count as often as they occur."""

from __future__ import annotations

import logging
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions import urls as U

ITERATIONS = 300
EPSILON = 1.1920929e-07
#: The most edges and nodes that rank() takes into the driver's memory where it is asked to (some tens of MB).
LOCAL_ROWS = 500_000


def subgraph_edges(root, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Cross-site links out of root pages, and links into root pages, both ends among nodes, no loops. An edge between root pages comes twice."""
    cross = links.where("is_cross_site").select(F.col("url").alias("src"), F.col("to_url").alias("dst")).where("src <> dst")
    known = nodes.select(F.col("url").alias("n"))
    both = cross.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi").select("src", "dst")
    out = both.join(root.select(F.col("url").alias("src")), "src", "left_semi").select("src", "dst")
    into = both.join(root.select(F.col("url").alias("dst")), "dst", "left_semi").select("src", "dst")
    return out.unionAll(into)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, indeg, outdeg) of every node of edges."""
    d = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return d.groupBy("node").agg(F.sum("i").alias("indeg"), F.sum("o").alias("outdeg"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared checkpoint folder: plans of iterations would grow with each turn."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="lanternfish-"))
    return df.checkpoint()


def hits_step(state: DataFrame, edges: DataFrame) -> DataFrame:
    """state (node, auth, hub): authority from hubs that link here, hub from authorities linked to; a node without keeps its value; sums above 1 are scaled to 1."""
    auth = edges.join(state.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("hub").alias("a"))
    hub = edges.join(state.select(F.col("node").alias("dst"), "auth"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("auth").alias("h"))
    keep = lambda new, old: F.when(F.coalesce(new, F.lit(0.0)) == 0, old).otherwise(new)
    new = state.join(auth, "node", "left").join(hub, "node", "left").select("node", F.col("auth").alias("auth0"), F.col("hub").alias("hub0"), keep(F.col("a"), F.col("auth")).alias("auth"), keep(F.col("h"), F.col("hub")).alias("hub"))
    total = new.agg(F.greatest(F.sum("auth"), F.lit(1.0)).alias("sa"), F.greatest(F.sum("hub"), F.lit(1.0)).alias("sh"))
    return new.crossJoin(F.broadcast(total)).select("node", (F.col("auth") / F.col("sa")).alias("auth"), (F.col("hub") / F.col("sh")).alias("hub"), "auth0", "hub0")  # total: one row


def hits(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, epsilon: float = 0.005, exact_steps: bool = False) -> DataFrame:
    """(node, score: authority). exact_steps: all iterations, without a test for the end."""
    n = max(1, nodes.count())
    state = nodes.select("node", F.lit(1.0 / n).alias("auth"), F.lit(1.0 / n).alias("hub"))
    for _ in range(iterations):
        new = cut(hits_step(state, edges))
        if exact_steps:
            state = new.select("node", "auth", "hub")
            continue
        delta = new.agg(F.sum(F.abs(F.col("auth") - F.col("auth0")) + F.abs(F.col("hub") - F.col("hub0")))).first()[0] or 0.0
        state = new.select("node", "auth", "hub")
        if delta <= epsilon:
            break
    return state.select("node", F.when(F.col("auth") < EPSILON, 0.0).otherwise(F.col("auth")).alias("score"))


def salsa_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with is_auth (more edges in than out), and edges between the two classes with the degrees of the remaining graph."""
    kinds = nodes.join(degrees(edges), "node", "left").select("node", (F.coalesce("indeg", F.lit(0)) > F.coalesce("outdeg", F.lit(0))).alias("is_auth"))
    e = edges.join(kinds.toDF("src", "sa"), "src").join(kinds.toDF("dst", "da"), "dst").where("sa <> da").select("src", "dst", F.col("sa").alias("src_auth"))
    outs = e.groupBy("src").agg(F.count("*").alias("n_out"))
    ins = e.groupBy("dst").agg(F.count("*").alias("n_in"))
    return kinds, e.join(outs, "src").join(ins, "dst")


def salsa_step(state: DataFrame, e: DataFrame) -> DataFrame:
    """state (node, is_auth, score). Authorities: over links in, the mean over the source's links of each target's share; hubs alike over links out."""
    score = state.select("node", "score")
    # what each source collects from its targets, for authorities; what each target collects from its sources, for hubs
    up = e.join(score.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg((F.sum(F.col("score") / F.col("n_in")) / F.max("n_out")).alias("v"))
    down = e.join(score.withColumnRenamed("node", "src"), "src").groupBy("dst").agg((F.sum(F.col("score") / F.col("n_out")) / F.max("n_in")).alias("v"))
    auth = e.join(up, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("v").alias("va"))
    hub = e.join(down, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("v").alias("vh"))
    total = state.agg(F.greatest(F.sum("score"), F.lit(1.0)).alias("s"))  # of the old scores
    new = state.join(auth, "node", "left").join(hub, "node", "left").crossJoin(F.broadcast(total))  # total: one row
    return new.select("node", "is_auth", F.col("score").alias("score0"), (F.coalesce(F.when(F.col("is_auth"), F.col("va")).otherwise(F.col("vh")), F.lit(0.0)) / F.col("s")).alias("score"))


def salsa(nodes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS, epsilon: float = 0.01, exact_steps: bool = False) -> DataFrame:
    """(node, score)."""
    kinds, e = salsa_graph(nodes, edges)
    kinds, e = cut(kinds), cut(e)
    sizes = kinds.groupBy("is_auth").agg(F.count("*").alias("k"))  # two rows
    state = kinds.join(F.broadcast(sizes), "is_auth").select("node", "is_auth", (1.0 / F.col("k")).alias("score"))
    for _ in range(iterations):
        new = cut(salsa_step(state, e))
        if exact_steps:
            state = new.select("node", "is_auth", "score")
            continue
        delta = new.agg(F.sum(F.abs(F.col("score") - F.col("score0")))).first()[0] or 0.0
        state = new.select("node", "is_auth", "score")
        if delta <= epsilon:
            break
    return state.select("node", "score")


def local_rank(n: int, src: np.ndarray, dst: np.ndarray, algorithm: str) -> np.ndarray:
    """Scores of nodes 0..n-1 by the same rules in memory."""
    total = lambda at, v: np.bincount(at, v, n)
    if algorithm == "hits":
        auth = hub = np.full(n, 1.0 / n)
        for _ in range(ITERATIONS):
            a, h = total(dst, hub[src]), total(src, auth[dst])
            a, h = np.where(a == 0, auth, a), np.where(h == 0, hub, h)
            a, h = a / max(a.sum(), 1.0), h / max(h.sum(), 1.0)
            delta = np.abs(a - auth).sum() + np.abs(h - hub).sum()
            auth, hub = a, h
            if delta <= 0.005:
                break
        return np.where(auth < EPSILON, 0.0, auth)
    one = np.ones(len(src))
    is_auth = total(dst, one) > total(src, one)
    keep = is_auth[src] != is_auth[dst]
    src, dst = src[keep], dst[keep]
    n_out, n_in = np.maximum(total(src, one[keep]), 1), np.maximum(total(dst, one[keep]), 1)
    score = 1.0 / np.where(is_auth, max(is_auth.sum(), 1), max((~is_auth).sum(), 1))
    for _ in range(ITERATIONS):
        up, down = total(src, score[dst] / n_in[dst]) / n_out, total(dst, score[src] / n_out[src]) / n_in
        new = np.where(is_auth, total(dst, up[src]), total(src, down[dst])) / max(score.sum(), 1.0)
        delta = np.abs(new - score).sum()
        score = new
        if delta <= 0.01:
            break
    return score


def rank(nodes: DataFrame, edges: DataFrame, algorithm: str = "salsa", local: bool = False) -> DataFrame:
    """(node, score) of a query's graph; nodes are distinct. By joins, whatever the size; local: in the driver's memory, an error above LOCAL_ROWS."""
    if algorithm not in ("hits", "salsa"):
        logging.getLogger(__name__).warning("no ranking algorithm %r; taking salsa", algorithm)
        algorithm = "salsa"
    if not local:
        nodes, edges = cut(nodes), cut(edges)
        return hits(nodes, edges) if algorithm == "hits" else salsa(nodes, edges)
    some_edges, some = edges.select("src", "dst").limit(LOCAL_ROWS + 1).toPandas(), nodes.select("node").limit(LOCAL_ROWS + 1).toPandas()
    if max(len(some_edges), len(some)) > LOCAL_ROWS:
        raise ValueError(f"more than {LOCAL_ROWS} edges or nodes are not ranked in memory")
    names = pd.Index(some["node"])
    score = local_rank(len(names), names.get_indexer(some_edges["src"]), names.get_indexer(some_edges["dst"]), algorithm)
    return nodes.sparkSession.createDataFrame(pd.DataFrame({"node": names, "score": score}), "node string, score double")


def backlinks(links: DataFrame, url: str) -> DataFrame:
    """(is_cross_site, n, urls) of the pages that link to url: two rows, for a report of one page. backlink_rows() has a row a link."""
    return backlink_rows(links, url).groupBy("is_cross_site").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("url")).alias("urls"))


def backlink_rows(links: DataFrame, url: str) -> DataFrame:
    """(url, is_cross_site) of each link to url; a url without a protocol is tried as gemini://."""
    got = links.sparkSession.range(1).select(*[F.when(u["good"], U.format_url(u)) for u in (U.parse_url(F.lit(x)) for x in (url, "gemini://" + url))]).first()
    return links.where(F.col("to_url").isin(list({x for x in (url, got[0] or got[1]) if x}))).select("url", "is_cross_site")
