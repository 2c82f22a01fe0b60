"""Mixing sources to target weights by whole documents.

Every row gets a hash-random key; within a source, rows are range-sorted by key and prefix sums of their word counts are cut at the
source's budget. A budget above the source's size first takes whole epochs, then cuts the last one. A document is in the last epoch
if its middle lies within what is left, so a source's words miss the target by half a document at most.

A source is cut into ranges of its keys, as many as its rows ask for, and prefix sums are made within ranges and over the ranges'
sums, so a source of a third of all rows is sorted by many tasks.

Targets: sources in code point order, null last, weigh WEIGHTS in turn and share SHARE of all words; a target stops at CAP times its
source's words, and what is over is dealt by weight to the others until none is above. That is one level per weight unit, found from
prefix sums over the sources in the order of size over weight.

Defined results: null and empty texts have size 0 and are in as their middle says, taking 0 words; sources without words have target
0; rows that tie in key, doc_id and size are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.llm import common as C

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 11
RANGE_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes: one row a source (source, n_rows, source_size) -> with weight and target. Windows without a key see one row a source."""
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    d = sizes.withColumn("_i", F.row_number().over(by_name) - 1)
    d = d.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") % len(weights) + 1).cast("int")).cast("long"))
    d = d.withColumn("_cap", cap * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_left", share * F.sum("source_size").over(Window.partitionBy()) - (F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap")))
    d = d.withColumn("_level", F.col("_left") / F.sum("weight").over(rest))
    # the level is that of the first source whose cap is above it; before it all are at their caps
    d = d.withColumn("_at", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(Window.partitionBy())["_level"])
    return d.select("source", "n_rows", "source_size", "weight", F.when(F.col("_at").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_at"))).alias("target"))


def takes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, row: hash of the text, source, size, source_size, target, epochs, taken) of each row of docs."""
    # rows without doc_id are told apart by their texts, so that they don't all fall into one range
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5("text"), F.lit(""))))))
    keyed = C.materialize(docs.select("doc_id", F.xxhash64("text").alias("row"), "source", C.n_words(F.col("text")).alias("size"), key.alias("_key")), "mix-sizes")
    sizes = keyed.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    goal = C.materialize(targets(sizes, weights, share, cap), "mix-targets")
    d = keyed.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "weight")
    d = d.withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) * F.ceil(F.col("n_rows") / RANGE_ROWS)).cast("long"))
    sums = d.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    w = Window.partitionBy("source").orderBy("_range")
    before = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), (F.sum("_sum").over(w) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_cum", F.sum("size").over(inside) - F.col("size"))
    d = d.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - F.col("_whole") * F.col("source_size")
    d = d.withColumn("_whole", whole)
    d = d.withColumn("epochs", F.col("_whole") + F.when(2 * (F.col("_before") + F.col("_cum")) + F.col("size") < 2 * left, 1).otherwise(0))
    return d.select("doc_id", "row", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows alike in doc_id, source and text are interchangeable."""
    # plain equal keys, so that the window and the join share one shuffle of the texts
    keys = lambda text_hash: [text_hash, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.concat(F.when(F.col("doc_id").isNull(), "n").otherwise("d"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")))]
    ours = [C.fresh(docs, x) for x in ("_k0", "_k1", "_k2", "_nth")]
    theirs = [C.fresh(docs, x) for x in ("_t0", "_t1", "_t2", "_rank", "_epochs")]
    t = takes(docs)
    t = t.select(*[k.alias(x) for k, x in zip(keys(F.col("row")), theirs)], F.col("epochs").alias(theirs[4]))
    t = t.withColumn(theirs[3], F.row_number().over(Window.partitionBy(*theirs[:3]).orderBy(theirs[4])))
    d = docs.withColumns(dict(zip(ours, keys(F.xxhash64("text")))))
    d = d.withColumn(ours[3], F.row_number().over(Window.partitionBy(*ours[:3]).orderBy(F.lit(1))))
    d = d.join(t, [F.col(a) == F.col(b) for a, b in zip(ours, theirs)])
    # a row taken k times comes k times
    return d.where(F.col(theirs[4]) > 0).withColumn(ours[0], F.explode(F.array_repeat(F.lit(1), F.col(theirs[4]).cast("int")))).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return takes(C.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def oracle_ctes(source: str, out: str) -> str:
    """CTEs that end in {out}: the rows of {source} with size, source_size, target, epochs, taken."""
    return f"""
m1 AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint AS size, md5({SEED} || ':' || coalesce(doc_id::varchar, 'null')) AS key FROM {source}),
m2 AS (SELECT source, sum(size)::bigint AS source_size FROM m1 GROUP BY source),
m3 AS (SELECT *, {list(WEIGHTS)}[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight FROM m2),
m4 AS (SELECT *, {CAP} * source_size AS cap, ({CAP} * source_size)::double / weight AS ratio FROM m3),
m5 AS (SELECT *, ({SHARE} * (SELECT sum(source_size) FROM m4)::double - (sum(cap) OVER w - cap)::double) / (sum(weight) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS level FROM m4 WINDOW w AS (ORDER BY ratio, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
m6 AS (SELECT *, (SELECT level FROM m5 WHERE ratio > level ORDER BY ratio, encode(source) NULLS LAST LIMIT 1) AS lvl FROM m5),
m7 AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN cap::double ELSE least(cap::double, weight * lvl) END AS target FROM m6),
m8 AS (SELECT m1.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS whole, sum(size) OVER (PARTITION BY m1.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::bigint - size AS cum FROM m1 JOIN m7 ON m1.source IS NOT DISTINCT FROM m7.source),
{out} AS (SELECT * EXCLUDE (key, whole, cum), whole + CASE WHEN 2 * cum + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END AS epochs, (whole + CASE WHEN 2 * cum + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * size AS taken FROM m8)"""


ORACLE = f"WITH {oracle_ctes('documents', 'mixed')} SELECT doc_id, size, source_size, target, taken, epochs FROM mixed"
