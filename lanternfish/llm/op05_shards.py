"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of (doc_id, size, checksum, hash), whatever files they come from; a generalised Feistel network over
[0, a * b), a * b >= n, permutes the numbers, and numbers that fall outside [0, n) walk on along their cycle. Shard and slot of a row
are computed from its permuted number alone: shard = p mod shards, slot = p div shards. Counts of shards differ by one at most.

Row numbers come from a range sort of narrow rows (no text), counts a partition and their prefix sums: no task sees all rows.

Defined results: a null text has no bytes and the checksum of none; null doc_ids come first; repeated rows get different places and
may swap them among each other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.llm import common as C

SHARDS = 24
SEED = 20240607
ROUNDS = 6
WALK = 64


def permuted(x: str, n: int, seed: int = SEED, rounds: int = ROUNDS, walk: int = WALK) -> Column:
    """A permutation of 0..n-1 (n >= 1) as an expression of column x.

    A round turns v = l * k + r (l < m, r < k) into r * m + (l + f(r)) mod m; m and k swap each time, so every round is a bijection.
    """
    a = int(n**0.5)
    while a * a < n:
        a += 1
    b = -(-n // a)
    keys = ", ".join(f"struct({r} as r, {(a, b)[r % 2]}L as m, {(b, a)[r % 2]}L as k)" for r in range(rounds))
    once = "aggregate(array(" + keys + "), {v}, (s, q) -> (s % q.k) * q.m + (s div q.k + cast(conv(substr(md5(concat_ws(':', " + str(seed) + ", q.r, s % q.k)), 1, 13), 16, 10) as bigint) % q.m) % q.m)"
    # a cycle holds at most a * b - n numbers outside in a row; of n at a walk of 64 none goes on with a chance above n ** -31, and if one does, it walks to the end
    whole = a * b - n + 1
    on = lambda w: f"case when {w} < {n}L then {w} else {once.format(v=w)} end"
    end = f"w -> case when w < {n}L then w else aggregate(sequence(1, {whole}), w, (u, j) -> {on('u')}) end" if whole > walk else "w -> w"
    return F.expr(f"aggregate(sequence(1, {min(whole, walk)}), {once.format(v=f'cast({x} as bigint)')}, (w, i) -> {on('w')}, {end})")


def row_numbers(keyed: DataFrame, order: list[str], name: str) -> DataFrame:
    """keyed with the number of each row in the given order, from 0; keyed should be narrow and is written once."""
    n = C.shuffle_partitions(keyed.sparkSession)
    at = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    at = C.materialize(at.withColumn("_part", F.shiftright("_m", 33)).withColumn("_in", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), "row-numbers")
    # one row a partition
    counts = at.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    return at.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def shards(docs: DataFrame, count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, row_number, shard, slot)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64("text").alias("_h"))
    numbered = row_numbers(keyed, ["doc_id", "size", "text_crc32", "_h"], "row_number")
    n = max(1, numbered.count())
    p = numbered.withColumn("_p", permuted("row_number", n, seed))
    return p.select("doc_id", "size", "text_crc32", "row_number", F.pmod("_p", F.lit(count)).cast("int").alias("shard"), F.expr(f"_p div {count}").alias("slot"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = shards(C.read(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _rounds_sql(v: str) -> str:
    """The rounds of the network as nested structs of SQL: column p after them, from column v of walk."""
    for r in range(ROUNDS):
        m, k = (("a", "b"), ("b", "a"))[r % 2]
        v = f"(SELECT (s.v % {k}) * {m} + (s.v // {k} + ('0x' || left(md5('{SEED}:{r}:' || (s.v % {k})), 13))::bigint % {m}) % {m} FROM (SELECT {v} AS v) s)"
    return v


#: DuckDB has no checksum function: the table of its remainders comes from the rule, and bytes go through it one by one.
ORACLE = f"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::bigint, c // 2) ELSE c // 2 END, i) AS c FROM range(0, 256) x(i))),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''), lambda x: ('0x' || x)::bigint) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(tab[xor(c % 256, x) + 1], c // 256), 4294967295::bigint), 4294967295::bigint) AS text_crc32 FROM d, tab),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_number FROM c),
s AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::bigint AS a FROM n),
t AS (SELECT n, a, (n + a - 1) // a AS b FROM s),
walk AS (SELECT row_number, 0 AS steps, row_number AS v, n, a, b FROM n, t UNION ALL SELECT row_number, steps + 1, {_rounds_sql('walk.v')}, n, a, b FROM walk WHERE steps = 0 OR v >= n)
SELECT doc_id, size::bigint AS size, text_crc32, 'rows' AS law, (v % {SHARDS})::int AS shard, v // {SHARDS} AS slot, NULL::int AS grown_shard, row_number FROM n JOIN walk USING (row_number) WHERE steps > 0 AND v < walk.n"""
