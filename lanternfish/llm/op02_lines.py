"""Line dedup: lines that several documents share stay only in the smallest doc_id that holds them.

Lines' key hashes (128 bits) are range-partitioned by (key, doc_id) and sorted within by (key, doc_id, position), so that a line of
a third of all documents is spread over many tasks. Each task streams its rows and emits the later documents' positions. Only rows
of the first key of a task are open, as an earlier task may hold a smaller doc_id of that key; each task also emits the first
doc_id of its last key, one row a task, and these rows decide the open ones. Positions become one compressed bitmap a document; no
text is shuffled with the keys.

Defined results: null or empty text is one empty line, which stays; keys under MIN_CHARS code points stay; a null doc_id neither
drops nor holds lines; rows that share doc_id are one document (told apart by a hash of their text where it differs, and then the
same doc_id does not drop its own lines); an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.llm import common as C

MIN_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() does that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row: hash of the text, pos, h1, h2) of each line whose key counts."""
    d = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    d = d.select("doc_id", "row", "pos", F.btrim("line", F.lit(C.WS_CHARS)).alias("key")).where(F.length("key") >= min_chars)
    d = d.select("doc_id", "row", "pos", ascii_lower(F.col("key")).alias("key"))
    return d.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


DROP, OPEN, LAST = 0, 1, 2
_STREAM = "kind int, doc_id long, row long, pos int, h1 long, h2 long"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, doc_id, row, pos) -> drops, open rows and the first document of the last key."""
    first_key, key, holder = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, row, pos, h1, h2 = (batch.column(c).to_numpy() for c in ("doc_id", "row", "pos", "h1", "h2"))
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if key is not None:
            new[0] = (h1[0], h2[0]) != key
        else:
            first_key = (h1[0], h2[0])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: goes on from the last batch
        holders = np.append(doc[starts], holder if holder is not None else 0)
        held_by = holders[run]  # index -1 is the holder carried over
        drop = doc != held_by
        first = (h1 == first_key[0]) & (h2 == first_key[1]) & ~drop
        out = np.flatnonzero(drop | first)
        key, holder = (h1[-1], h2[-1]), held_by[-1]
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(np.where(drop[out], DROP, OPEN).astype(np.int32)), pa.array(doc[out]), pa.array(row[out]), pa.array(pos[out]), pa.array(h1[out]), pa.array(h2[out])], names=["kind", "doc_id", "row", "pos", "h1", "h2"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([LAST], pa.int32()), pa.array([holder], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32()), pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64())], names=["kind", "doc_id", "row", "pos", "h1", "h2"])


@F.pandas_udf(T.BinaryType())
def _bitmap(positions: pd.Series) -> pd.Series:
    def one(p: np.ndarray) -> bytes:
        keep = np.ones(int(max(p)) // 8 * 8 + 8, bool)
        keep[p] = False
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return positions.map(one)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, partitions: int | None = None) -> DataFrame:
    """(doc_id, row, n_dropped, keep), a written table: a zlib-compressed bitmap for each document that loses lines; bit i (from the left) is 1 if line i stays, and lines past its last dropped one stay."""
    n = partitions or C.shuffle_partitions(docs.sparkSession)
    with C.Scratch() as scratch:
        # written, as finding the ranges' bounds reads the keys once more
        keys = scratch.keep(line_keys(docs, min_chars), "line-keys")
        keys = keys.repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "row", "pos")
        found = scratch.keep(keys.mapInArrow(_stream, _STREAM), "line-drops")
        first = found.where(F.col("kind") == LAST).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        late = found.where(F.col("kind") == OPEN).join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id", "row", "pos")
        drops = found.where(F.col("kind") == DROP).select("doc_id", "row", "pos").unionByName(late)
        per = drops.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("p"))
        return C.materialize(per.select("doc_id", "row", F.size("p").cast("long").alias("n_dropped"), _bitmap("p").alias("keep")), "keep-bitmaps")


@F.pandas_udf(T.StringType())
def _apply(text: pd.Series, keep: pd.Series) -> pd.Series:
    def one(t: str | None, b: bytes | None) -> str | None:
        if t is None or b is None:
            return t
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8))[: len(lines)].astype(bool).tolist()
        return "\n".join([x for x, k in zip(lines, bits) if k] + lines[len(bits) :])

    return pd.Series([one(t, b) for t, b in zip(text, keep)], dtype=object)


def dedup_lines(docs: DataFrame, n_dropped: str | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text that stays, and with the count of dropped lines where a name for it is given. Only documents that lose lines, and some more, are shuffled to their bitmaps."""
    maps, cols = keep_bitmaps(docs, min_chars), docs.columns
    taken = [C.fresh(docs, x) for x in ("_id", "_row", "_keep", "_n", "_some")]
    flagged = C.maybe(docs, maps.select("doc_id"), maps.count(), taken[4])
    maps = maps.toDF(taken[0], taken[1], taken[3], taken[2])
    some = flagged.where(taken[4])
    d = some.join(maps, (some["doc_id"].cast("long") == F.col(taken[0])) & (F.xxhash64(some["text"]) == F.col(taken[1])), "left")
    # only texts that lose lines go to Python
    cut = _apply(F.when(F.col(taken[2]).isNotNull(), F.col("text")), F.col(taken[2]))
    text = F.when(F.col(taken[2]).isNull(), F.col("text")).otherwise(cut)
    lost = [F.coalesce(F.col(taken[3]), F.lit(0)).cast("long").alias(n_dropped)] if n_dropped else []
    d = d.select(*[text.alias(c) if c == "text" else F.col(c) for c in cols], *lost)
    whole = flagged.where(~F.col(taken[4])).select(*cols, *([F.lit(0).cast("long").alias(n_dropped)] if n_dropped else []))
    return whole.unionByName(d)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    return dedup_lines(docs, "n_dropped").select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def oracle_ctes(source: str, out: str) -> str:
    """CTEs that end in {out}: the rows of {source} with the text that stays in column kept and n_lines, n_dropped."""
    return f"""
l1 AS (SELECT *, row_number() OVER () AS lid, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
l2 AS (SELECT lid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l1),
l3 AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l2),
l4 AS (SELECT key, min(doc_id) AS first FROM l3 WHERE length(key) >= {MIN_CHARS} GROUP BY key),
l5 AS (SELECT lid, count(*) AS n_lines, count(*) FILTER (WHERE doc_id > first) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(doc_id > first, false)), '') AS kept FROM l3 LEFT JOIN l4 USING (key) GROUP BY lid),
{out} AS (SELECT l1.* EXCLUDE (lid, ls), n_lines, n_dropped, kept FROM l1 JOIN l5 USING (lid))"""


ORACLE = f"WITH {oracle_ctes('documents', 'deduped')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped"
