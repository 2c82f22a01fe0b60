"""Best-fit packing: few-document length patterns fitted to the histogram by non-negative least squares.

Token ids of a document, then END, are cut into pieces of CONTEXT ids where they are longer. The histogram of piece lengths (CONTEXT
numbers at most, whatever the corpus) goes to the driver. There all patterns of up to three lengths that fill a sequence exactly are
enumerated, repeat counts are fitted to the histogram by coordinate descent, rounded, clipped to what there is, and the
residual is packed best fit decreasing, many equal bins at a time. The plan says for each length which ranks go to which sequence
and offset; it holds at most one entry for each pattern and place, a number bounded by CONTEXT alone.

Ranks within a length are counts made while tokenizing a partition plus the sums over earlier partitions, so no task sees all pieces
of a length, and the pieces are found again by binary search in the plan. Texts are tokenized once; only narrow rows are kept.

Defined results: null and empty texts are one piece of the id END; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.llm import common as C
from lanternfish.llm import tokens

CONTEXT = 2048
#: Lengths are kept in 16 bits.
MOST = (1 << 16) - 1
ROUNDS = 3
CONVERGED = 1e-3
END = b"\0\0\0\0"
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"


def pieces(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece, with its rank in its partition and length; with its ids if asked for."""
    path = vocabulary or tokens.vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, ranks = tokens.chunk_ids(path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = known.of(text.as_py() or "") + END
                for k, at in enumerate(range(0, len(data), 4 * context)):
                    one = data[at : at + 4 * context]
                    n = len(one) // 4
                    out.append((doc, k, at // 4, n, zlib.crc32(one), part, ranks[n], one))
                    ranks[n] += 1
            cols = list(zip(*out)) or [[]] * 8
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 7 + ids], names=names[: 7 + ids])
        known.forget()
        C.tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECE + (", ids binary" if ids else ""))


def fit_patterns(hist: np.ndarray, context: int = CONTEXT, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of one to three lengths that sum to context, with rounded repeat counts that hist (index: length) allows.

    min |A x - hist|, x >= 0, by coordinate descent from zero: each pattern in turn takes the step that is best for it, which leaves
    few patterns with many repeats. It ends when a round moves less than CONVERGED of the pieces, or after rounds rounds: later ones
    hardly change what rounding and the packing of the rest make of it.
    """
    if context > MOST:
        raise ValueError(f"a context above {MOST} is not packed")
    have = np.flatnonzero(hist)
    # packed arrays, a longest length at a time: as many Python numbers, or all pairs at once, would fill the driver's memory
    i, j, k = array("H"), array("H"), array("H")
    for a in have[::-1].tolist():  # long ones first, as they fit in few patterns
        b = have[(have <= a) & (have <= context - a) & (2 * have >= context - a)][::-1]
        c = context - a - b
        ok = (c == 0) | (hist[c] > 0)
        i.extend(array("H", [a]) * int(ok.sum()))
        j.frombytes(b[ok].astype(np.uint16).tobytes())
        k.frombytes(c[ok].astype(np.uint16).tobytes())
    r, x = hist.tolist(), array("d", bytes(8 * len(i)))
    r[0] = 0.0
    for _ in range(rounds):
        moved = 0.0
        for p, (a, b, c) in enumerate(zip(i, j, k)):
            # column of A: how often each length is in the pattern; length 0 is none
            if c:
                norm = 3 if a != b and b != c else 9 if a == c else 5
                step = (r[a] + r[b] + r[c]) / norm
            else:
                step = (r[a] + r[b]) / (2 if a != b else 4)
            if step < 0 and step < -x[p]:
                step = -x[p]
            if step:
                moved += abs(step)
                x[p] += step
                r[a] -= step
                r[b] -= step
                if c:
                    r[c] -= step
        if moved <= CONVERGED * hist.sum():
            break
    left = hist.copy()
    out = [((context,), int(hist[context]))] if hist[context] else []
    for p in np.argsort(-np.frombuffer(x), kind="stable") if len(x) else ():
        n = int(x[p] + 0.5)
        if n < 1:
            break
        one = tuple(v for v in (i[p], j[p], k[p]) if v)
        n = min([n, *(int(left[v]) // one.count(v) for v in one)])
        if n > 0:
            for v in one:
                left[v] -= n
            out.append((one, n))
    return out


def best_fit(hist: np.ndarray, context: int = CONTEXT) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram: equal bins are filled together."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for size in np.flatnonzero(hist)[::-1].tolist():
        n = int(hist[size])
        while n:
            room = next((r for r in range(size, context) if bins.get(r)), None)
            if room is None:
                fit = context // size
                if n >= fit:
                    bins[context - fit * size].append(((size,) * fit, n // fit))
                    n %= fit
                if n:
                    bins[context - n * size].append(((size,) * n, 1))
                break
            one, count = bins[room].pop()
            if count > n:
                bins[room].append((one, count - n))
                count = n
            bins[room - size].append(((*one, size), count))
            n -= count
    return [x for group in bins.values() for x in group]


def plan(hist: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted keys (length << 40 | first rank), base (sequence of the first rank) and offset of each run; the number of sequences."""
    packs = fit_patterns(hist, context)
    left = hist.copy()
    for one, n in packs:
        for v in one:
            left[v] -= n
    packs += best_fit(left, context)
    used, keys, bases, offsets, total = defaultdict(int), [], [], [], 0
    for one, n in packs:
        at = 0
        for v in one:
            keys.append(v << 40 | used[v])
            bases.append(total)
            offsets.append(at)
            used[v] += n
            at += v
        total += n
    assert all(used[v] == hist[v] for v in range(1, context + 1))
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(bases, np.int64)[order], np.array(offsets, np.int64)[order], total


def pack(docs: DataFrame, vocabulary: str | None = None, context: int = CONTEXT) -> DataFrame:
    """Pieces with their sequence and offset, as a written table."""
    spark = docs.sparkSession
    with C.Scratch() as scratch:
        with C.text_batches(spark):
            cut = scratch.keep(pieces(docs, vocabulary, context), "pieces")
        counts = cut.groupBy("_part", "length").agg(F.count("*").alias("_n"))
        before = counts.select("_part", "length", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
        hist = np.zeros(context + 1, np.int64)
        for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # context rows at most
            hist[r["length"]] = r["n"]
        runs = spark.sparkContext.broadcast(plan(hist, context)[:3])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, bases, offsets = runs.value
            for batch in batches:
                length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
                key = length << 40 | rank
                at = np.searchsorted(keys, key, side="right") - 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bases[at] + key - keys[at]), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        ranked = cut.join(before, ["_part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("rank"))
        out = C.materialize(ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"), "packed")
        runs.destroy()
        return out


def op6_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"))
