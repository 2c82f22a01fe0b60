"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

Features of a document are its lower-cased letter words, their first four to six letters and their last four, hashed into DIM places
and weighted by their share of the words (of SHRINK more, so that few words say little). One weight vector serves all thresholds: P(grade > k) = sigmoid(w.x - t_k), t_1 < t_2 < t_3,
and the expected severity is the sum of these over k. Grades of the labelled rows: 0 if not toxic; toxic ones get 1, 2 or 3 by
the third their share of telling words is in (words whose log odds between toxic and other fitted documents are above TELLING).

The model is fitted on at most FIT_ROWS labelled rows, a third of them toxic at most, those first in the order of a hash of doc_id;
that bound is the only sample. The cutoff of expected severity above which a document counts as toxic is set on all other labelled
rows, at least a quarter of them (on all if one kind is missing there): the one with the largest recall minus false positive rate among those with a false
positive rate of MAX_FPR at most. All documents are scored, whole texts, with the model (a few MB, whatever the corpus) broadcast.

Defined results: null, empty and wordless texts have no features, severity of the bare thresholds; labels that are null or
contradict each other are not used; without toxic or without other labels nothing is toxic and severity is 0; repeated rows are scored
each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import common as C

DIM = 1 << 17
FIT_ROWS = 3000
MIN_DOCS = 3
GRADES = 3
TELLING = 1.5
STEPS = 200
RIDGE = 1e-4
MAX_FPR = 0.01
SCALE = 20.0
SHRINK = 40
_WORD = re.compile(r"[^\W\d_]+")


def places(word: str) -> list[int]:
    parts = ["w" + word, *(f"p{k}{word[:k]}" for k in (4, 5, 6) if len(word) > k), *(["s" + word[-4:]] if len(word) > 4 else [])]
    return [zlib.crc32(p.encode()) % DIM for p in parts]


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    words = Counter(_WORD.findall((text or "").lower()))
    total = sum(words.values())
    at, value = [], []
    for w, c in words.items():
        p = places(w)
        at += p
        value += [SCALE * c / (total + SHRINK)] * len(p)
    return np.array(at, np.int32), np.array(value, np.float32)


class Model:
    """weights: float array of DIM; cuts: the GRADES ordered thresholds; limit: expected severity above which a text is toxic."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, limit: float = float("inf")):
        self.weights, self.cuts, self.limit, self.known = weights, cuts, limit, {}

    def score(self, text: str | None) -> float:
        """w.x, by the cached weight of each word."""
        words = _WORD.findall((text or "").lower())
        known, total = self.known, 0.0
        if len(known) > 500_000:
            known.clear()
        for w in words:
            v = known.get(w)
            if v is None:
                v = known[w] = float(self.weights[places(w)].sum())
            total += v
        return SCALE * total / (len(words) + SHRINK)

    def severity(self, score: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts, -50, 50)))).sum(1) if len(self.cuts) else np.zeros(len(score))


def fit_ordinal(xs: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge by Adam; thresholds are a first one and positive increments, so they stay ordered."""
    row = np.repeat(np.arange(len(xs), dtype=np.int32), [len(a) for a, _ in xs])
    at, value = np.concatenate([a for a, _ in xs]), np.concatenate([v for _, v in xs])
    often = np.bincount(at, minlength=DIM) >= MIN_DOCS  # about: words of one document that share a place count each
    row, value, at = row[often[at]], value[often[at]], at[often[at]]
    used = np.flatnonzero(np.bincount(at, minlength=DIM))
    new = np.zeros(DIM, np.int32)
    new[used] = np.arange(len(used))
    col = new[at]
    del at, new
    w, t = np.zeros(len(used)), np.concatenate([[1.0], np.zeros(GRADES - 1)])
    m, v = np.zeros(len(w) + GRADES), np.zeros(len(w) + GRADES)
    n = len(xs)
    above = grades[:, None] > np.arange(GRADES)  # grade > k
    for step in range(1, steps + 1):
        cuts = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
        score = np.bincount(row, w[col] * value, n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -50, 50)))
        # P(grade = g) = P(> g-1) - P(> g); gradient of its logarithm by each cumulative term
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        here = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = p * (1 - p)
        d = np.zeros((n, GRADES))
        top = grades > 0
        d[top, grades[top] - 1] += slope[top, grades[top] - 1] / here[top]
        low = grades < GRADES
        d[low, grades[low]] -= slope[low, grades[low]] / here[low]
        by_cut = -d.sum(0) / n
        g = np.concatenate([np.bincount(col, d.sum(1)[row] * value, len(w)) / n - ridge * w, [by_cut.sum()], [by_cut[k:].sum() * np.exp(t[k]) for k in range(1, GRADES)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w += move[: len(w)]
        t += move[len(w) :]
    weights = np.zeros(DIM)
    weights[used] = w
    return Model(weights, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))]))


def grade(xs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> np.ndarray:
    """Grades 1 to GRADES of the toxic texts by their share of telling features, 0 of the others."""
    counts = np.zeros((2, DIM), np.int32)
    for (at, _), y in zip(xs, toxic):
        counts[y, np.unique(at)] += 1
    n0, n1 = (toxic == 0).sum(), (toxic == 1).sum()
    telling = (counts[1] >= MIN_DOCS) & (np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1)) > TELLING)
    share = np.array([v[telling[a]].sum() / v.sum() if len(v) else 0.0 for a, v in xs])
    out = np.zeros(len(xs), int)
    own = share[toxic == 1]
    out[toxic == 1] = 1 + np.searchsorted(np.quantile(own, [k / GRADES for k in range(1, GRADES)]), own, side="left")
    return out


def usable(labels: DataFrame) -> DataFrame:
    """(_id, toxic, _h: hash of the id) of the rows whose labels are not null and agree."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    return known.select(F.col("doc_id").alias("_id"), F.col("lo").cast("int").alias("toxic"), F.md5(F.col("doc_id").cast("string")).alias("_h"))


def cutoff(counts: np.ndarray, bins: int = 200) -> float:
    """The severity above which a text is toxic, by counts of (label, bin of severity)."""
    # share of either kind in bins from b on
    rate = counts[:, ::-1].cumsum(1)[:, ::-1] / np.maximum(1, counts.sum(1, keepdims=True))
    gain = np.where(rate[0] <= MAX_FPR, rate[1] - rate[0], -1)
    return int(np.argmax(gain)) / bins if gain.max() > 0 else float("inf")


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    spark = docs.sparkSession
    with C.text_batches(spark), C.Scratch() as scratch:
        known = scratch.keep(usable(labels), "labels")
        open_to_fit = known.where("substring(_h, 32, 1) > '3'")  # a quarter is never fitted
        first = open_to_fit.where("toxic = 1").orderBy("_h").limit(rows // 3).unionByName(open_to_fit.where("toxic = 0").orderBy("_h").limit(rows - rows // 3))
        first = scratch.keep(first, "fit-labels")
        picked = docs.select("doc_id", "text").join(F.broadcast(first), F.col("doc_id") == F.col("_id")).dropDuplicates(["_id"]).orderBy("_h").select("text", "toxic").toArrow()  # rows at most
        toxic = picked["toxic"].to_numpy().astype(int)
        if len(set(toxic.tolist())) < 2:
            return Model(np.zeros(DIM), np.zeros(0))
        xs = [vector(x.as_py()) for x in picked["text"]]
        del picked
        model = fit_ordinal(xs, grade(xs, toxic))
        del xs
        # the cutoff: a histogram of severities of the other labelled rows, the only ones that are scored for it
        rest = known.join(F.broadcast(first.select("_id")), "_id", "left_anti")
        if rest.agg(F.countDistinct("toxic")).first()[0] < 2:
            rest = known
        rest = scratch.keep(rest.select("_id", "toxic"), "cutoff-labels")
        some = C.maybe_in(docs.select("doc_id", "text").where("doc_id is not null"), rest.select(F.col("_id").alias("doc_id")), rest.count())
        sent = spark.sparkContext.broadcast(model)
        scored = scratch.keep(some.mapInArrow(_scorer(sent), "doc_id long, severity double, grade int").select("doc_id", F.floor(F.col("severity") * 200).cast("int").alias("bin")), "scores")
        sent.destroy()
        counts = np.zeros((2, 200 * GRADES + 1))
        for r in scored.join(rest, F.col("doc_id") == F.col("_id")).groupBy("toxic", "bin").agg(F.count("*").alias("n")).collect():  # two rows a bin at most
            counts[r["toxic"], r["bin"]] += r["n"]
        model.limit = cutoff(counts)
        return model


def _scorer(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            e = model.severity(np.array([model.score(x.as_py()) for x in batch.column("text")], float))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(e, pa.float64()), pa.array(np.rint(e).astype(np.int32))], names=["doc_id", "severity", "grade"])

    return score


def severities(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, severity: the expected grade, grade: the nearest, is_toxic) of each row, as a written table."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    with C.text_batches(spark):
        scored = docs.select("doc_id", "text").mapInArrow(_scorer(sent), "doc_id long, severity double, grade int").withColumn("is_toxic", F.col("severity") >= model.limit)
        out = C.materialize(scored, "severities")
    sent.destroy()
    return out


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    return severities(docs, fit(docs, C.read(spark, sf_dir, "labels")))
