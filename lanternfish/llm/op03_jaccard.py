"""Exact Jaccard join of documents on word shingles: a grouped prefix join.

A document is its set of 64-bit hashes of five-word shingles. Documents of one set are a class (its smallest doc_id). Shingles have one
global order: rare ones by hash, then the frequent ones by count; so two sets with 100 * |a & b| >= 80 * |a | b| share one of the
first n - ceil(0.8 n) + 1 shingles, their prefixes. Documents with one prefix and size form one group, named by its smallest doc_id, and
groups, not documents, are listed under the shingles of the prefix.

The lists are range-partitioned by (shingle, size, place, group), so a shingle of very many documents is spread over tasks, and streamed:
in each list, every group is paired with the first one of a compatible size, a number of pairs linear in the lists. Pairs are
expanded to classes, filtered by parity bitmaps of two to four bits a shingle, whose distance bounds what two sets have in common from above
(so no link is lost), and verified on whole sets, which are made only for the few documents that are left. Then only lists that still hold several components are left. A second round pairs
their members with the one whose prefix has the fewest rare shingles before the list's, which is the most central one; a last one
pairs what is left: members of different components of a list whose sizes and places allow a link, long lists by blocks. So every
component is whole, but members of one component are not paired with each other: n_joining_links of a class counts the links that were
verified to join components, not all that it has.

Components come from contracting the edges of each task to stars and, as long as there are several tasks, from alternating large and
small stars, with each round written to the shared folder. Which shingles are frequent is found in bounded windows over all documents and
concerns speed only, as any order gives the same links; they are taken from a count on that a histogram of 8 bins a doubling
allows, FREQUENT at most, and so have a size bound for the broadcast.

Defined results: null, empty and blank texts have no shingles and are their own components; texts of one to four words are one
shingle; a row without doc_id has no component; repeated rows come back each; rows that share doc_id with different texts are one node of
the links, which has the links of each of its texts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import common as C

WIDTH = 5
PERCENT = 80
FREQUENT = 1 << 17
WINDOW = 1 << 21
MIN_IN_WINDOW = 2
WINDOW_DOCS = 8192
NARROW_ROWS = 200_000
#: Edges that a task contracts in its memory, ids that are broadcast, rows of a list that are paired in one task.
EDGES = 1 << 21
SMALL_IDS = 100_000
BLOCK = 1024
#: Words and shingles are hashed as polynomials with odd multipliers modulo 2 ** 64, each followed by a mix of its bits.
_BYTE, _WORD = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)  # A-Z as a-z
CHUNK = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the byte multiplier and of its inverse, n at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BYTE, pow(_BYTE, -1, 1 << 64))):
            p = np.full(max(n, CHUNK + 4096), base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of the bytes data; a word also ends before each place of breaks."""
    n = len(data)
    up, down = _powers_to(n)
    sums = np.cumsum(_VALUE[data] * up[:n])
    word = ~_SPACE[data]
    apart = np.zeros(n + 1, bool)
    apart[breaks] = True
    apart[[0, n]] = True
    starts = np.flatnonzero(word & (apart[:n] | np.append(True, ~word[:-1])))
    ends = np.flatnonzero(word & (apart[1:] | np.append(~word[1:], True)))
    h = sums[ends] - np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return _mix(h * down[starts]), starts


def _shingles_of(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the shingles of word hashes; of all as one where they are fewer than width."""
    m = min(len(w), width)
    h = np.full(len(w) - m + 1, m, np.uint64)
    for k in range(m):
        h = h * _WORD + w[k : len(w) - m + 1 + k]
    return _mix(h).view(np.int64)


def _words_of(data: np.ndarray) -> np.ndarray:
    """Word hashes of a long text, by pieces that end at white space."""
    out, at = [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            space = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            while not len(space) and end < len(data):
                end += CHUNK
                space = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            end += int(space[0]) if len(space) else 0
        out.append(_word_hashes(data[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of the words [^\\x20\\x09-\\x0D]+ of text, A-Z lower-cased."""
    w = _words_of(np.frombuffer(text, np.uint8))
    return np.unique(_shingles_of(w, width)) if len(w) else np.empty(0, np.int64)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """shingles() of each text (null: none), many short texts at a time."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    none = np.empty(0, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        lo, hi = offsets[i], offsets[j]
        if j == i + 1:
            yield shingles(data[lo:hi].tobytes(), width) if valid[i] else none
        else:
            w, starts = _word_hashes(data[lo:hi], offsets[i:j] - lo) if hi > lo else (np.zeros(0, np.uint64), none)
            at = np.searchsorted(starts, offsets[i : j + 1] - lo)
            h = _shingles_of(w, width) if len(w) >= width else none
            for k in range(j - i):
                n = at[k + 1] - at[k]
                if not n or not valid[i + k]:
                    yield none
                elif n < width:
                    yield _shingles_of(w[at[k] : at[k + 1]], width)
                else:
                    yield np.unique(h[at[k] : at[k + 1] - width + 1])
        i = j


def _texts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    return zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), width))


def frequent(docs: DataFrame, scratch: C.Scratch, width: int = WIDTH, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, limit at most, sorted by hash, and their places in the order of count. Each window of a task's documents gives those it holds MIN_IN_WINDOW times; copies in a window count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            many = c >= MIN_IN_WINDOW
            return pa.RecordBatch.from_arrays([pa.array(v[many]), pa.array(c[many].astype(np.int64))], names=["h", "c"])

        held, seen, total = [], set(), 0
        for batch in batches:
            for _, s in _texts(batch, width):
                key = xxhash.xxh3_64_intdigest(s.tobytes())
                if len(s) and key not in seen:
                    seen.add(key)
                    held.append(s)
                    total += len(s)
                if total > WINDOW:
                    yield from C.slices(counted())
                    held, seen, total = [], set(), 0
        if held:
            yield from C.slices(counted())
            held.clear()
        C.tidy()

    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, docs.count() // WINDOW_DOCS)  # small partitions would see too little each
    found = docs.select("doc_id", "text").coalesce(tasks).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    found = scratch.keep(found.withColumn("bin", F.floor(8 * F.log2("c")).cast("int")), "shingle-counts")
    least, total = None, 0
    for r in sorted(found.groupBy("bin").agg(F.count("*").alias("n")).collect(), reverse=True):  # 8 bins a doubling
        total += r["n"]
        if total > limit:
            break
        least = r["bin"]
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    got = found.where(F.col("bin") >= least).select("h", "c").toArrow()  # limit rows at most
    scratch.drop(found)
    h, c = got["h"].to_numpy(), got["c"].to_numpy()
    at = np.argsort(h)
    h, c = h[at], c[at]
    place = np.empty(len(h), np.int64)
    place[np.lexsort((h, c))] = np.arange(len(h))
    return h, place


class _Order:
    """Rare shingles by hash, then the frequent ones by count; a bitmap tells most rare ones at once."""

    def __init__(self, hot: np.ndarray, place: np.ndarray):
        self.hot, self.place = hot, place
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[hot & ((1 << 22) - 1)] = True

    def __call__(self, s: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(self.maybe[s & ((1 << 22) - 1)])
        if not len(some):
            return s
        at = np.minimum(np.searchsorted(self.hot, s[some]), len(self.hot) - 1)
        is_hot = self.hot[at] == s[some]
        if not is_hot.any():
            return s
        some, at = some[is_hot], at[is_hot]
        return np.concatenate([np.delete(s, some), s[some][np.argsort(self.place[at], kind="stable")]])


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set in 64-bit words: bit i tells whether the number of its hashes that are i modulo the bitmap's size, a power of 2, is odd. A bitmap of half the size is the exclusive or of the halves."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    return np.packbits((np.bincount(s & (bits - 1), minlength=bits) & 1).astype(bool)).view(np.int64)


def _may_link(na: str, a: str, nb: str, b: str, percent: int) -> str:
    """SQL: whether sets of sizes na, nb and bitmaps a, b can be linked. Their bitmaps differ in at most as many bits as only one set holds shingles."""
    half = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (p, q) -> p ^ q)"
    fold = lambda x, y: f"if(size({x}) > size({y}), {half(x)}, {x})"
    apart = f"aggregate(zip_with({fold(a, b)}, {fold(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (s, k) -> s + k)"
    # 100 * o >= percent * (na + nb - o), with o <= (na + nb - apart) / 2; sizes beyond that can't be linked, and others' bitmaps are of one size or half of it
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) and {100 + percent} * ({na} + {nb} - {apart}) >= {2 * percent} * ({na} + {nb})"


def _sets(docs: DataFrame, order, width: int, percent: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = order.value
        for batch in batches:
            out = []
            for d, s in _texts(batch, width):
                n = len(s)
                full = xxhash.xxh3_128_digest(s.tobytes())
                prefix = ordered(s)[: n - (percent * n + 99) // 100 + 1] if n else s
                group = xxhash.xxh3_64_intdigest(prefix.tobytes(), n)
                out.append((d, n, int.from_bytes(full[:8], "little", signed=True), int.from_bytes(full[8:], "little", signed=True), group - (1 << 63), prefix, parity(s)))
            cols = list(zip(*out)) or [[]] * 7
            lists = [pa.array(list(c), pa.list_(pa.int64())) for c in cols[5:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), *lists], names=["doc_id", "n", "s1", "s2", "g", "prefix", "bits"])
        C.tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n long, s1 long, s2 long, g long, prefix array<long>, bits array<long>")


PAIR, LISTED = 0, 1


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the sorted h: where its run starts, and the run's length."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, h[1:] != h[:-1])
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return start[run], np.diff(np.append(start, len(h)))[run]


def _stream_lists(percent: int):
    """Rows (h, at: size << 32 | place, g, d) sorted -> (kind, a, b, h): each group, by its smallest d, with the first one of a compatible size in its list, once a batch of lists, and the rows (group, at, h) of lists that hold several groups, or may as they reach a task's end."""

    def flush(h: np.ndarray, at: np.ndarray, g: np.ndarray, d: np.ndarray, ends: bool) -> Iterator[pa.RecordBatch]:
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (at[1:] != at[:-1])
        h, at, g, d = h[keep], at[keep], g[keep], d[keep]
        n, pos = at >> 32, at & 0xFFFFFFFF
        first, last, closed = h[0], h[-1], np.ones(len(h), bool)
        if ends:
            closed = (h != first) & (h != last)
        # a list's first row has its smallest size: rows whose shingle comes too late for any other size there can go
        start, _ = _runs(h)
        low = np.maximum(n[start], (percent * n + 99) // 100)
        keep = ~closed | ((100 + percent) * (n - pos) >= percent * (n + low))
        h, at, g, d, n, pos, closed = h[keep], at[keep], g[keep], d[keep], n[keep], pos[keep], closed[keep]
        start, size = _runs(h)
        keep = ~closed | (size > 1)
        h, at, g, d, n, pos = h[keep], at[keep], g[keep], d[keep], n[keep], pos[keep]
        pivot, _ = _runs(h)
        while len(h):  # a new first one where the sizes have grown too far; a few rounds, as sizes grow by a quarter each
            far = percent * n > 100 * n[pivot]
            if not far.any():
                break
            lead = far.copy()
            lead[1:] &= ~(far[:-1] & (pivot[1:] == pivot[:-1]))
            here = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
            pivot = np.where(far, here, pivot)
        near = (g != g[pivot]) & ((100 + percent) * np.minimum(n - pos, n[pivot] - pos[pivot]) >= percent * (n + n[pivot]))
        p = np.unique(np.stack([d[pivot][near], d[near]], 1), axis=0)
        # a list of two is told by its pair alone
        start, size = _runs(h)
        alone = (size == 2) & ((h != first) & (h != last) if ends else True)
        told = alone & ~(near[start] | near[np.minimum(start + 1, len(h) - 1)]) if len(h) else alone
        h, at, d = h[~told], at[~told], d[~told]
        kinds = np.concatenate([np.full(len(p), PAIR, np.int32), np.full(len(h), LISTED, np.int32)])
        yield from C.slices(pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([p[:, 0], d])), pa.array(np.concatenate([p[:, 1], at])), pa.array(np.concatenate([np.zeros(len(p), np.int64), h]))], names=["kind", "a", "b", "h"]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, first = [], 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(c).to_numpy() for c in ("h", "at", "g", "d")])
            rows += batch.num_rows
            if rows >= 1 << 18:
                h, at, g, d = map(np.concatenate, zip(*held))
                cut = int(np.searchsorted(h, h[-1]))  # the last list may go on
                if cut == 0 and rows < 1 << 20:
                    continue
                cut = cut or len(h)
                yield from flush(h[:cut], at[:cut], g[:cut], d[:cut], first or cut == len(h))
                held, rows, first = ([[h[cut:], at[cut:], g[cut:], d[cut:]]] if cut < len(h) else []), len(h) - cut, cut == len(h)
        if held:
            yield from flush(*map(np.concatenate, zip(*held)), True)

    return stream


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> (node, comp): the smallest node that each node reaches by a task's edges."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    a, b = map(np.concatenate, zip(*held))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    yield from C.slices(pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[low])], names=["node", "comp"]))


def _join(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by shuffle: neither side passes through the driver, and AQE splits hot keys."""
    return a.join(b.hint("merge"), on, how)


def components(edges: DataFrame, parts: int | None = None, per_task: int = EDGES) -> DataFrame:
    """(node, comp) of every node of edges (a, b), as a written table: comp is the smallest node that it reaches. Tables of edges are written in parts files, if given."""

    def write(df: DataFrame, name: str) -> DataFrame:
        return C.materialize(df.coalesce(parts) if parts else df, name)

    e = edges.where("a <> b").select("a", "b")
    tasks = -(-e.count() // per_task)
    stars = C.materialize(e.coalesce(max(1, tasks)).mapInArrow(_contract, "node long, comp long"), "components")
    if tasks <= 1:
        return stars
    e = stars.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    old = [stars]
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _join(both, low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # in large, b < a; small star: the lower neighbours and the node itself go to the lowest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = write(_join(large, low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct(), "edges")
        C.discard(*old)
        old = [e]
        # done when each node has one edge, to a node that has none
        per = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1))).groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if not per.where("up > 1 or (up > 0 and down > 0)").limit(1).count():
            break
    out = write(e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "components")
    C.discard(*old)
    return out


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are near enough. b's set joins first: pairs of a hub a then come with their sets and are heavy enough for AQE to split."""
    d = _join(_join(pairs, sets.toDF("b", "y"), "b"), sets.toDF("a", "x"), "a")
    both = F.size(F.array_intersect("x", "y"))
    return d.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_joining_links) of each row: n_joining_links counts the class's verified links to others, those that joined components."""
    with C.text_batches(docs.sparkSession), C.Scratch() as scratch:
        return _components_of(docs, width, percent, block, scratch)


def _components_of(docs: DataFrame, width: int, percent: int, block: int, scratch: C.Scratch) -> DataFrame:
    spark = docs.sparkSession
    n_parts = C.shuffle_partitions(spark)
    keep = scratch.keep
    order = spark.sparkContext.broadcast(_Order(*frequent(docs, scratch, width)))
    made = keep(_sets(docs, order, width, percent), "sets")
    order.destroy()
    parts = min(n_parts, -(-made.count() // NARROW_ROWS) or 1)

    def narrow(df: DataFrame, name: str) -> DataFrame:
        """keep() for tables of a few numbers a document or fewer: as many files as documents ask for."""
        return keep(df.coalesce(parts), name)

    def few(df: DataFrame, name: str) -> DataFrame:
        """keep() for the few rows that a large join leaves: the join runs in all tasks, then its rows are dealt to few files."""
        return keep(df.repartition(parts), name)

    full = made.where("n > 0 and doc_id is not null")
    sets_of = keep(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("c"), F.first("g").alias("g"), F.first("n").alias("n"), F.first("bits").alias("bits")), "set-classes")
    classes = narrow(_join(sets_of.select("c", "g", "n", "s1", "s2"), sets_of.groupBy("g").agg(F.min("c").alias("r")), "g").select("c", "r", "n", "s1", "s2"), "classes")
    lists = full.select("g", F.col("doc_id").alias("d"), "n", F.posexplode("prefix").alias("pos", "h")).select("h", (F.shiftleft("n", 32) + F.col("pos")).alias("at"), "g", "d")
    lists = lists.repartitionByRange(n_parts, "h", "at", "g").sortWithinPartitions("h", "at", "g", "d")
    found = keep(lists.mapInArrow(_stream_lists(percent), "kind int, a long, b long, h long"), "lists")
    # lists that were open at the ends of tasks are here too
    listed = found.where(F.col("kind") == LISTED).select("h", F.col("a").alias("r"), F.shiftright("b", 32).alias("n"), F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)).alias("pos"))
    sets: list[DataFrame] = []
    # rows that repeat a doc_id would multiply the joins of sets; most tables have none
    repeated = not full.groupBy("doc_id").count().where("count > 1").isEmpty()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(_texts(batch, width))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "x"])

    def linked(pairs: DataFrame) -> DataFrame | None:
        """The links among pairs (a, b), None if there are no pairs; sets that were not made yet are made first."""
        pairs = _join(pairs.where("a <> b").distinct(), sets_of.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")
        pairs = _join(pairs, sets_of.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
        pairs = few(pairs.where(_may_link("na", "x", "nb", "y", percent)).select("a", "b").distinct(), "pairs")
        if pairs.isEmpty():
            return None
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        n = ids.count()

        def only(d: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
            """Rows of wanted ids; these are n, so what is broadcast has a bound."""
            return d.join(F.broadcast(wanted), "doc_id", "left_semi") if n <= SMALL_IDS else _join(d, wanted, "doc_id", "left_semi")

        wanted = ids
        for known in sets:
            wanted = _join(wanted, known.select("doc_id"), "doc_id", "left_anti")
        more = wanted.count()
        if more:
            texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
            made_now = only(texts if more <= SMALL_IDS else C.maybe_in(texts, wanted, more), wanted, more).mapInArrow(whole, "doc_id long, x array<long>")
            sets.append(keep(made_now.dropDuplicates(["doc_id", "x"]) if repeated else made_now, "whole-sets"))
        every = only(sets[0], ids, n)
        for known in sets[1:]:
            every = every.union(only(known, ids, n))
        return few(_links(pairs, every, percent), "links")

    def open_rows(rows: DataFrame) -> DataFrame:
        """Rows of lists (h, comp, ...) that hold several components."""
        mixed = rows.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("low"), F.count("*").alias("k")).where("lo <> hi").select("h", "low", "k")
        # the first shingle that two linked sets share leaves enough after it in both; rows that cannot have a partner in their list go
        return _join(rows, mixed, "h").where(f"{100 + percent} * (n - pos) >= {percent} * (n + greatest(low, n * {percent} div 100))").drop("low")

    near = f"{100 + percent} * least(n - pos, n2 - pos2) >= {percent} * (n + n2)"

    def to_hub(rows: DataFrame) -> DataFrame:
        """Each row with the one of its list whose shingle comes first in the prefix."""
        hub = rows.groupBy("h").agg(F.min(F.struct("pos", "n", "c", "comp")).alias("p")).select("h", F.col("p.c").alias("a"), F.col("p.comp").alias("comp2"), F.col("p.n").alias("n2"), F.col("p.pos").alias("pos2"))
        return _join(rows, hub, "h").where(f"comp <> comp2 and {near}").select("a", F.col("c").alias("b"))

    def by_blocks(rows: DataFrame) -> DataFrame:
        """Pairs of different components of a list: a list of k rows is cut into ceil(k / block) blocks, and each pair of blocks meets in a task of its own."""
        rows = rows.withColumn("m", F.ceil(F.col("k") / block).cast("int")).withColumn("at", F.pmod(F.xxhash64("c"), F.col("m")).cast("int"))
        left = rows.select("h", "comp", "n", "pos", "r", F.col("at").alias("i"), F.explode(F.sequence("at", F.col("m") - 1)).alias("j"))
        right = rows.select("h", F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("r").alias("r2"), F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"))
        units = _join(left, right, ["h", "i", "j"]).where(f"(comp < comp2 or (comp > comp2 and i < j)) and {near}").select("r", "comp", "r2", "comp2").distinct()
        # any member of a unit, not only its first one, may be the one that is linked
        members = members_of(comps)
        d = _join(_join(units, members, ["r", "comp"]), members.toDF("r2", "comp2", "c2"), ["r2", "comp2"])
        return d.select(F.least("c", "c2").alias("a"), F.greatest("c", "c2").alias("b"))

    def members_of(comps: DataFrame) -> DataFrame:
        """(r, comp, c) of each class: those of one group and component are a unit."""
        return _join(classes, comps.withColumnRenamed("node", "c"), "c", "left").select("r", F.coalesce("comp", "c").alias("comp"), "c")

    links = linked(classes.select(F.col("r").alias("a"), F.col("c").alias("b")).union(found.where(F.col("kind") == PAIR).select("a", "b")))
    comps = None
    every = links
    if links is not None:
        comps = scratch.own(components(links, parts))
        # a group's classes need not be linked with each other, so each of its components is a unit, and the group is one more list
        units = members_of(comps).groupBy("r", "comp").agg(F.min("c").alias("c"))
        sizes = classes.groupBy("r").agg(F.min("n").alias("n"), F.count("*").alias("k")).where("k > 1").select("r", "n")
        groups = _join(units, sizes, "r").select(F.xxhash64(F.lit("group"), "r").alias("h"), "r", "n", F.lit(0).cast("long").alias("pos"), "comp", "c")
        rows = keep(open_rows(_join(listed, units, "r").select("h", "r", "n", "pos", "comp", "c").unionByName(groups)), "open-rows")
        for pairs in (to_hub, by_blocks):
            if rows.isEmpty():
                break
            more = linked(pairs(rows))
            if more is None or more.isEmpty():
                continue
            every = every.union(more)
            comps = scratch.own(components(comps.toDF("a", "b").union(more), parts))
            if pairs is to_hub:
                now = _join(rows.drop("k"), comps.toDF("c", "comp2"), "c", "left").withColumn("comp", F.coalesce("comp2", "comp")).drop("comp2")
                rows = keep(open_rows(now), "open-rows")
    known = classes.select("s1", "s2", F.col("c").alias("class_id"))
    if every is None:
        known = known.withColumns({"component_id": F.col("class_id"), "n_joining_links": F.lit(0).cast("long")})
    else:
        one = every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        degree = one.select(F.col("a").alias("class_id")).union(one.select("b")).groupBy("class_id").agg(F.count("*").alias("n_joining_links"))
        per_node = _join(comps.toDF("class_id", "comp"), degree, "class_id", "left")
        known = _join(known, per_node, "class_id", "left").select("s1", "s2", "class_id", F.coalesce("comp", "class_id").alias("component_id"), F.coalesce("n_joining_links", F.lit(0)).cast("long").alias("n_joining_links"))
    out = _join(made.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2"), known, ["s1", "s2"], "left")
    own = F.col("doc_id")
    return C.materialize(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", own).alias("class_id"), F.coalesce("component_id", own).alias("component_id"), F.coalesce("n_joining_links", F.lit(0)).cast("long").alias("n_joining_links")), "jaccard")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its component; of rows that share doc_id all stay."""
    name = C.fresh(docs, "_gone")
    # written, so that its size is known: broadcast while small, and then no text is shuffled
    found = jaccard_components(docs)
    gone = C.materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    C.discard(found)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Quadratic; for the small tables of a comparison. One row a document with its links' smallest reachable doc_id.
ORACLE = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WIDTH} - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {WIDTH} + 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, x.c FROM r JOIN (SELECT a AS f, b AS c FROM e UNION ALL SELECT b, a FROM e) x ON r.c = x.f)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""
