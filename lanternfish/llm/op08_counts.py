"""Edit-aware token counts: a stored segment tree of token counts over each document's pre-token blocks.

A text is cut at white space into blocks of BLOCK chunks; leaves hold a block's characters and tokens, inner nodes the sums of both. grow()
encodes each text once and gives a store: the text with its tree's leaves, to be written. apply_edits() takes the rows of a store with
edits, builds the trees from their leaves without encoding anything, and gives the new store. An edit (start, end, replacement) in
code points is found by descending the tree; only the leaves that it touches are encoded again, and the next leaf too if the edit
takes away the white space that set it apart (the boundary context; the tokenizer joins nothing across white space). Sums are updated on
the way to the root, so the count of an edited text costs the edit, not the text. A region that an edit makes longer than two blocks is
cut into blocks again.

Defined results: null and empty texts have one empty leaf and no tokens, and a null text that is edited counts as empty; edits are
clipped to the text; a null replacement is the empty one; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import common as C
from lanternfish.llm import tokens

BLOCK = 64


class TokenTree:
    """Leaves are texts that end in a space or newline, but for the last; chars and counts are trees in arrays, root at 1."""

    def __init__(self, text: str, known: tokens.ChunkIds, block: int = BLOCK, leaves: tuple[list[int], list[int]] | None = None):
        """leaves: characters and tokens of each leaf of text, as stored; without them the text is encoded."""
        self.known, self.block, self.encoded = known, block, 0
        if leaves is None:
            self.leaves, counts = self.cut(text)
        else:
            self.leaves, counts, at = [], list(leaves[1]), 0
            for n in leaves[0]:
                self.leaves.append(text[at : at + n])
                at += n
        self.plant(counts)

    def cut(self, text: str) -> tuple[list[str], list[int]]:
        """Blocks of a text and their numbers of tokens."""
        parts = text.replace("\n", " ").split(" ")
        sizes = [len(self.known[x]) // 4 for x in parts]
        out, counts, at = [], [], 0
        for k in range(0, len(parts), self.block):
            n = sum(map(len, parts[k : k + self.block])) + len(parts[k : k + self.block])
            out.append(text[at : at + n])  # with the space after each chunk
            counts.append(sum(sizes[k : k + self.block]))
            at += n
        return out, counts

    def plant(self, counts: list[int]) -> None:
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        pad = [0] * (self.size - len(self.leaves))
        self.chars, self.counts = [0] * self.size + [len(x) for x in self.leaves] + pad, [0] * self.size + counts + pad
        for tree in (self.chars, self.counts):
            for i in range(self.size - 1, 0, -1):
                tree[i] = tree[2 * i] + tree[2 * i + 1]

    @property
    def total(self) -> int:
        return self.counts[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at, and where in it; the end of the text is in the last leaf."""
        i = 1
        if at >= self.chars[1]:
            last = len(self.leaves) - 1
            return last, len(self.leaves[last])
        while i < self.size:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def put(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.size
        self.chars[i], self.counts[i] = len(text), count
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.counts[i] = self.counts[2 * i] + self.counts[2 * i + 1]

    def edit(self, start: int, end: int, new: str | None) -> None:
        start = min(max(0, start), self.chars[1])
        end = min(max(start, end), self.chars[1])
        first, a = self.find(start)
        last, b = self.find(end)
        text = self.leaves[first][:a] + (new or "") + self.leaves[last][b:]
        # the boundary context: up to a leaf that begins after white space
        while text[-1:] not in ("", " ", "\n") and last + 1 < len(self.leaves):
            last += 1
            text += self.leaves[last]
        # an emptied region lets the leaf before meet the one after, which is as well: it ends in white space
        chunks = 1 + text.count(" ") + text.count("\n")
        self.encoded += chunks
        if chunks > 2 * self.block:
            texts, counts = self.cut(text)
            if texts[-1] == "" and len(texts) > 1:
                texts.pop(), counts.pop()
            old = self.counts[self.size : self.size + len(self.leaves)]
            self.leaves[first : last + 1] = texts
            self.plant(old[:first] + counts + old[last + 1 :])
            return
        self.put(first, text, sum(map(len, self.known.chunks(text))) // 4)
        for k in range(first + 1, last + 1):
            self.put(k, "", 0)

    def text(self) -> str:
        return "".join(self.leaves)

    def stored(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold anything, of one at least."""
        leaves = [(len(x), n) for x, n in zip(self.leaves, self.counts[self.size :]) if x] or [(0, 0)]
        return [x for x, _ in leaves], [n for _, n in leaves]


_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
TREE = "struct<chars:array<int>,counts:array<int>>"


def grow(docs: DataFrame, extra: list[str] | None = None, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """A store of docs (doc_id, text): with the columns extra and tree, the leaves of each text. Write it with small batches (see common.text_batches)."""
    path = vocabulary or tokens.vocabulary()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(extra or []))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.chunk_ids(path)
        for batch in batches:
            trees = [TokenTree(t.as_py() or "", known, block).stored() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([{"chars": a, "counts": b} for a, b in trees], _TREE)], names=[*batch.schema.names, "tree"])
        known.forget()
        C.tidy()

    return d.mapInArrow(made, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + f", tree {TREE}")


_RESULT = "doc_id long, n_tokens long, n_tokens_after long, n_chunks_encoded long, n_leaves long, edited_crc32 long"


def apply_edits(store: DataFrame, edits: str = "edits", vocabulary: str | None = None, block: int = BLOCK, texts: bool = True) -> DataFrame:
    """The rows of a store with edits (array of struct<start, end, new>, applied in turn): counts before and after, how many chunks were encoded, and, unless texts is false, the new text and tree."""
    path = vocabulary or tokens.vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.chunk_ids(path)
        for batch in batches:
            out = []
            for d, t, tree, e in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("tree").to_pylist(), batch.column("edits").to_pylist()):
                old = t.as_py()
                one = TokenTree(old or "", known, block, (tree["chars"], tree["counts"]))
                before = one.total
                for x in e or []:
                    if x:
                        one.edit(x["start"] or 0, x["end"] or 0, x["new"])
                chars, counts = one.stored()
                text = one.text()
                out.append((d, before, one.total, one.encoded, len(chars), zlib.crc32(text.encode()), None if old is None and not text else text, {"chars": chars, "counts": counts}))
            cols = list(zip(*out)) or [[]] * 8
            types = (*(pa.int64(),) * 6, pa.string(), _TREE)
            names = [*(x.split()[0] for x in _RESULT.split(", ")), "text", "tree"]
            n = 8 if texts else 6
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols[:n], types)], names=names[:n])
        known.forget()
        C.tidy()

    return store.select("doc_id", "text", "tree", F.col(edits).alias("edits")).mapInArrow(count, _RESULT + (f", text string, tree {TREE}" if texts else ""))


def count_edits(docs: DataFrame, edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text, edits) -> counts before and after, and how many chunks were encoded again for the edits, by a store that is written, read again and dropped."""
    with C.text_batches(docs.sparkSession), C.Scratch() as scratch:
        store = scratch.keep(grow(docs.select("doc_id", "text", F.col(edits).alias("edits")), ["edits"], vocabulary), "token-trees")
        return C.materialize(apply_edits(store, vocabulary=vocabulary, texts=False), "edit-counts")


def sample_edits() -> Column:
    """Three edits that any text can take: an insertion at a third, a deletion of seven code points at the middle, a new end."""
    n = F.length(F.coalesce("text", F.lit("")))
    third, half = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    one = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("new"))
    return F.array(one(third, third, " an inserted phrase "), one(half, half + 7, ""), one(F.greatest(F.lit(0), n - 5), n + 20, "the end."))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(C.read(spark, sf_dir, "documents").select("doc_id", "text", sample_edits().alias("edits")))
