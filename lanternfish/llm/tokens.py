"""Token ids by a word-level BPE tokenizer, with a bounded cache of the ids of space-free chunks.

The tokenizer drops white space and never joins characters across it, so the ids of a text are the ids of its chunks one after
another. Chunks are cut at spaces and newlines only. A chunk of Latin-1 letters within runs of ASCII marks, as most are, has at most
three pre-tokens, which go to the tokenizer's model as they are (lower case, by bytes); every other chunk goes through the whole
tokenizer.
"""

from __future__ import annotations

import os
import re
import struct

#: Chunks and pieces that are kept. Pieces cost more to make, chunks are quickly put together from them.
CACHE, PIECES = 400_000, 300_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


MARKS = "!-/:-@\\[-`{-~"
# no apostrophe before letters: 's and the like are pre-tokens of their own
PLAIN = re.compile(f"((?:(?!')[{MARKS}])*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([{MARKS}]*)")
#: A byte-level alphabet shows printable bytes as themselves and the others, in order, as the characters from 256 on.
_OTHER = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
BYTE = {b: chr(256 + _OTHER.index(b)) if b in _OTHER else chr(b) for b in range(256)}
LATIN = {c: "".join(BYTE[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class ChunkIds(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes; emptied when it holds CACHE chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {"": b""}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
            self[""] = b""
        m = None if "<|" in chunk else PLAIN.fullmatch(chunk)  # the names of special tokens have an id
        if m:
            out = self.piece(m[1]) + self.piece(m[2].lower()) + self.piece(m[3])
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[chunk] = out
        return out

    def piece(self, piece: str) -> bytes:
        out = self.pieces.get(piece)
        if out is None:
            if len(self.pieces) > PIECES:
                self.pieces = {"": b""}
            ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(LATIN))]
            out = self.pieces[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def forget(self) -> None:
        """Empties the cache of chunks: workers outlive their tasks, and what they hold takes from the memory of later stages."""
        self.clear()
        self[""] = b""

    def chunks(self, text: str) -> list[bytes]:
        """The ids of each chunk of text."""
        return list(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_made: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One cache a Python worker, whatever the number of tasks it runs."""
    if path not in _made:
        _made[path] = ChunkIds(path)
    return _made[path]
