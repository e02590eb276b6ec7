"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

One pass over the documents, no shuffle.  A document's whole windows go as they are; the rest is cut into pieces of at most
`max_piece` tokens, and the pieces of about `group` windows together are differenced into near-equal windows: partial
partitions with opposing imbalances are merged until one is left, and while its fullest window exceeds the
capacity, the number of windows rises by one.  Memory is bounded by one batch of texts, one group of pieces and a word cache of
CACHE_BYTES; at the end of a task the worker gives back what it took.

Defined results: a null or empty text is the end token alone; repeated rows are packed each on their own; extra columns
are not read; an empty table gives no rows.  Sequence ids are unique, made of the partition's number and a count within it.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kk
from .common import tidy

#: Bytes, about, of words and their ids that a worker keeps; when full, the cache starts anew.  ENTRY_BYTES is what an entry takes beside its words' own bytes.
CACHE_BYTES, ENTRY_BYTES = 200_000_000, 200
#: Bytes of text to encode at once; bounds memory for long texts.
CHUNK_BYTES = 1_000_000

#: ASCII other than letters, digits and white space.
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\r\x0b\x0c")

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordIds:
    """Little-endian ids of a text by words.

    The vocabulary's normaliser and pre-tokeniser never look across the white space of `bytes.split`, so a text's ids
    are its words' ids in order, and only words that are new to the worker are encoded.  Two shortcuts give the same ids
    for less: the normaliser lower-cases and the pre-tokeniser parts letters from marks, so A-Z are lowered and marks that end
    a word are looked up by themselves; and a word of letters only is one pre-token, which goes straight to the
    model.  A text that may hold a special token is encoded as it is, for those are told by case.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors run a task per core
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.letters = Tokenizer.from_file(path), {}, _byte_letters()
        self.model, self.bytes, self.most = self.tokenizer.model, 0, cache_bytes

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        # Letters below 256 are lower-cased one by one, to letters below 256, and are NFC.
        low = text.lower() if max(text) < "\u0100" else text
        if low.isalpha() and low == low.lower() and unicodedata.is_normalized("NFC", low):
            text = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode()))
            return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        known = self.known
        for w in words:
            if w not in known:
                self.bytes += 2 * len(w) + ENTRY_BYTES
                stem = w.rstrip(_MARKS)
                if stem and len(stem) < len(w) and stem[-1] < 128 and b"<|" not in w:
                    for part in (stem, w[len(stem) :]):
                        if part not in known:
                            known[part] = self._word(part)
                    known[w] = known[stem] + known[w[len(stem) :]]
                else:
                    known[w] = self._word(w)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if self.bytes > self.most:
            self.known, self.bytes = {}, 0
        self._learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_encoders: dict[tuple[str, int], WordIds] = {}


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The window of each piece and their number, which rises from the least possible until none is over capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        slot, sums = kk.split(sizes, m)
        if sums.max() <= capacity:
            return slot, m
        m += max(1, int((np.maximum(sums - capacity, 0).sum()) // capacity))


class _Packer:
    """Gathers pieces as columns; packs a group of rest pieces whenever it is large enough."""

    def __init__(self, capacity: int, group: int):
        self.capacity, self.group = capacity, group
        self.next = TaskContext.get().partitionId() << 40
        self.rest: list[tuple] = []
        self.rest_tokens = 0
        self.done: list[tuple] = []

    def whole(self, piece: tuple) -> None:
        self.done.append((*piece, self.next, 0))
        self.next += 1

    def part(self, piece: tuple) -> None:
        self.rest.append(piece)
        self.rest_tokens += piece[2]
        if self.rest_tokens >= self.group * self.capacity:
            self.flush()

    def flush(self) -> None:
        if not self.rest:
            return
        sizes = np.array([p[2] for p in self.rest], np.int64)
        slot, m = windows(sizes, self.capacity)
        filled = np.zeros(m, np.int64)
        for piece, j, size in zip(self.rest, slot.tolist(), sizes.tolist(), strict=True):
            self.done.append((*piece, self.next + j, int(filled[j])))
            filled[j] += size
        self.next += m
        self.rest, self.rest_tokens = [], 0

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*self.done, strict=True)) if self.done else [[] for _ in range(7)]
        self.done = []
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 2048, max_piece: int = 512, group: int = 256, cache_bytes: int = CACHE_BYTES, keep: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer_path names the vocabulary file on every executor.  keep: whether a worker keeps tokenizer and words for
    later tasks, which is faster; without it they take no memory from the stages that follow.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get((tokenizer_path, cache_bytes)) or WordIds(tokenizer_path, cache_bytes)
        if keep:
            _encoders[tokenizer_path, cache_bytes] = encoder
        packer, id_type = _Packer(capacity, group), pa.int64()

        def add(ids: list, texts: list[bytes]) -> None:
            for id_, own in zip(ids, encoder.encode(texts), strict=True):
                own += end
                n = len(own) // 4
                full = n // capacity * capacity
                for s in range(0, full, capacity):
                    packer.whole((id_, s, capacity, zlib.crc32(own[4 * s : 4 * (s + capacity)]), n))
                for s in range(full, n, max_piece):
                    e = min(n, s + max_piece)
                    packer.part((id_, s, e - s, zlib.crc32(own[4 * s : 4 * e]), n))

        for batch in batches:
            id_type = batch.schema.field("id").type
            ids, texts, size = [], [], 0
            for i in range(batch.num_rows):
                text = (batch.column("text")[i].as_py() or "").encode()
                ids.append(batch.column("id")[i].as_py())
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES:
                    add(ids, texts)
                    ids, texts, size = [], [], 0
                    if len(packer.done) > 20_000:
                        yield packer.batch(id_type)
            add(ids, texts)
            if packer.done:
                yield packer.batch(id_type)
        packer.flush()
        yield packer.batch(id_type)

    out = rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, {PIECES}")
    return out.withColumnRenamed("id", id_col)
