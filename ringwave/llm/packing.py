"""Packing of token sequences as vector bin packing with the dot-product heuristic.

Every example demands tokens, one segment and its loss-bearing tokens; a sequence has a limit on each.
An open sequence takes, of the pieces that fit all limits, the one whose demand has the largest dot
product with the sequence's remaining room, both as shares of the limits. When none fits and tokens and
segments are left, the longest piece is cut to fill the rest. Packing goes on inside each task over a
bounded pool, so nothing is shuffled; what is left at the end of a task becomes sequences whose lengths
are powers of two, which need no padding.

Token ids come from the tokenizer file given by ``tokenizer``. White space never joins tokens, so ids are
looked up per white-space token in a bounded cache that the worker keeps; plain words go to the model
alone and everything else through the whole tokenizer.

Defined results: a null or empty text is the end id alone; a text longer than a sequence is cut; repeated
rows are packed each; a null id stays null; further columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.llm.text import bounded, texts

END = 1
CACHE = 200_000
#: Letters that the normaliser only lower-cases, then ASCII punctuation without the apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")
#: Separators that Python splits at and the tokenizer does not take for white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, loss_tokens long")


def _printable() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the rest for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """Token ids of texts as little-endian 32-bit bytes, by white-space token through a cache.

    The cache has two generations: when the young one is full it becomes the old one, and what is still
    used moves over, so frequent words stay.
    """

    def __init__(self, path: str, limit: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.limit = Tokenizer.from_file(path), limit
        self.model, self.letters = self.whole.model, _printable()
        self.old: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        found = self.old.get(token)
        if found is None:
            m = PLAIN.fullmatch(token)
            if m is None:
                found = self._through(token)
            elif (word := m[1].lower()) == token:
                found = self._word(token)
            else:
                found = self[word] + self[m[2]] if m[2] else self[word]
        self[token] = found
        return found

    def _through(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, batch: list[str]) -> list[bytes]:
        out = []
        for text in batch:
            out.append(self._through(text) if ODD_SPACE.search(text) else b"".join(map(self.__getitem__, text.split())))
            if len(self) > self.limit:
                self.old = self.copy()
                self.clear()
        return out


_ids: dict[str, Ids] = {}


def tokenizer_ids(path: str) -> Ids:
    """One per worker process, so that the cache lives from task to task."""
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


@dataclass
class Limits:
    """Room of one sequence."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048


class Packer:
    """Open pieces (document, start, length, first loss-bearing token) and the sequences made of them."""

    def __init__(self, limits: Limits, pool: int = 384):
        self.limits, self.pool = limits, pool
        self.open: list[tuple[int, int, int, int]] = []

    def add(self, piece: tuple[int, int, int, int]) -> Iterator[list[tuple[int, int, int, int]]]:
        """Whole sequences are cut off long examples, the rest waits in the pool."""
        doc, start, length, loss = piece
        step = min(self.limits.tokens, self.limits.loss_tokens)
        while length > self.limits.tokens or self._loss(start, length, loss) > self.limits.loss_tokens:
            yield [(doc, start, step, loss)]
            start, length = start + step, length - step
        self.open.append((doc, start, length, loss))
        if len(self.open) >= 2 * self.pool:
            yield from self.fill(self.pool)

    @staticmethod
    def _loss(start: int, length: int, loss: int) -> int:
        return max(0, start + length - max(start, loss))

    def fill(self, keep: int) -> Iterator[list[tuple[int, int, int, int]]]:
        """Sequences from the pool until it holds ``keep`` pieces or too few tokens for one more."""
        pieces = self.open
        tokens = np.array([p[2] for p in pieces], float)
        loss = np.array([self._loss(*p[1:]) for p in pieces], float)
        most = self.limits
        live = np.ones(len(pieces), bool)
        waiting, left = len(pieces), tokens.sum()
        while waiting > keep and left >= most.tokens:
            room, slots, loss_room, chosen = float(most.tokens), most.segments, float(most.loss_tokens), []
            while room > 0 and slots > 0:
                slots -= 1
                fits = live & (tokens <= room) & (loss <= loss_room)
                # the segment's share is the same for every piece, so it does not change the order
                gain = tokens * (room / most.tokens**2) + loss * (loss_room / most.loss_tokens**2)
                at = int(np.argmax(np.where(fits, gain, -1.0)))
                if fits[at]:
                    chosen.append(pieces[at])
                    room, loss_room, left = room - tokens[at], loss_room - loss[at], left - tokens[at]
                    live[at] = False
                    waiting -= 1
                    continue
                at = int(np.argmax(np.where(live, tokens, 0)))
                doc, start, length, first = pieces[at]
                cut = int(min(room, max(0, first - start) + loss_room, length - 1))
                if not live[at] or cut < 1:
                    break
                chosen.append((doc, start, cut, first))
                room, left, loss_room = room - cut, left - cut, loss_room - self._loss(start, cut, first)
                pieces[at] = (doc, start + cut, length - cut, first)
                tokens[at], loss[at] = length - cut, self._loss(start + cut, length - cut, first)
            yield chosen
        self.open = [p for p, ok in zip(pieces, live) if ok]

    def end(self) -> Iterator[list[tuple[int, int, int, int]]]:
        """The last pieces, cut to sequences whose lengths are powers of two."""
        yield from self.fill(0)
        rest, self.open = self.open, []
        left = sum(p[2] for p in rest)
        while left:
            size, chosen = 1 << (min(left, self.limits.tokens).bit_length() - 1), []
            room, loss_room = size, self.limits.loss_tokens
            while room and len(chosen) < self.limits.segments and loss_room > 0:
                doc, start, length, loss = rest.pop()
                cut = min(length, room)
                if self._loss(start, cut, loss) > loss_room:
                    cut = max(loss - start, 0) + loss_room
                chosen.append((doc, start, cut, loss))
                room, loss_room = room - cut, loss_room - self._loss(start, cut, loss)
                if cut < length:
                    rest.append((doc, start + cut, length - cut, loss))
            left -= size - room
            yield chosen


def _pack(path: str, limits: Limits, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = tokenizer_ids(path), Packer(limits)
        base, made = TaskContext.get().partitionId() << 40, 0
        held: dict[int, tuple] = {}  # ids of documents with open pieces
        rows: list[tuple] = []
        key = 0

        def put(sequence) -> None:
            nonlocal made
            offset = 0
            for doc, start, length, loss in sequence:
                doc_id, ids = held[doc][:2]
                part = ids[4 * start : 4 * (start + length)]
                row = (doc_id, start, length, zlib.crc32(part), len(ids) // 4, base + made, offset, Packer._loss(start, length, loss))
                rows.append(row + ((np.frombuffer(part, "<u4").astype(np.int32),) if keep_ids else ()))
                held[doc][2] -= length
                if not held[doc][2]:
                    del held[doc]
                offset += length
            made += 1

        def flush():
            cols = list(zip(*rows)) if rows else [()] * (8 + keep_ids)
            rows.clear()
            arrays = [pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[8:]]
            return pa.RecordBatch.from_arrays(arrays, [f.strip().split(" ")[0] for f in SCHEMA.split(",")] + ["ids"] * keep_ids)

        for batch in bounded(batches, "body"):
            for doc_id, loss_from, ids in zip(batch.column("id").to_pylist(), batch.column("loss_from").to_pylist(), ids_of(texts(batch, "body"))):
                ids += END.to_bytes(4, "little")
                held[key] = [doc_id, ids, len(ids) // 4]
                for sequence in packer.add((key, 0, len(ids) // 4, max(0, min(loss_from or 0, len(ids) // 4)))):
                    put(sequence)
                key += 1
            if len(rows) > 4096:
                yield flush()
        for sequence in packer.end():
            put(sequence)
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
         loss_from_col: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece; ``loss_from_col`` names the first loss-bearing token of each text (default: all)."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("body"),
        (F.col(loss_from_col).cast("long") if loss_from_col else F.lit(0).cast("long")).alias("loss_from"),
    )
    return rows.mapInArrow(_pack(tokenizer, limits, keep_ids), SCHEMA + ", ids array<int>" * keep_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_packing")
def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
