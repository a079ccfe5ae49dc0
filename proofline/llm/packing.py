"""Packing documents into fixed-size token sequences by the sum-of-squares rule, online.

Each task reads its documents once, in their order.  A document's tokens fill
whole sequences first; what is left of it goes into a partially filled window
at the level (number of tokens) for which the sum of the squared counts of
windows by level is least afterwards, or into a new window.  The counts stand in
an array with one entry for each level, so a placement costs one pass over
that array whatever the number of documents.  Where a task's documents end, the
windows that are still open are filled up from one another, and what remains is
cut into powers of two, which need no padding.

Nothing is shuffled: a task's partition is packed on its own, at most
``capacity`` tokens a partition end in windows shorter than the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .token_counts import CHUNK

#: Characters that every version of the character tables classes alike: ASCII without most controls, Latin, Greek, Cyrillic, kana and Chinese letters, dashes and quotes.
_SETTLED = re.compile("[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u03b1-\u03c9\u0410-\u044f\u2010-\u2027\u3041-\u3094\u4e00-\u9fa5]*")
#: Token ids in one batch of pieces.
_BATCH_IDS = 500_000


def _ranks(vocabulary: dict) -> dict[bytes, int] | None:
    """Ids by token bytes, if a token's id also is its place among the merges (then merging by rank is the same); else None."""
    ids = vocabulary["model"]["vocab"]
    merged = [ids["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in vocabulary["model"]["merges"]]
    if any(a >= b for a, b in pairwise(merged)):
        return None
    # The published spelling of bytes as characters: those that print stand for themselves, the others follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {token["content"] for token in vocabulary["added_tokens"]}
    return {bytes(byte_of[c] for c in token): k for token, k in ids.items() if token not in special}


class Ids:
    """Token ids of texts by a byte-level vocabulary of the tokenizers library.

    Texts of settled characters are merged by rank, several times as fast and
    with the same ids; all others go to the tokenizer itself.  Special tokens'
    strings are ordinary text.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            ranks = _ranks(json.load(file))
        self._by_rank = ranks and tiktoken.Encoding("by_rank", pat_str=CHUNK, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        """The ids of ``text``."""
        if self._by_rank and _SETTLED.fullmatch(text):
            return np.array(self._by_rank.encode_ordinary(text), np.uint32)
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def _worker_ids(path: str) -> Ids:
    """One for each worker process, which serves many tasks."""
    return Ids(path)


class Piece(NamedTuple):
    """Some consecutive ids of a document; ``row`` is the document's (doc_id, number of tokens)."""

    row: tuple[int | None, int]
    start: int
    ids: np.ndarray


class Packer:
    """Windows of ``capacity`` tokens: the open ones by level, the closed ones handed out as lists of pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        #: Number of open windows by level; a new window comes from level 0, a full one is at no level.
        self.counts = np.zeros(capacity + 1, np.int64)
        self._open: list[list[list[Piece]]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        """The level, 0 for a new window, from which ``size`` more tokens leave the least sum of squared counts; of equal ones the highest."""
        top = self.capacity - size
        here, there = self.counts[: top + 1], self.counts[size:]
        # One window less at the old level and one more at the new one; level 0 and full windows are not counted.
        change = 2 * (there - here) + 2
        change[0] -= 1 - 2 * here[0]
        change[top] -= 1 + 2 * there[top]
        change[(here == 0) & (np.arange(top + 1) > 0)] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, row: tuple[int | None, int], ids: np.ndarray) -> Iterator[list[Piece]]:
        """Place a document; the windows that this fills."""
        whole = len(ids) - len(ids) % self.capacity
        for k in range(0, whole, self.capacity):
            yield [Piece(row, k, ids[k : k + self.capacity])]
        size = len(ids) - whole
        if size:
            level = self.level_for(size)
            window = self._open[level].pop() if level else []
            self.counts[level] -= level > 0
            window.append(Piece(row, whole, ids[whole:].copy()))
            if level + size == self.capacity:
                yield window
            else:
                self._open[level + size].append(window)
                self.counts[level + size] += 1

    def rest(self) -> Iterator[list[Piece]]:
        """Close all windows: the fullest ones take what the emptiest ones hold; the last tokens form windows of powers of two."""
        windows = [window for level in self._open for window in level]
        self._open, self.counts = [[] for _ in range(self.capacity)], np.zeros(self.capacity + 1, np.int64)
        while windows:
            window = windows.pop()
            room = self.capacity - sum(len(piece.ids) for piece in window)
            while room and windows:
                row, start, ids = windows[0].pop()
                window.append(Piece(row, start, ids[:room]))
                if len(ids) > room:
                    windows[0].append(Piece(row, start + room, ids[room:]))
                if not windows[0]:
                    del windows[0]
                room -= len(window[-1].ids)
            if not room:
                yield window
                continue
            total = self.capacity - room
            for size in (1 << bit for bit in reversed(range(total.bit_length())) if total >> bit & 1):
                part: list[Piece] = []
                while size:
                    row, start, ids = window.pop(0)
                    part.append(Piece(row, start, ids[:size]))
                    if len(ids) > size:
                        window.insert(0, Piece(row, start + size, ids[size:]))
                    size -= len(part[-1].ids)
                yield part


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _batch(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
    pieces = [(sequence, piece) for sequence, window in windows for piece in window]
    lengths = [len(piece.ids) for _, piece in pieces]
    offsets = [at for _, window in windows for at, _ in pairwise([*np.cumsum([0, *(len(piece.ids) for piece in window)]).tolist()])]
    longs = [[piece.row[0] for _, piece in pieces], [piece.start for _, piece in pieces], lengths, None, [piece.row[1] for _, piece in pieces], [sequence for sequence, _ in pieces], offsets]
    names = [field.split()[0] for field in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([piece.ids.astype("<u4").tobytes() for _, piece in pieces], pa.binary()) if values is None else pa.array(values, pa.int64()) for values in longs], names=names)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``docs`` has (doc_id, text) and any further columns, which are not read.
    A document's tokens are its text's ids and then ``end_id``; ``ids`` holds
    those of the piece as little-endian unsigned 32-bit numbers, from ``start`` on.  A
    sequence's pieces follow each other from ``offset`` 0; all sequences hold
    ``capacity`` tokens but the last ones of each partition, which hold a power of
    two.  ``vocabulary`` is the path of a byte-level vocabulary on every worker.

    The result depends on how ``docs`` is split into partitions and on the order
    within them: both stay as they are when a lost task reads a table again.
    Where they may not (after a shuffle), write ``docs`` first.

    Defined cases: a null or empty text is ``end_id`` alone; documents with a null
    or repeated id are packed one by one; a very long text is held whole, with
    its ids; equal counts go to the fullest level; an empty table gives no rows.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _worker_ids(vocabulary), Packer(capacity)
        end = np.array([end_id], np.uint32)
        ready: list[tuple[int, list[Piece]]] = []
        held, sequence = 0, None

        def windows() -> Iterator[list[Piece]]:
            nonlocal sequence
            for batch in batches:
                for doc_id, task, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                    sequence = task.as_py() << 33 if sequence is None else sequence
                    ids = np.concatenate([encoder.of(text.as_py() or ""), end])
                    yield from packer.add((doc_id.as_py(), len(ids)), ids)
            yield from packer.rest()

        for window in windows():
            ready.append((sequence, window))
            sequence, held = sequence + 1, held + capacity
            if held >= _BATCH_IDS:
                yield _batch(ready)
                ready, held = [], 0
        if ready:
            yield _batch(ready)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().cast("long").alias("task"), "text")
    return narrow.mapInArrow(packed, _PIECES)
