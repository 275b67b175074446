"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

Class k holds the lengths in (capacity / (k + 1), capacity / k]; a bin of class
k is filled with exactly k pieces, whatever their lengths in the class.  A
document longer than the capacity is cut into whole sequences and a rest.  A
rest that would leave more than ``SLACK`` of its slot of capacity / k empty
gives off a piece of the largest length of class k + 1, until what is left fits
its class well: few cuts, and little padding.

A worker needs nothing but its own rows, so there is no shuffle; it keeps at
most one open bin per class.  What its open bins hold in the end, less than a
sequence each, is laid end to end and cut at the capacity, so that only the
last sequence of a worker is padded for want of rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import settled

CAPACITY = 1024
#: Share of a slot that a piece may leave empty; more, and the piece is cut.
SLACK = 1 / 16
#: Characters on which both tokenizer libraries split words alike; other texts go to the slower one.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*+")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Texts to ids exactly as ``tokenizers`` gives them for ``json_path``.

    With the same vocabulary as ranks, ``tiktoken`` is some four times as fast
    and agrees on plain text; a text with anything else in it, or with the
    string of a special token, goes through ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids: whole capacities, then pieces that fit their classes."""
    parts, rest = [capacity] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        part = rest if slot - rest <= slack * slot else capacity // (k + 1)
        parts.append(part)
        rest -= part
    return parts


class Piece(NamedTuple):
    """A run of a document's ids."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int

    def split(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:n]), self._replace(start=self.start + n, ids=self.ids[n:])


class Bins:
    """Open bins of one worker: for each class the pieces that wait for their bin to fill."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.waiting = first_id, capacity, {}

    def _close(self, pieces: list[Piece]) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids), p.doc_tokens, self.next, at
            at += len(p.ids)
        self.next += 1

    def add(self, piece: Piece) -> Iterator[tuple]:
        """Yields the rows of a bin that is full now."""
        k = self.capacity // len(piece.ids)
        held = self.waiting.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.waiting[k]
            yield from self._close(held)

    def finish(self) -> Iterator[tuple]:
        """Lays what is left end to end, cut at the capacity."""
        held, room = [], self.capacity
        for _, pieces in sorted(self.waiting.items()):
            for piece in pieces:
                if len(piece.ids) > room:
                    first, piece = piece.split(room)
                    yield from self._close([*held, first])
                    held, room = [], self.capacity
                held.append(piece)
                room -= len(piece.ids)
                if not room:
                    yield from self._close(held)
                    held, room = [], self.capacity
        if held:
            yield from self._close(held)
        self.waiting = {}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _pack(json_path: str, ranks_path: str | None, pattern: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = Encoder(json_path, ranks_path, pattern), Bins(TaskContext.get().partitionId() << 33, capacity)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                start = 0
                for length in cut(len(ids), capacity):
                    out.extend(bins.add(Piece(doc, start, ids[start : start + length], len(ids))))
                    start += length
            yield _rows(out)
        yield _rows(list(bins.finish()))

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; a text of any length is encoded
    whole.  Repeated and null doc_ids are rows like others: each row is cut and
    packed by itself.  ``sequence_id`` holds the partition in its upper bits;
    rows that come out of a shuffle are written first, so that a task that runs
    again reads the same rows in the same order and gives the same bins.  Other
    columns are not read.
    """
    rows = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "documents")
    return rows.mapInArrow(_pack(json_path, ranks_path, pattern, capacity, end_id), SCHEMA)
