"""Vector bin packing of token sequences under simultaneous limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.bpe import word_bpe
from stratalog.llm.common import bounded_batches, released

#: Items that wait for a place at once, in one task; with the token bound below it fixes the task's memory.
POOL_ITEMS, POOL_TOKENS = 2048, 2_000_000


@dataclass
class Limits:
    """What one sequence holds at most."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass
class Piece:
    """A cut of an item in its place: ``[start, start + length)`` of the item, at ``offset`` of the sequence."""

    item: object
    start: int
    length: int
    sequence: int
    offset: int


class DotProductPacker:
    """Fills one open sequence after another; each next segment has the largest dot product with what is left of the limits.

    Items are (key, tokens, loss-free tokens at their head). An item longer than a sequence gives whole sequences first.
    If nothing that waits fits whole, the waiting item with the largest dot product is cut to fill the sequence exactly.
    A sequence closes when it is full in any of the three dimensions. Ties go to the item that came first.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.keys: list[object] = []
        self.starts = np.zeros(0, np.int64)
        self.left = np.zeros(0, np.int64)
        self.free = np.zeros(0, np.int64)
        self.sequence = 0
        self.room = self.caps.copy()
        self.offset = 0

    def close(self) -> None:
        if self.offset:
            self.sequence += 1
            self.room, self.offset = self.caps.copy(), 0

    def add(self, items: Iterable[tuple[object, int, int]]) -> Iterator[Piece]:
        """Take items in; give the pieces of those that get their place now."""
        keys, starts, left, free = [], [], [], []
        for key, tokens, unscored in items:
            keys.append(key)
            starts.append(0)
            left.append(tokens)
            free.append(min(unscored, tokens))
        self.keys += keys
        self.starts, self.left, self.free = (np.concatenate([a, np.asarray(b, np.int64)]) for a, b in ((self.starts, starts), (self.left, left), (self.free, free)))
        yield from self._fill(POOL_ITEMS // 2, POOL_TOKENS // 2)

    def finish(self) -> Iterator[Piece]:
        yield from self._fill(0, 0)
        self.close()

    def _fill(self, items: int, tokens: int) -> Iterator[Piece]:
        """Place items until at most so many wait."""
        waiting = int(self.left.sum())
        alive = int((self.left > 0).sum())
        while alive and (alive > items or waiting > tokens):
            cap, loss_cap = self.room[0], self.room[2]
            loss = self.left - self.free
            fits = (self.left > 0) & (self.left <= cap) & (loss <= loss_cap)
            demand = self.left / self.caps[0] * (self.room[0] / self.caps[0]) + loss / self.caps[2] * (self.room[2] / self.caps[2]) + self.room[1] / self.caps[1] ** 2
            if fits.any():
                at = int(np.argmax(np.where(fits, demand, -1.0)))
                take = int(self.left[at])
            else:
                at = int(np.argmax(np.where(self.left > 0, demand, -1.0)))
                # as many tokens as both the token and the loss limit still take
                take = int(min(cap, self.free[at] + loss_cap, self.left[at]))
            if take:
                unscored = min(int(self.free[at]), take)
                yield Piece(self.keys[at], int(self.starts[at]), take, self.sequence, self.offset)
                self.starts[at] += take
                self.left[at] -= take
                self.free[at] -= unscored
                self.offset += take
                self.room -= (take, 1, take - unscored)
                waiting -= take
                alive -= self.left[at] == 0
            if not take or self.room[0] < 1 or self.room[1] < 1 or self.room[2] < 1:
                self.close()
            if len(self.left) > 64 and alive < len(self.left) // 2:
                self._compact()
        self._compact()

    def _compact(self) -> None:
        keep = np.flatnonzero(self.left > 0)
        self.keys = [self.keys[i] for i in keep]
        self.starts, self.left, self.free = self.starts[keep], self.left[keep], self.free[keep]


COLUMNS = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, padded_to long"


class _Out:
    """Pieces of one task on their way out; a sequence leaves when it is closed, as its length is known only then."""

    def __init__(self, limits: Limits, base: int):
        self.limits, self.base, self.pieces, self.tokens = limits, base, [], 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.tokens += piece.length

    def batches(self, open_sequence: int | None) -> Iterator[pa.RecordBatch]:
        if open_sequence is not None and self.tokens < POOL_TOKENS:
            return
        ready = [p for p in self.pieces if open_sequence is None or p.sequence < open_sequence]
        self.pieces = [p for p in self.pieces if open_sequence is not None and p.sequence >= open_sequence]
        self.tokens = sum(p.length for p in self.pieces)
        if ready:
            yield self.batch(ready)

    def batch(self, pieces: list[Piece]) -> pa.RecordBatch:
        used: dict[int, int] = {}
        for p in pieces:
            used[p.sequence] = max(used.get(p.sequence, 0), p.offset + p.length)
        ids = [p.item[1][4 * p.start : 4 * (p.start + p.length)] for p in pieces]
        columns = {
            "doc_id": [p.item[0] for p in pieces],
            "start": [p.start for p in pieces],
            "length": [p.length for p in pieces],
            "ids": ids,
            "ids_crc32": [zlib.crc32(b) for b in ids],
            "doc_tokens": [len(p.item[1]) // 4 for p in pieces],
            "sequence_id": [self.base + p.sequence for p in pieces],
            "offset": [p.offset for p in pieces],
            "loss_tokens": [p.length - (p.start == 0) for p in pieces],
            "padded_to": [u if (u := used[p.sequence]) & (u - 1) == 0 else self.limits.tokens for p in pieces],
        }
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in columns.items()], names=list(columns))


def packed_documents(docs: DataFrame, vocabulary: str, end_id: int, limits: Limits | None = None, text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Tokenise every whole text, append ``end_id`` and pack the ids into sequences.

    Returns per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit; left out if not
    ``with_ids``), ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, padded_to. Each id of each row lies in
    exactly one piece. The first id of a document has no context and bears no loss. ``padded_to`` is the length the
    sequence is stored with: its own, if that is a power of two, else ``limits.tokens``.

    Narrow: every task packs the rows of its own partition, holding a bounded pool of waiting items, and leaves at
    most one sequence partly filled, so padding is below one sequence a task, and a retried task gives the same
    pieces. ``sequence_id`` holds the partition in its high bits. A null or empty text is packed as its end id alone;
    a null id stays null; repeated rows are packed once each; no input gives no rows; extra columns are ignored.
    """
    limits = limits or Limits()
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    end = np.asarray([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = word_bpe(vocabulary), DotProductPacker(limits)
        out = _Out(limits, TaskContext.get().partitionId() << 33)
        pending, tokens = [], 0

        def trimmed(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in made:
                yield b if with_ids else b.drop_columns(["ids"])

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1).to_pylist())):
                ids += end
                pending.append(((key, ids), len(ids) // 4, 1))
                tokens += len(ids) // 4
                if len(pending) >= POOL_ITEMS // 2 or tokens >= POOL_TOKENS // 2:
                    for p in packer.add(pending):
                        out.put(p)
                    pending, tokens = [], 0
                    yield from trimmed(out.batches(packer.sequence))
        for p in packer.add(pending):
            out.put(p)
        for p in packer.finish():
            out.put(p)
        yield from trimmed(out.batches(None))

    return rows.mapInArrow(pack, COLUMNS if with_ids else COLUMNS.replace(" ids binary,", ""))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all that is left, packed into sequences with their ids."""
    import public_tokenizers

    released(spark)
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
