"""Sorted-string-table shards of token ids: prefix-compressed key blocks, sparse block index, Bloom filter and footer.

One shard file, all integers little-endian::

    magic "STRSST1\\n"
    blocks, one after another. A block holds up to BLOCK_ROWS records and is
        u32 records, then per record: u8 bytes shared with the key before, u8 further key bytes, u32 ids, those key bytes,
        then the records' ids in the same order, as unsigned integers of the footer's id width
    index: per block u64 offset, u32 bytes, u64 tokens before it in the shard, u8 length of the first key, first key
    bloom: the filter's bits
    footer: JSON, then u32 its length, then magic "STRFOOT\\n"

Keys sort as bytes: an integer id is its big-endian value with the sign bit turned over; a null id is the empty key.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.bpe import word_bpe
from stratalog.llm.common import bounded_batches, shared_dir

MAGIC, FOOT = b"STRSST1\n", b"STRFOOT\n"
BLOCK_ROWS = 64
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: Input bytes (compressed columns) behind one shard.
SHARD_BYTES = 16 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; the names that Hadoop's drivers have for S3 are taken as S3."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes records in ascending key order to a file that appears under its name only when complete."""

    def __init__(self, uri: str, width: int = 4):
        self.fs, self.path = _place(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.file = self.fs.open_output_stream(self.temporary)
        self.file.write(MAGIC)
        self.at, self.width, self.tokens, self.before = len(MAGIC), width, 0, 0
        self.rows: list[tuple[bytes, bytes]] = []
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys out of order")
        self.last = key
        self.keys.append(key)
        self.rows.append((key, ids.astype(f"<u{self.width}").tobytes()))
        if len(self.rows) == BLOCK_ROWS:
            self.flush()

    def flush(self) -> None:
        if not self.rows:
            return
        heads, previous = [struct.pack("<I", len(self.rows))], b""
        for key, ids in self.rows:
            shared = next((i for i, (a, b) in enumerate(zip(previous, key)) if a != b), min(len(previous), len(key)))
            heads.append(struct.pack("<BBI", shared, len(key) - shared, len(ids) // self.width) + key[shared:])
            previous = key
        block = b"".join([*heads, *(ids for _, ids in self.rows)])
        first = self.rows[0][0]
        self.index.append(struct.pack("<QIQB", self.at, len(block), self.before, len(first)) + first)
        self.file.write(block)
        self.at += len(block)
        self.before += sum(len(ids) for _, ids in self.rows) // self.width
        self.rows = []

    def close(self) -> dict:
        self.flush()
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in set(self.keys):
            for place in _bloom_places(key, bits):
                bloom[place >> 3] |= 1 << (place & 7)
        index = b"".join(self.index)
        foot = {"records": len(self.keys), "tokens": self.before, "id_width": self.width, "blocks": len(self.index), "index": [self.at, len(index)], "bloom": [self.at + len(index), len(bloom)], "bloom_bits": bits}
        said = json.dumps(foot).encode()
        self.file.write(index + bytes(bloom) + said + struct.pack("<I", len(said)) + FOOT)
        self.file.close()
        self.fs.move(self.temporary, self.path)
        return foot


class ShardReader:
    """Reads a shard: the footer and index at once, blocks as they are asked for."""

    def __init__(self, uri: str):
        self.fs, self.path = _place(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        tail = self._read(size - 12, 12)
        if tail[4:] != FOOT or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no complete shard")
        said = struct.unpack("<I", tail[:4])[0]
        self.foot = json.loads(self._read(size - 12 - said, said))
        raw, at = self._read(*self.foot["index"]), 0
        self.blocks: list[tuple[int, int, int]] = []
        self.first: list[bytes] = []
        while at < len(raw):
            offset, length, before, n = struct.unpack_from("<QIQB", raw, at)
            at += 21
            self.blocks.append((offset, length, before))
            self.first.append(raw[at : at + n])
            at += n

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """key, tokens of the shard before it, ids."""
        offset, length, before = self.blocks[k]
        raw, width = self._read(offset, length), self.foot["id_width"]
        at, key, heads = 4, b"", []
        for _ in range(struct.unpack_from("<I", raw)[0]):
            shared, more, n = struct.unpack_from("<BBI", raw, at)
            key = key[:shared] + raw[at + 6 : at + 6 + more]
            at += 6 + more
            heads.append((key, n))
        for key, n in heads:
            yield key, before, np.frombuffer(raw, f"<u{width}", n, at)
            at += n * width
            before += n

    def __iter__(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        bloom = self._read(*self.foot["bloom"])
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.foot["bloom_bits"]))

    def lookup(self, key: bytes) -> list[np.ndarray]:
        """All records of a key: Bloom filter, binary search in the index, then the blocks that can hold it."""
        if not self.first or not self.may_hold(key):
            return []
        k = max(0, bisect.bisect_left(self.first, key) - 1)
        out = []
        while k < len(self.blocks) and self.first[k] <= key:
            out += [ids for found, _, ids in self.block(k) if found == key]
            k += 1
        return out

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int, text: str = "text", doc_id: str = "doc_id") -> list[dict]:
    """Tokenise whole texts and write them as shards in ascending id order; returns each shard's path, records and tokens.

    One range shuffle of the raw texts by (id, hash of the text), so that rows with one id spread over shards too; ids
    are made after it, and each task streams its sorted rows into one file. Files take their place by renaming, under
    a name fixed by the partition, so retried and speculative tasks do no harm. The driver gets one small row a shard.
    Null ids come first with an empty key; null texts count as empty; repeated rows are repeated records; no rows give
    no shards; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(shards, *key).sortWithinPartitions(*key)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, writer = word_bpe(vocabulary), None
        part = TaskContext.get().partitionId()
        path = f"{folder}/shard-{part:06d}.sst"
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for i, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1).to_pylist())):
                writer = writer or ShardWriter(path, 4 if bpe.wide or end_id > 0xFFFF else 2)
                writer.add(key_of(i), np.frombuffer(ids + end, "<u4"))
        if writer:
            foot = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int64()), "path": [path], "records": pa.array([foot["records"]], pa.int64()), "tokens": pa.array([foot["tokens"]], pa.int64())})

    # sorted here: a distributed sort would sample its input first, and so make every shard twice
    made = rows.mapInArrow(write, "shard long, path string, records long, tokens long").collect()
    return [r.asDict() for r in sorted(made, key=lambda r: r["shard"])]


def read_shards(spark: SparkSession, shards: list[dict], with_ids: bool = False) -> DataFrame:
    """The records of shards: doc_id, start (ids of all records before), n_tokens, ids_crc32 and, if asked for, ids."""
    at, rows = 0, []
    for s in shards:
        rows.append((s["path"], at))
        at += s["tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(path)
                for k in range(len(reader.blocks)):
                    got = [(id_of(key), base + before, len(ids), ids.astype("<u4").tobytes()) for key, before, ids in reader.block(k)]
                    columns = [pa.array([g[i] for g in got], pa.int64()) for i in range(3)] + [pa.array([zlib.crc32(g[3]) for g in got], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([g[3] for g in got], pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                reader.close()

    paths = spark.createDataFrame(rows, "path string, base long")
    return paths.repartition(max(1, len(rows)), "path").mapInArrow(read, schema)


def shard_count(docs: DataFrame) -> int:
    """Shards by the input's stored size, as the optimizer knows it from file sizes; no job runs."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-size // SHARD_BYTES))


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as shards of token ids and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = shared_dir(spark)
    shards = write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1, shards=shard_count(docs))
    return read_shards(spark, shards)
