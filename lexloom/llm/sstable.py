"""Token ids in sorted-string-table shards.

A shard is one file of documents in ascending key order:

    block 0 | block 1 | ... | index | Bloom filter | footer (64 bytes)

The key is a byte that is 0 for rows without an id and 1 for others, then the
id as 8 bytes, big-endian with the sign bit flipped, so that byte order is
numeric order, then 4 bytes that number rows with the same id.  A block holds entries until it has ``BLOCK_BYTES``: for each
``shared:uvarint  rest:uvarint  size:uvarint  rest-of-key  value``, where
``shared`` is the length of the prefix shared with the entry before; the block
is compressed with zstd.  The value is the ids as little-endian unsigned
integers of the shard's width (2 bytes where every id of the vocabulary fits,
else 4).  The index has, for each block, its first key, place, size, rows and
ids; a reader finds a key by binary search in it and reads one block.  The
footer has the places of index and filter, the numbers of rows, ids and
blocks, the width and a magic number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import encoders
from lexloom.llm import textkit as tk
from lexloom.llm.store import open_file, parts_for, small_batches, work_dir, write_file, written

BLOCK_BYTES = 1 << 18
#: Bytes of input for each shard.
SHARD_BYTES = 256 << 20
MAGIC = b"LXSSTBL2"
FOOTER = struct.Struct("<QQQQQQII8s")  # index at, filter at, filter bytes, rows, ids, blocks, width, hashes, magic
KEY_BYTES = 13
ENTRY = struct.Struct(f"<{KEY_BYTES}sQIIQ")  # first key, place, size, rows, ids
BITS_A_KEY, HASHES = 10, 7


def key_of(doc_id: int | None, number: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, ((doc_id or 0) & (1 << 64) - 1) ^ 1 << 63, number)


def id_of(key: bytes) -> int | None:
    if not key[0]:
        return None
    x = struct.unpack(">Q", key[1:9])[0] ^ 1 << 63
    return x - (1 << 64) if x >> 63 else x


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(ids: list[int | None], size: int) -> np.ndarray:
    h = tk.mix(np.array([i or 0 for i in ids], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = tk.mix(h) | np.uint64(1)
    return np.concatenate([(h + np.uint64(i) * step) % np.uint64(size) for i in range(HASHES)])


class Writer:
    """Appends documents in key order to a stream."""

    def __init__(self, out, width: int):
        self.out, self.width, self.place = out, width, 0
        self.index: list[bytes] = []
        self.keys: list[int | None] = []
        self.rows = self.ids = 0
        self._fresh()

    def _fresh(self):
        self.block, self.block_rows, self.block_ids, self.first, self.last = bytearray(), 0, 0, b"", b""

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        value = ids.astype(f"<u{self.width}").tobytes()
        number = 0
        if self.keys and self.keys[-1] == doc_id:
            number = self.repeat + 1
        self.repeat = number
        key = key_of(doc_id, number)
        shared = 0
        if self.block_rows:
            while shared < KEY_BYTES and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += _varint(shared) + _varint(KEY_BYTES - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.block_rows += 1
        self.block_ids += len(ids)
        self.keys.append(doc_id)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self):
        if not self.block_rows:
            return
        data = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
        self.out.write(data)
        self.index.append(ENTRY.pack(self.first, self.place, len(data), self.block_rows, self.block_ids))
        self.place += len(data)
        self.rows += self.block_rows
        self.ids += self.block_ids
        self._fresh()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        self.out.write(index)
        size = max(64, -(-len(self.keys) * BITS_A_KEY // 8) * 8)
        field = np.zeros(size, np.uint8)
        if self.keys:
            field[_bits(self.keys, size).astype(np.int64)] = 1
        bloom = np.packbits(field, bitorder="little").tobytes()
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.place, self.place + len(index), len(bloom), self.rows, self.ids, len(self.index), self.width, HASHES, MAGIC))


class Reader:
    """Looks documents up by id, or walks through all of them."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        end = self.file.size()
        at, bloom, n_bloom, self.rows, self.ids, blocks, self.width, _, magic = FOOTER.unpack(self._read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        raw = self._read(at, blocks * ENTRY.size)
        self.index = [ENTRY.unpack_from(raw, i * ENTRY.size) for i in range(blocks)]
        self.bloom = np.unpackbits(np.frombuffer(self._read(bloom, n_bloom), np.uint8), bitorder="little")

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, i: int) -> Iterator[tuple[int | None, np.ndarray]]:
        _, place, size, rows, _ = self.index[i]
        data = zstandard.ZstdDecompressor().decompress(self._read(place, size))
        at, key = 0, b""
        for _ in range(rows):
            shared, at = _unvarint(data, at)
            rest, at = _unvarint(data, at)
            n, at = _unvarint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield id_of(key), np.frombuffer(data, f"<u{self.width}", n // self.width, at)
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every row with this doc_id; the filter spares most absent ones a read."""
        if not self.bloom[_bits([doc_id], len(self.bloom)).astype(np.int64)].all():
            return []
        want, lo, hi = key_of(doc_id), 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.index[mid][0] <= want:
                lo = mid + 1
            else:
                hi = mid
        found = []
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0] > key_of(doc_id, (1 << 32) - 1):
                break
            found += [v for k, v in self.block(i) if k == doc_id]
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(spark: SparkSession, docs: DataFrame, path: str, folder: str, *, end_id: int | None = 1, width: int = 2, shards: int | None = None) -> DataFrame:
    """Encodes and writes all documents; a table ``shard, uri, rows, ids, first_id`` in ascending order.

    Shards are ranges of doc_id with about equally many rows, found from the
    ids alone, so texts are encoded once and only compact ids are shuffled.
    A null text is empty; rows without an id come first; rows that repeat an id
    (or have none) are all kept, in the order of their ids' bytes.  An empty
    table writes no shard.
    """
    small_batches(spark)
    n = shards or parts_for(docs, SHARD_BYTES)
    at = [i / n for i in range(1, n)]
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, at)) if at else F.array(F.lit(0.5)), F.lit(100_000)).alias("c")).first().c
    cuts = sorted(set(cuts or []))[: n - 1] if at else []
    kind = f"<u{width}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoders.worker_encoder(path)
        for batch, buf, off in tk.pieces(batches):
            ids, bounds = encoder.encode(buf, off)
            if len(ids) and int(ids.max()) >> 8 * width:
                raise ValueError(f"an id needs more than {width} bytes")
            end = np.array([] if end_id is None else [end_id], kind)
            flat = ids.astype(kind)
            key = batch.column(0).fill_null(-(1 << 63)).to_numpy()  # those without an id are in the first shard
            part = np.searchsorted(np.array(cuts, np.int64), key, "left")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), batch.column(0), tk.strings([np.concatenate([flat[a:b], end]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])],
                ["part", "doc_id", "ids"],
            )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, d, v) for b in batches for p, d, v in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            part, held = row[0], {}

            def write(out, part=part, held=held):
                nonlocal row
                w = Writer(out, width)
                held["first"] = row[1]
                while row is not None and row[0] == part:
                    w.add(row[1], np.frombuffer(row[2], kind))
                    row = next(rows, None)
                w.close()
                held.update(rows=w.rows, ids=w.ids)

            uri = f"{folder}/shard-{part:08d}.sst"
            write_file(uri, write)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([uri]), pa.array([held["rows"]]), pa.array([held["ids"]]), pa.array([held["first"]])],
                ["shard", "uri", "rows", "ids", "first_id"],
            )

    encoded = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .mapInArrow(encode, "part int, doc_id long, ids binary")
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("part", "doc_id", "ids")
    )
    return written(encoded.mapInArrow(store, "shard int, uri string, rows long, ids long, first_id long"), f"{folder}/shards")


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files.

    ``start`` is the number of ids of all documents before it: the running sum
    over the shards' totals (one row a shard) and then inside each shard.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # an explicit number of partitions: rows are small, but each stands for a file to read
    parts = parts_for(shards, 1 << 10)
    jobs = shards.select("shard", "uri", before.alias("start")).repartitionById(parts, (F.col("shard") % parts).cast("int")).drop("shard").select(F.lit(0), "uri", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                reader = Reader(uri)
                out: list[tuple] = []
                for doc_id, ids in reader:
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 8192:
                        yield _rows(out)
                        out = []
                reader.close()
                if out:
                    yield _rows(out)

    return jobs.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_table(spark: SparkSession, docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shards below the shared folder and reads them back."""
    folder = work_dir(spark, "sstable")
    return read_shards(spark, write_shards(spark, docs, path, folder, **options))
