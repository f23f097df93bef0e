"""Byte-level BPE through a table of distinct words.

Texts are split into units (white space and the word after it; no pre-token
of the tokenizer spans two; a text with white space beyond ASCII is one unit).
One packed exchange gathers each distinct unit, which is encoded once with the
library and stored, with its bytes, in a shard by hash.  A second pass joins
ids back by position: each piece of text finds its units by hash in the
shards, which executors map from the shared folder, compares their bytes, and
lays the ids out in text order.  Decoding joins ids to the vocabulary's pieces.

Every unit is in the table, whatever its length; only a unit that shares its
64-bit hash with another one is encoded where it is met.  Shards are as many
as the input's bytes ask for, which bounds the memory of a task.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import encoders, exchange
from lexloom.llm import textkit as tk
from lexloom.llm.store import MOST_OPEN, open_file, parts_for, small_batches, work_dir, write_file, written

U = np.uint64
#: Bytes of input for each shard, and hashes that a task remembers to have sent (others are sent again).
SHARD_BYTES, SENT_KEYS = 64 << 20, 3_000_000
#: Units that a task gathers before it leaves repeated ones out.
MERGE_UNITS = 500_000
#: Bytes of shards that a worker holds where the shared folder can't be mapped.
CACHE_BYTES = 128 << 20


def distinct_units(docs: DataFrame, parts: int, remembered: int = SENT_KEYS) -> DataFrame:
    """Rows ``part, keys, sizes, data`` of units, each at most once a task (while it remembers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, U)
        for _, buf, off in tk.pieces(batches):
            s, e, _ = encoders.units(buf, off)
            keys, rep = np.unique(tk.slice_hashes(buf, s, e), return_index=True)
            if len(sent):
                at = np.minimum(np.searchsorted(sent, keys), len(sent) - 1)
                new = sent[at] != keys
                keys, rep = keys[new], rep[new]
            if len(sent) + len(keys) > remembered:
                sent = np.zeros(0, U)
            sent = np.union1d(sent, keys)
            s, e, rows = s[rep], e[rep], []
            for part, i in exchange.by_part(keys, parts):
                rows.append((part, keys[i].tobytes(), (e[i] - s[i]).astype(np.uint32).tobytes(), encoders.joined_slices(buf, s[i], e[i]).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "keys", "sizes", "data"])

    return docs.mapInArrow(run, "part int, keys binary, sizes binary, data binary")


def build_table(spark: SparkSession, docs: DataFrame, path: str, folder: str, *, shard_bytes: int = SHARD_BYTES, remembered: int = SENT_KEYS) -> tuple[dict[int, str], int]:
    """Encodes each distinct unit once; the shards' places and the number of parts."""
    parts = parts_for(docs, shard_bytes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, fresh = [], None, 0
        for b in batches:
            for part, keys, sizes, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((np.frombuffer(keys, U), np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(data, np.uint8)))
                fresh += len(held[-1][0])
                if fresh > MERGE_UNITS:
                    held, fresh = [_once(held)], 0
        if part is None:
            return
        keys, size, data = _once(held)
        uri = f"{folder}/units-{part}.arrow"
        ends, out = np.cumsum(size), []
        for i in range(0, len(keys), 8192):
            a, b = ends[i : i + 8192] - size[i : i + 8192], ends[i : i + 8192]
            ids, n = encoders.encoded(path, data, a, b)
            out.append(pa.RecordBatch.from_arrays([
                pa.array(keys[i : i + 8192]),
                pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(np.append(a, b[-1]) - a[0]), pa.py_buffer(data[a[0] : b[-1]])]),
                pa.LargeListArray.from_arrays(np.append(0, np.cumsum(n)), pa.array(ids)),
            ], ["key", "unit", "ids"]))
        table = pa.Table.from_batches(out).combine_chunks()

        def write(stream):
            with pa.ipc.new_file(stream, table.schema) as w:
                w.write_table(table)

        write_file(uri, write)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(keys)], pa.int64())], ["part", "uri", "units"])

    made = distinct_units(docs, parts, remembered).repartitionById(parts, F.col("part")).mapInArrow(encode, "part int, uri string, units long")
    return {r.part: r.uri for r in written(made, f"{folder}/shards").collect()}, parts


def _once(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, sizes and bytes of units, each hash once, in order."""
    keys, size, data = (np.concatenate(x) for x in zip(*held, strict=True))
    keys, rep = np.unique(keys, return_index=True)
    end = np.cumsum(size)
    return keys, size[rep], encoders.joined_slices(data, end[rep] - size[rep], end[rep])


class SharedTable:
    """Unit shards by number; mapped ones cost no memory, others are kept up to a bound."""

    def __init__(self, uris: dict[int, str], parts: int, limit: int = CACHE_BYTES):
        self.uris, self.parts, self.limit, self.open = uris, parts, limit, OrderedDict()

    def _shard(self, part: int):
        if part in self.open:
            self.open.move_to_end(part)
            return self.open[part]
        f = open_file(self.uris[part])
        t = pa.ipc.open_file(f).read_all().combine_chunks()
        unit, lists = t["unit"].chunk(0), t["ids"].chunk(0)
        # views of the file: the offsets of these types have 64 bits
        _, where, data = unit.buffers()
        where, data = np.frombuffer(where, np.int64, len(unit) + 1), np.frombuffer(data, np.uint8)
        shard = (t["key"].chunk(0).to_numpy(), where, data, lists.offsets.to_numpy(), lists.values.to_numpy(), 0 if isinstance(f, pa.MemoryMappedFile) else t.nbytes)
        self.open[part] = shard
        while len(self.open) > 1 and (len(self.open) > MOST_OPEN or sum(s[-1] for s in self.open.values()) > self.limit):
            self.open.popitem(last=False)
        return shard

    def find(self, keys: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each unit: whether it is there, where its ids start in the last array, and how many."""
        hit, at, size, ids, base = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        for part, i in exchange.by_part(keys, self.parts):
            if part not in self.uris:
                continue
            own, where, data, off, flat, _ = self._shard(part)
            place = np.minimum(np.searchsorted(own, keys[i]), len(own) - 1)
            ok = own[place] == keys[i]
            i, place = i[ok], place[ok]
            ok = tk.same_bytes(buf, s[i], e[i], data, where[place], where[place + 1])
            i, place = i[ok], place[ok]
            n = off[place + 1] - off[place]
            hit[i], size[i] = True, n
            at[i] = base + np.cumsum(n) - n
            ids.append(encoders.gather(flat, off[place], n))
            base += len(ids[-1])
        return hit, at, size, np.concatenate(ids) if ids else np.zeros(0, np.uint32)


def joined_ids(table: SharedTable, path: str, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, one after another, and where each text's ids start."""
    s, e, first = encoders.units(buf, off)
    keys, rep, back = encoders.distinct(buf, s, e)
    hit, at, size, ids = table.find(keys, buf, s[rep], e[rep])
    miss = np.flatnonzero(~hit)
    if len(miss):  # they share their hash with another unit
        more, n = encoders.encoded(path, buf, s[rep[miss]], e[rep[miss]])
        at[miss], size[miss] = len(ids) + np.cumsum(n) - n, n
        ids = np.concatenate([ids, more])
    return encoders.gather(ids, at[back], size[back]), np.concatenate([[0], np.cumsum(size[back])])[first]


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and other bytes from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(2)
def pieces_of(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' bytes, and where the piece of each id starts: the table of a bounded vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    table = _byte_of_char()
    by_id = {i: bytes(table[c] for c in p) if all(c in table for c in p) else p.encode() for p, i in vocabulary.items()}
    pieces = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)


def decoded(path: str, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Texts from ids, joined to their pieces; invalid UTF-8 is replaced."""
    flat, off = pieces_of(path)
    at, size = off[ids], off[ids + np.uint32(1)] - off[ids]
    data = encoders.gather(flat, at, size).tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
    return [data[a:b] if _valid(data[a:b]) else data[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def round_trip(spark: SparkSession, docs: DataFrame, path: str, *, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row.

    ``ids`` are little-endian unsigned 32-bit integers, as the library encodes
    the whole text without added special tokens; ``decoded`` is what they
    decode to, special tokens included.  A null text is empty: no ids and an
    empty text.  Repeated rows each have a row; ids may be null; further
    columns are ignored.
    """
    small_batches(spark)
    folder = work_dir(spark, "bpe-words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    uris, parts = build_table(spark, rows, path, folder, shard_bytes=shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = SharedTable(uris, parts)
        for batch, buf, off in tk.pieces(batches, size=tk.BLOCK // 2):
            ids, bounds = joined_ids(table, path, buf, off)
            flat = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), tk.strings([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]), pa.array(decoded(path, ids, bounds), pa.binary()).cast(pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
