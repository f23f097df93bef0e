"""Line deduplication against a sharded minimal perfect hash.

A first pass sends each distinct line key of a piece of input, as a 64-bit
hash with a fingerprint, its number of documents and its largest one, to a
shard.  A shard's minimal perfect hash maps all distinct line hashes to
``0..n-1``; arrays at that place hold the fingerprint, the count, which sums
what the pieces sent, and the document that keeps the line.  A second pass
probes the arrays for every line, and the count decides; nothing is joined and
no document is shuffled.  Hash and fingerprint are independent 64-bit hashes
of the key: two lines are the same when both agree.  Shard files are laid out
for mapping, so that a probe touches the pages that it needs.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import exchange
from lexloom.llm import textkit as tk
from lexloom.llm.store import MOST_OPEN, bytes_of, open_file, small_batches, work_dir, write_file, written

#: Bytes of input for each shard.
SHARD_BYTES = 128 << 20
#: Bytes of shards that a worker keeps at a time where they can't be mapped.
CACHE_BYTES = 64 << 20
#: Entries that a shard's task gathers before it adds up equal ones.
MERGE_ENTRIES = 1_000_000
U = np.uint64


class PerfectHash:
    """Minimal perfect hash: levels of bit arrays; a key sits at the first level where it is alone.

    ``sizes`` are the levels' bits, ``words`` the bits of all levels, each
    filled up to whole words, and ``ranks`` the bits set before each word.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.concatenate([[0], np.cumsum(-(-sizes // 64))]).astype(np.int64)

    @staticmethod
    def of(keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, sizes, bits = keys, [], [np.zeros(0, np.uint8)]
        while len(left):
            size = max(64, -(-int(len(left) * gamma) // 64) * 64)
            at = PerfectHash._place(left, len(sizes), size)
            met = np.bincount(at, minlength=size)
            sizes.append(size)
            bits.append(np.packbits(met == 1, bitorder="little"))
            left = left[met[at] != 1]
        words = np.concatenate(bits).view(U)
        ones = np.bitwise_count(words).astype(np.int64)
        return PerfectHash(np.array(sizes, np.int64), words, np.cumsum(ones) - ones)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tk.mix(keys + U((level + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)) % U(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 or any place for keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = self._place(keys[open_], level, size)
            word = self.starts[level] + (at >> 6)
            mask, found = U(1) << (at & 63).astype(U), self.words[word]
            hit = (found & mask) != 0
            out[open_[hit]] = self.ranks[word[hit]] + np.bitwise_count(found[hit] & (mask[hit] - U(1)))
            open_ = open_[~hit]
        return out


#: Arrays of a shard file, in order, with their types.
ARRAYS = (("sizes", "<i8"), ("words", "<u8"), ("ranks", "<i8"), ("mark", "<u8"), ("count", "<i8"), ("keeper", "<i8"), ("twin_key", "<u8"), ("twin_mark", "<u8"), ("twin_count", "<i8"), ("twin_keeper", "<i8"))


class Shard:
    """Fingerprints, counts and keepers by perfect hash."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        mapped = isinstance(self.file, pa.MemoryMappedFile)
        data = self.file.read_buffer()
        head = int.from_bytes(data[:8].to_pybytes(), "little")
        lengths, at = json.loads(data[8 : 8 + head].to_pybytes()), 8 + head
        for (name, kind), n in zip(ARRAYS, lengths, strict=True):
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += 8 * n
        self.hash = PerfectHash(self.sizes, self.words, self.ranks)
        self.nbytes = 0 if mapped else data.size

    @staticmethod
    def write(uri: str, keys, mark, count, keeper) -> None:
        """``keys`` in order; lines that share the hash of another are kept apart, by hash and fingerprint."""
        twin = np.zeros(len(keys), bool)
        twin[1:] = keys[1:] == keys[:-1]
        arrays = {"twin_key": keys[twin], "twin_mark": mark[twin], "twin_count": count[twin], "twin_keeper": keeper[twin]}
        keys, mark, count, keeper = keys[~twin], mark[~twin], count[~twin], keeper[~twin]
        mphf = PerfectHash.of(keys)
        at = mphf(keys)
        arrays |= {"sizes": mphf.sizes, "words": mphf.words, "ranks": mphf.ranks}
        for name, x in (("mark", mark), ("count", count), ("keeper", keeper)):
            arrays[name] = np.empty_like(x)
            arrays[name][at] = x
        head = json.dumps([len(arrays[name]) for name, _ in ARRAYS]).encode()
        head += b" " * (-len(head) % 8)

        def put(out):
            out.write(len(head).to_bytes(8, "little") + head)
            for name, kind in ARRAYS:
                out.write(arrays[name].astype(kind).tobytes())

        write_file(uri, put)

    def probe(self, keys: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each line (0 if it isn't indexed), and the one that keeps it."""
        if not len(self.mark):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.hash(keys)
        hit = (at >= 0) & (self.mark[np.maximum(at, 0)] == mark)
        count, keeper = np.where(hit, self.count[np.maximum(at, 0)], 0), self.keeper[np.maximum(at, 0)]
        for k, m, n, d in zip(self.twin_key, self.twin_mark, self.twin_count, self.twin_keeper, strict=True):
            same = (keys == k) & (mark == m)
            count[same], keeper[same] = n, d
        return count, keeper


class Shards:
    """Shards by number; mapped ones cost no memory, of others those used last are kept up to a number of bytes."""

    def __init__(self, uris: dict[int, str], total: int, limit: int = CACHE_BYTES):
        self.uris, self.total, self.limit, self.open = uris, total, limit, OrderedDict()

    def __getitem__(self, i: int) -> Shard:
        if i in self.open:
            self.open.move_to_end(i)
        else:
            self.open[i] = Shard(self.uris[i])
            while len(self.open) > 1 and (len(self.open) > MOST_OPEN or sum(s.nbytes for s in self.open.values()) > self.limit):
                self.open.popitem(last=False)
        return self.open[i]

    def probe(self, keys: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, keeper = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for part, i in exchange.by_part(keys, self.total):
            if part in self.uris:
                count[i], keeper[i] = self[part].probe(keys[i], mark[i])
        return count, keeper


def lines(buf: np.ndarray, off: np.ndarray, least: int):
    """Starts and ends of all lines, the first line of each text, and the keys of the long ones.

    Returns ``start, end, first, long, key, mark``: ``long`` are the numbers of
    the lines whose key has at least ``least`` code points.
    """
    n = len(buf)
    breaks = np.flatnonzero(buf == 10)
    inner = np.concatenate([off[:-1], breaks + 1])
    order = np.argsort(inner, kind="stable")
    # a break as the last byte of a text opens an empty line that belongs to it, not to the next one
    owner = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])[order]
    start = inner[order]
    by = np.lexsort((start, owner))
    start, owner = start[by], owner[by]
    first = np.searchsorted(owner, np.arange(len(off)))
    end = np.empty_like(start)
    last = np.zeros(len(start), bool)
    last[first[1:] - 1] = True
    end[last] = off[1:]
    end[~last] = start[np.flatnonzero(~last) + 1] - 1
    solid = np.flatnonzero(~tk.SPACE[buf])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    full = np.flatnonzero(b > a)
    s, e = solid[a[full]], solid[b[full] - 1] + 1
    points = np.zeros(n + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    enough = points[e] - points[s] >= least
    long, s, e = full[enough], s[enough], e[enough]
    return start, end, first, long, tk.slice_hashes(buf, s, e, tk.LOWER), tk.slice_hashes(buf, s, e, tk.LOWER, 1)


def _added(keys, mark, count, keeper) -> tuple[np.ndarray, ...]:
    """Entries in order, equal ones added up."""
    order = np.lexsort((mark, keys))
    keys, mark, count, keeper = keys[order], mark[order], count[order], keeper[order]
    start = np.flatnonzero(exchange.groups(keys, mark))
    if not len(start):
        return keys, mark, count, keeper
    return keys[start], mark[start], np.add.reduceat(count, start), np.maximum.reduceat(keeper, start)


SENT = (("keys", U), ("marks", U), ("counts", np.int64), ("keepers", np.int64))


def _counted(docs: DataFrame, least: int, total: int) -> DataFrame:
    """``part, keys, marks, counts, keepers``: the line keys of each piece of the input, one packed row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tk.pieces(batches):
            _, _, first, long, key, mark = lines(buf, off, least)
            if not len(key):
                continue
            row = np.searchsorted(first, long, "right") - 1
            order = np.lexsort((row, mark, key))
            key, mark, row = key[order], mark[order], row[order]
            once = exchange.groups(key, mark, row)
            ids = tk.integers(batch, "doc_id")[row]
            entries = _added(key[once], mark[once], np.ones(int(once.sum()), np.int64), ids[once])
            rows = [(part, *(x[i].tobytes() for x in entries)) for part, i in exchange.by_part(entries[0], total)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["part", *(n for n, _ in SENT)])

    return docs.mapInArrow(run, "part int, keys binary, marks binary, counts binary, keepers binary")


def index(spark: SparkSession, docs: DataFrame, folder: str, *, min_points: int, shard_bytes: int = SHARD_BYTES) -> tuple[dict[int, str], int]:
    """Builds the shards over all distinct line keys; their places and number."""
    total = max(1, -(-bytes_of(docs) // shard_bytes))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, fresh = [], None, 0
        for b in batches:
            for part, *packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(tuple(np.frombuffer(x, t) for x, (_, t) in zip(packed, SENT, strict=True)))
                fresh += len(held[-1][0])
                if fresh > MERGE_ENTRIES:
                    held, fresh = [_added(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0
        if part is None:
            return
        uri = f"{folder}/lines-{part}.shard"
        Shard.write(uri, *_added(*(np.concatenate(x) for x in zip(*held, strict=True))))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri])], ["part", "uri"])

    made = _counted(docs, min_points, total).repartitionById(total, F.col("part")).mapInArrow(build, "part int, uri string")
    return {r.part: r.uri for r in written(made, f"{folder}/shards").collect()}, total


def deduplicated(spark: SparkSession, docs: DataFrame, *, min_docs: int = 5, min_points: int = 40, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` (text) of every row.

    Lines are split at ``\\n``; a null or empty text is one empty line.  A key
    is the line without ASCII white space at both ends, A-Z lower-cased.  Keys
    of at least ``min_points`` code points in at least ``min_docs`` documents
    lose all their lines except in the largest doc_id that has the key (there,
    all of them stay).  Every row counts as a document, and rows that
    repeat the keeper's id all keep the line; rows without an id come before
    all others (as -2^63 does).  Further columns are ignored.
    """
    small_batches(spark)
    folder = work_dir(spark, "lines")
    own = F.col("doc_id").cast("long")
    rows = docs.select(own.alias("own"), F.coalesce(own, F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    uris, total = index(spark, rows.drop("own"), folder, min_points=min_points, shard_bytes=shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(uris, total)
        for batch, buf, off in tk.pieces(batches):
            start, end, first, long, key, mark = lines(buf, off, min_points)
            ids = tk.integers(batch, "doc_id")
            count, keeper = shards.probe(key, mark)
            drop = np.zeros(len(start), bool)
            drop[long] = (count >= min_docs) & (keeper != ids[np.searchsorted(first, long, "right") - 1])
            dropped = np.add.reduceat(drop.astype(np.int64), first[:-1]) if len(start) else np.zeros(0, np.int64)
            data, texts = buf.tobytes(), []
            for i, n in enumerate(dropped.tolist()):
                a, b = first[i], first[i + 1]
                if n:
                    texts.append(b"\n".join(data[start[j] : end[j]] for j in range(a, b) if not drop[j]))
                else:
                    texts.append(data[off[i] : off[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), pa.array(dropped), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
