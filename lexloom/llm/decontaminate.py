"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of ``n`` distinct shingles is contained in a document when the
document has at least ``ceil(t * n)`` of them, so at most ``n - ceil(t * n)``
are missing.  The item's bottom-m MinHash sketch with ``m = n - ceil(t*n) + 1``
therefore shares a value with every such document, however long: unlike a
comparison of two sketches, membership of the small side's minima in the large
side does not fade with the large side's size, and no hit is lost.  Items are
partitioned by size (powers of two); a document skips partitions whose
smallest item needs more shingles than the document has.  Every candidate is
verified on the shingles themselves, as words, not as hashes.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import textkit as tk
from lexloom.llm.store import fits, open_file, small_batches, work_dir, write_file, written

HITS = "doc_id long, mark long, item_id long, item_shingles int, shared int, containment double"
#: Items per pass over the documents; more items take more passes.
BLOCK_ITEMS = 50_000
WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def word_list(text: str) -> list[str]:
    """Words: runs of ASCII letters and digits (A-Z lower-cased) and of all other non-ASCII characters."""
    return [w.translate(_FOLD) for w in WORD.findall(text)]


_FOLD = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str, k: int) -> set[tuple[str, ...]]:
    w = word_list(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def needed(n: int, threshold: float) -> int:
    """Least number of shared shingles: an exact ceiling of threshold * n."""
    return math.ceil(Fraction(str(threshold)) * n)


def _hashes(buf, off, k):
    s, e, first = tk.spans(buf, off, tk.SPACE | tk.MARKS)
    h, ok = tk.windows(tk.slice_hashes(buf, s, e, tk.LOWER), first, k)
    return h, ok, first


class Index:
    """Sketches of one block of items, by size partition."""

    def __init__(self, items: list[tuple[int, str]], k: int, threshold: float):
        self.k, self.threshold, self.items = k, threshold, items
        data = pa.array([t for _, t in items], pa.string())
        h, ok, first = _hashes(*tk.column(data), k)
        bands: dict[int, list] = {}
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            u = np.unique(h[a:b][ok[a:b]])
            if len(u):
                m = len(u) - needed(len(u), threshold) + 1
                bands.setdefault(len(u).bit_length(), []).append((len(u), i, u[:m]))
        self.bands = []
        for _, rows in sorted(bands.items()):
            keys = np.concatenate([r[2] for r in rows])
            owner = np.repeat(np.array([r[1] for r in rows]), [len(r[2]) for r in rows])
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            bits = np.zeros(1 << 18, bool)
            bits[(keys >> tk.U64(46)).astype(np.int64)] = True
            self.bands.append((min(needed(r[0], threshold) for r in rows), keys, owner, bits))
        self._sets: dict[int, set] = {}

    def item_set(self, i: int) -> set:
        if i not in self._sets:
            self._sets[i] = shingle_set(self.items[i][1], self.k)
        return self._sets[i]

    def search(self, h, ok, first):
        """Pairs of a text's and an item's place that share a sketch value."""
        found = set()
        sizes = np.diff(first)
        for least, keys, owner, bits in self.bands:
            near = np.flatnonzero(ok & bits[(h >> tk.U64(46)).astype(np.int64)])
            at = np.searchsorted(keys, h[near])
            hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == h[near])
            near = near[hit]
            doc = np.searchsorted(first, near, "right") - 1
            large = sizes[doc] - self.k + 1 >= least
            for d, x in set(zip(doc[large].tolist(), h[near[large]].tolist(), strict=True)):
                lo, hi = np.searchsorted(keys, tk.U64(x), "left"), np.searchsorted(keys, tk.U64(x), "right")
                found.update((d, int(i)) for i in owner[lo:hi])
        return sorted(found)


def _load(uri: str, k: int, threshold: float) -> Index:
    with open_file(uri) as f:
        table = pa.ipc.open_file(f).read_all()
    return Index(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), strict=True)), k, threshold)


def contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, words: int = 5, threshold: float = 0.8, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """``(doc_id, item_id, item_shingles, shared, containment)`` of every contained item.

    A null text is empty; an item with fewer than ``words`` words has no
    shingle and is found nowhere, and an empty table on either side gives no
    rows.  Repeated rows of either table each give their hits (an item id is
    reported once for each of its texts).  Rows with a null item_id are kept
    with a null id.  Only ``doc_id``, ``item_id`` and ``text`` are read, so
    further columns may have any names.  The items are a stated query set
    against all documents, in blocks of ``block_items`` that bound the memory
    of a task; more items mean more passes, never fewer comparisons.
    """
    return _hits(spark, docs, benchmark, words, threshold, block_items).drop("mark")


def _hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, words: int, threshold: float, block_items: int) -> DataFrame:
    """What :func:`contaminated` returns, with a hash of the document's text."""
    small_batches(spark)
    uris = _store(benchmark, work_dir(spark, "decontaminate"), block_items)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if not uris:
        return docs.limit(0).mapInArrow(lambda batches: iter(()), HITS)
    passes = [docs.mapInArrow(_scanner(uri, words, threshold), HITS) for uri in uris]
    return reduce(DataFrame.union, passes)


def _mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _scanner(uri: str, words: int, threshold: float):
    """Searches all documents for one block of items, whose index a task builds once."""

    def scan(batches):
        index = _load(uri, words, threshold)
        for batch, buf, off in tk.pieces(batches):
            h, ok, first = _hashes(buf, off, words)
            ids, marks, rows, at, have = batch.column(0), batch.column(1), [], -1, set()
            for d, i in index.search(h, ok, first):
                if d != at:  # pairs come by document
                    at, have = d, shingle_set(buf[off[d] : off[d + 1]].tobytes().decode(), words)
                mine = index.item_set(i)
                shared = len(mine & have)
                if shared >= needed(len(mine), threshold):
                    rows.append((ids[d].as_py(), marks[d].as_py(), index.items[i][0], len(mine), shared, shared / len(mine)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)],
                    [x.split()[0] for x in HITS.split(", ")],
                )

    return scan


def _store(benchmark: DataFrame, folder: str, block: int) -> list[str]:
    """Writes the items in blocks for the executors; the driver holds one block at a time."""
    uris: list[str] = []

    def put(rows: list) -> None:
        table = pa.table({"item_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
        uris.append(f"{folder}/items-{len(uris)}.arrow")

        def write(out):
            with pa.ipc.new_file(out, table.schema) as w:
                w.write_table(table)

        write_file(uris[-1], write)

    rows: list = []
    for r in benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == block:
            put(rows)
            rows = []
    if rows:
        put(rows)
    return uris


def without_contaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, words: int = 5, threshold: float = 0.8, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The rows of ``docs`` in which no item is contained, with all their columns.

    Rows are told apart by id and text: of rows without an id, or with the
    same one, only those with a contaminated text go.
    """
    found = _hits(spark, docs, benchmark, words, threshold, block_items)
    hits = written(found.select(F.col("doc_id").alias("__lexloom_id"), F.col("mark").alias("__lexloom_mark")).distinct(), work_dir(spark, "hits"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__lexloom_id")) & (_mark() == F.col("__lexloom_mark"))
    return docs.join(F.broadcast(hits) if fits(hits, 1_000_000) else hits, same, "left_anti")
