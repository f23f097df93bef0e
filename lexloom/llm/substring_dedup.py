"""Removal of repeated passages by level-wise doubling.

Level 1 looks at windows of half the length: winnowing picks, in every stretch
as long as a whole window, at least one half window, by its hash alone, so
equal stretches pick equal ones.  Half windows that two documents share survive;
only whole windows around them are hashed at level 2.  Whatever repeats there
and starts in a document with a smaller id is removed.  ``repeated_lengths``
goes on doubling until no candidate survives.  Each level is a packed
exchange: a piece of input settles what it knows by itself and sends one entry
a window at most, so a passage that a third of all documents share sends one
entry for each piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import exchange
from lexloom.llm import textkit as tk
from lexloom.llm.store import parts_for, small_batches, work_dir, written

U = np.uint64
#: Bytes of input for each part of an exchange.
PART_BYTES = 4 << 20
SENT = "kind int, part int, doc_id long, mark long, at binary, keys binary, checks binary, docs binary, marks binary, known binary"
NAMES = [x.split()[0] for x in SENT.split(", ")]
KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6)
#: Places on their way to their documents: one row for each sender and part.
PLACES = "part int, docs binary, marks binary, at binary"
#: Bytes of places that may be broadcast, and their rows.
SMALL_BYTES, SMALL_ROWS = 48 << 20, 400_000


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


def _by_doc(ids: np.ndarray, marks: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Places of each document, in order."""
    order = np.lexsort((at, marks, ids))
    ids, marks, at = ids[order], marks[order], at[order].astype(np.uint32)
    cut = np.flatnonzero(exchange.groups(ids, marks))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)], strict=True):
        yield int(ids[a]), int(marks[a]), at[a:b].tobytes()


def anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a picked half window starts, and all half windows' hashes.

    In each run of ``window - half + 1`` half windows, those with the least
    hash are picked (all of them, if several are equal).
    """
    half = window // 2
    run = window - half + 1
    h, _ = tk.windows(words, first, half)
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), h
    end = np.repeat(first[1:], np.diff(first))
    whole = np.arange(n) + window <= end
    least = tk.sliding(h, run, np.minimum)
    least[~whole] = 0
    # the greatest of the minima of all runs that hold a place
    most = tk.sliding(least[::-1], run, np.maximum)[::-1]
    mine = np.flatnonzero((most == h) & (most > 0) & (np.arange(n) + half <= end))
    start = np.repeat(first[:-1], np.diff(first))
    # runs reach back over the start of a text only from the text before, whose last run ends with it
    return mine[mine >= start[mine]], h


def _parcels(ids, marks, at, parts: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Places packed by the part that gathers their documents."""
    out = []
    for part, i in exchange.by_part(tk.mix(ids.view(U)), parts):
        out.append((part, ids[i].tobytes(), marks[i].tobytes(), at[i].astype(np.uint32).tobytes()))
    return out


def _send(keys, checks, ids, marks, at, known, parts) -> list[tuple]:
    return [
        (2, part, None, None, at[i].astype(np.uint32).tobytes(), keys[i].tobytes(), None if checks is None else checks[i].tobytes(), ids[i].tobytes(), marks[i].tobytes(), None if known is None else known[i].tobytes())
        for part, i in exchange.by_part(keys, parts)
    ]


def _found(ids, marks, at, parts) -> list[tuple]:
    return [(1, part, None, None, p, None, None, d, m, None) for part, d, m, p in _parcels(ids, marks, at, parts)]


def _level_one(docs: DataFrame, window: int, parts: int) -> DataFrame:
    """Places of half windows that several documents share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tk.pieces(batches):
            s, e, first = tk.spans(buf, off)
            at, h = anchors(tk.slice_hashes(buf, s, e), first, window)
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            ids, marks = tk.integers(batch, "doc_id")[doc], tk.integers(batch, "mark")[doc]
            k, m, (r, p), shared, goes = exchange.split_known(h[at], ids, marks, at - first[doc])
            rows = _found(m[shared], r[shared], p[shared], parts) if shared.any() else []
            rows += _send(k[goes], None, m[goes], r[goes], p[goes], shared[goes].astype(np.uint8), parts)
            yield _rows(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, (m, r, p, w) = yield from _collected(batches, ("docs", np.int64), ("marks", np.int64), ("at", np.uint32), ("known", np.uint8))
        if len(k):
            k, m, (r, p, w), shared, _ = exchange.split_known(k, m, r, p, w)
            start = np.flatnonzero(exchange.groups(k))
            told = np.repeat(np.maximum.reduceat(w, start) > 0, np.diff(np.append(start, len(k))))
            keep = (shared | told) & (w == 0)
            yield from _places(m[keep], r[keep], p[keep], parts)

    return docs.mapInArrow(run, SENT).repartitionById(parts, F.col("part")).mapInArrow(meet, PLACES)


def _collected(batches, *columns):
    """Passes found places on; returns the keys that were sent and the named columns."""
    held: dict[str, list] = {c: [] for c, _ in columns}
    keys: list = []
    for b in batches:
        kind = tk.integers(b, "kind")
        done = b.filter(pa.array(kind == 1))
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column(NAMES.index(c)) for c in ("part", "docs", "marks", "at")], ["part", "docs", "marks", "at"])
        sent = b.filter(pa.array(kind == 2))
        keys += sent.column(NAMES.index("keys")).to_pylist()
        for c, _ in columns:
            held[c] += sent.column(NAMES.index(c)).to_pylist()
    return exchange.joined(keys, U), [exchange.joined(held[c], t) for c, t in columns]


def _places(ids, marks, at, parts: int) -> Iterator[pa.RecordBatch]:
    rows = _parcels(ids, marks, at, parts)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "docs", "marks", "at"])


def _near(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Whether a word is in ``[a - before, a + after]`` of some place ``a``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(at - before, 0), 1)
    np.add.at(edge, np.minimum(at + after + 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _level(docs: DataFrame, window: int, before: int, after: int, parts: int, larger_only: bool) -> DataFrame:
    """Windows around known places that several documents share.

    With ``larger_only``, a place counts only if a document with a smaller id
    has the window; else if any other document has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tk.pieces(batches):
            s, e, first = tk.spans(buf, off)
            words = tk.slice_hashes(buf, s, e)
            h, ok = tk.windows(words, first, window)
            c, _ = tk.windows(words, first, window, 1)
            for i, lists in enumerate(batch.column(batch.schema.get_field_index("places")).to_pylist()):
                a, b = first[i], first[i + 1]
                ok[a:b] &= _near(exchange.joined(lists, np.uint32).astype(np.int64), before, after, int(b - a))
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            ids, marks = tk.integers(batch, "doc_id")[doc], tk.integers(batch, "mark")[doc]
            k, x, m, r, p, flag, goes, known = _judge(h[at], (c[at] >> U(32)).astype(np.uint32), ids, marks, at - first[doc], np.zeros(len(at), np.uint8), larger_only)
            rows = _found(m[flag], r[flag], p[flag], parts) if flag.any() else []
            back = np.flatnonzero(goes)
            back = back[np.lexsort((p[back], r[back], m[back]))]  # in the order of documents, so that columns compress
            rows += _send(k[back], x[back], m[back], r[back], p[back], known[back].astype(np.uint8), parts)
            yield _rows(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, (x, m, r, p, w) = yield from _collected(batches, ("checks", np.uint32), ("docs", np.int64), ("marks", np.int64), ("at", np.uint32), ("known", np.uint8))
        if len(k):
            k, x, m, r, p, flag, _, _ = _judge(k, x, m, r, p, w, larger_only)
            yield from _places(m[flag], r[flag], p[flag], parts)

    return docs.mapInArrow(run, SENT).repartitionById(parts, F.col("part")).mapInArrow(meet, PLACES)


def _judge(k, x, m, r, p, w, larger_only: bool):
    """Sorts entries by window and document; tells which are repeated, which travel, and which are marked.

    For ``larger_only`` the entries of a window's least document travel: the
    others are repeated whatever comes.  Else one entry travels, marked, where
    two documents share the window here.
    """
    order = np.lexsort((p, m, x, k))
    k, x, m, r, p, w = (a[order] for a in (k, x, m, r, p, w))
    new = exchange.groups(k, x)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(k)))
    least = np.repeat(m[start], size)
    if larger_only:
        flag = m > least
        return k, x, m, r, p, flag, ~flag, np.zeros(len(k), bool)
    shared = np.repeat((m[np.append(start[1:], len(k)) - 1] != m[start]) | (np.maximum.reduceat(w, start) > 0), size)
    return k, x, m, r, p, shared & (w == 0), ~shared | new, shared


def _gathered(places: DataFrame, parts: int, step: int = 1) -> DataFrame:
    """``doc_id, mark, places``, one row for each document.

    With a ``step`` of more than one, of each run of neighbouring places only
    its ends and one in ``step`` are kept: those that together cover its words
    when windows have at least ``step`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        for b in batches:
            for x, c in zip(held, b.columns[1:], strict=True):
                x += c.to_pylist()
        ids, marks, at = (exchange.joined(x, t) for x, t in zip(held, (np.int64, np.int64, np.uint32), strict=True))
        rows = []
        for d, m, p in _by_doc(ids, marks, at) if len(ids) else ():
            p = np.unique(np.frombuffer(p, np.uint32))
            if step > 1:
                inner = np.zeros(len(p), bool)
                inner[1:-1] = (p[1:-1] - p[:-2] == 1) & (p[2:] - p[1:-1] == 1) & (p[1:-1] % step != 0)
                p = p[~inner]
            rows.append((d, m, [p.tobytes()]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.binary())), strict=True)], ["doc_id", "mark", "places"])

    return places.repartitionById(parts, F.col("part")).mapInArrow(run, "doc_id long, mark long, places array<binary>")


def _joined(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    size = places.agg(F.count("*"), F.coalesce(F.sum(F.expr("aggregate(places, 0L, (n, x) -> n + length(x))")), F.lit(0))).first()
    small = size[0] <= SMALL_ROWS and size[1] <= SMALL_BYTES
    return docs.join(F.broadcast(places) if small else places.hint("merge"), ["doc_id", "mark"], how)


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"), own.alias("own"))


def repeated(spark: SparkSession, docs: DataFrame, *, window: int = 50) -> DataFrame:
    """``doc_id, mark, places``: words of each document at which a repeated
    window starts, as far as coverage needs them; a list of binaries of
    unsigned 32-bit integers."""
    small_batches(spark)
    folder, parts = work_dir(spark, "substrings"), parts_for(docs, PART_BYTES)
    rows, half = _prepared(docs), window // 2
    one = written(_gathered(_level_one(rows, window, parts), parts), f"{folder}/half")
    two = _level(_joined(rows, one, "inner"), window, window - half, 0, parts, True)
    return written(_gathered(two, parts, min(16, window)), f"{folder}/whole")


def repeated_lengths(spark: SparkSession, docs: DataFrame, *, window: int = 50) -> DataFrame:
    """``doc_id, mark, length``: for each document, the longest of ``window * 2^i``
    words of which it shares a window with another document."""
    folder, parts = work_dir(spark, "lengths"), parts_for(docs, PART_BYTES)
    rows, half, length = _prepared(docs), window // 2, window
    now = written(_gathered(_level_one(rows, window, parts), parts), f"{folder}/half")
    now = written(_gathered(_level(_joined(rows, now, "inner"), window, window - half, 0, parts, False), parts), f"{folder}/{window}")
    out = now.select("doc_id", "mark", F.lit(length).alias("length"))
    while not now.isEmpty():
        # a repeated window twice as long starts where a repeated one starts
        length *= 2
        now = written(_gathered(_level(_joined(rows, now, "inner"), length, 0, 0, parts, False), parts), f"{folder}/{length}")
        out = out.union(now.select("doc_id", "mark", F.lit(length).alias("length")))
    return out.groupBy("doc_id", "mark").agg(F.max("length").alias("length"))


def removed_words(places: list[bytes], window: int, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    if places:
        out |= _near(exchange.joined(places, np.uint32).astype(np.int64), 0, window - 1, n)
    return out


def without_repeats(spark: SparkSession, docs: DataFrame, *, window: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A window of ``window``
    consecutive words is repeated when its words also start somewhere in a
    document with a smaller doc_id; windows are judged on the input.  All words
    of repeated windows go (``spans`` are their ranges of words); the others
    are joined by one space.  Null, empty and short texts have no window.
    Rows with equal ids are not compared with each other; rows without an id
    come before all others (as -2^63 does) and are not compared with each other
    either.  Two windows are equal when 96 bits of two independent hashes are.
    """
    rows = _prepared(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tk.pieces(batches):
            data, out = buf.tobytes(), []
            for i, places in enumerate(batch.column(batch.schema.get_field_index("places")).to_pylist()):
                words = data[off[i] : off[i + 1]].split()
                if not places:
                    out.append((len(words), 0, [], b" ".join(words)))
                    continue
                gone = removed_words(places, window, len(words))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out.append((len(words), int(gone.sum()), edge.reshape(-1, 2).tolist(), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])))
            n, removed, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("own")), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    places = repeated(spark, docs, window=window)
    return _joined(rows, places, "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept string")
