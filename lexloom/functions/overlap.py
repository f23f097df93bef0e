"""Array kernels that find all pairs of similar sets between two tiles of sets, exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs

#: Places of the table of word frequencies, which orders words and fits on the driver whatever the vocabulary.
PLACES = 1 << 21
#: Slots of the table that holds the words of one set, and what it holds of none.
SLOTS, NONE = 1 << 17, -(1 << 63)
#: Counters, and words that are met, at a time.
CELLS, MEETINGS = 1 << 20, 1 << 21
#: Pairs of sets that a task meets at least, unless there are fewer.
TASK = 1_000_000_000
#: Pairs of a batch.
ROWS = 50_000
#: Share of a set by which its prefix is longer than one common word asks for.
MORE = 0.06


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from ``start`` on, ``n`` for each, one after the other."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def from_rare(rarity: bytes):
    """Rows with the words of ``h`` in the one order that all sets share: by the counts of their places, then as they are."""

    def of(batches):
        table = np.frombuffer(rarity, np.uint8)
        for batch in batches:
            at = batch.schema.get_field_index("h")
            h = batch.column(at)
            offsets = h.offsets.to_numpy()
            flat = h.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            row = np.repeat(np.arange(len(h)), np.diff(offsets))
            flat = flat[np.lexsort((flat, table[flat & (PLACES - 1)], row))]
            columns = batch.columns
            columns[at] = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return of


class Tile:
    """Sets by size, with the words of each from rare to common."""

    def __init__(self, uris: list[str], tile: int, rarity: np.ndarray, threshold: float):
        rows = []
        for uri in uris:
            system, path = fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
            rows.append(ds.dataset(path, filesystem=system, format="parquet").to_table(["k", "h"], filter=ds.field("tile") == tile, use_threads=False))
        rows = pa.concat_tables(rows)
        h = pa.concat_arrays(rows["h"].chunks)
        n = np.diff(h.offsets.to_numpy()).astype(np.int64)
        order = np.argsort(n, kind="stable")
        self.k, self.n, start = pa.concat_arrays(rows["k"].chunks).take(pa.array(order)), n[order], h.offsets.to_numpy()[:-1][order].astype(np.int64)
        self.flat = h.values.to_numpy(zero_copy_only=False)[ranges(start, self.n)]
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.rarity, t, n = rarity, threshold, self.n
        more = (n * MORE).astype(np.int64)
        self.first = np.minimum(n, n - np.ceil(n * (2 * t / (1 + t)) - 1e-9).astype(np.int64) + 1 + more)
        self.second = np.minimum(n, n - np.ceil(n * t - 1e-9).astype(np.int64) + 1 + more)
        self.least = np.maximum(1, np.minimum(1 + more, np.ceil(n * t - 1e-9).astype(np.int64)))
        self.index = None

    def words(self, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first ``n`` words of some rows that any other set can have, and the number of the row of each among them."""
        word, row = self.flat[ranges(self.at[rows], n)], np.repeat(np.arange(len(rows)), n)
        held = self.rarity[word & (PLACES - 1)] > 0  # a word that is alone in its place meets none
        return word[held], row[held]

    def last(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last of the first ``n`` words in the order that all share."""
        word = self.flat[self.at[:-1] + n - 1]
        return self.rarity[word & (PLACES - 1)], word

    def indexed(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows by the places of their second prefix: where those of a place begin, and the rows."""
        if self.index is None:
            word, row = self.words(np.arange(len(self.n)), self.second)
            place = (word & (PLACES - 1)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            begin = np.zeros(PLACES + 1, np.int32)
            np.cumsum(np.bincount(place, minlength=PLACES), out=begin[1:])
            self.index = begin, row[order].astype(np.int32)
        return self.index


def similar(x: Tile, y: Tile, threshold: float, ties: bool):
    """``row of x, row of y, score`` of all pairs with Jaccard of at least ``threshold`` whose first set is the smaller one; of equal ones too if ``ties``.

    With words ordered from rare to common, what two prefixes don't show of an
    overlap can only lie in the rest of the set whose prefix ends first.
    Prefixes are so long that this leaves several words to be shared inside
    them, which sets that aren't similar seldom do.  Shared words are counted
    by place, which never gives too few; pairs that are left compare all words.
    """
    begin, rows = y.indexed()
    (rare_x, last_x), (rare_y, last_y) = x.last(x.first), y.last(y.second)
    most = len(y.n)
    word, row = x.words(np.arange(len(x.n)), x.first)
    place = word & (PLACES - 1)
    start, many = begin[place], begin[place + 1] - begin[place]
    held = many > 0
    start, many, row = start[held], many[held], row[held]
    bounds = np.searchsorted(row, np.arange(len(x.n) + 1))
    step = max(1, CELLS // most)
    for low in range(0, len(x.n), step):
        high = min(low + step, len(x.n))
        if y.n[-1] < x.n[low] or y.n[0] * threshold > x.n[high - 1] + 1e-9:
            continue
        counts = np.zeros((high - low) * most, np.int64)
        a, b = bounds[low], bounds[high]
        cuts = np.append(a + np.flatnonzero(np.diff(np.cumsum(many[a:b]) // MEETINGS, prepend=-1)), b)
        for c, d in zip(cuts[:-1], cuts[1:], strict=True):
            counts += np.bincount(np.repeat((row[c:d] - low) * most, many[c:d]) + rows[ranges(start[c:d], many[c:d])], minlength=len(counts))
        found = np.flatnonzero(counts.reshape(-1, most) >= x.least[low:high, None])
        shared, i, j = counts[found], found // most + low, found % most
        nx, ny = x.n[i], y.n[j]
        held = ((nx < ny) | ((nx == ny) & ((i < j) if x is y else ties))) & (nx >= ny * threshold - 1e-9)
        shared, i, j, nx, ny = shared[held], i[held], j[held], nx[held], ny[held]
        ends = (rare_x[i] < rare_y[j]) | ((rare_x[i] == rare_y[j]) & (last_x[i] <= last_y[j]))
        need = np.ceil((nx + ny) * (threshold / (1 + threshold)) - 1e-9) - np.where(ends, nx - x.first[i], ny - y.second[j])
        held = shared >= need
        yield from compared(x, y, i[held], j[held], threshold)


def compared(x: Tile, y: Tile, i: np.ndarray, j: np.ndarray, threshold: float):
    """Those of the pairs that are similar by all their words; pairs come by the rows of x."""
    table, out, rows = np.full(SLOTS, NONE, np.int64), [], 0
    edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mine = x.flat[x.at[i[a]] : x.at[i[a] + 1]]
        slot = mine & (SLOTS - 1)
        table[slot] = mine
        lost = mine[table[slot] != mine]  # another word of the set has its slot
        step = max(1, MEETINGS // max(1, int(y.n[j[a:b]].max())))
        for c in range(a, b, step):
            to = j[c : min(c + step, b)]
            n = y.n[to]
            word = y.flat[ranges(y.at[to], n)]
            hit = table[word & (SLOTS - 1)] == word
            if len(lost):
                hit |= np.isin(word, lost)
            both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            score = both / (len(mine) + n - both)
            good = score >= threshold
            if good.any():
                out.append((np.full(int(good.sum()), i[a]), to[good], score[good]))
                rows += len(out[-1][0])
            if rows > ROWS:
                yield tuple(map(np.concatenate, zip(*out, strict=True)))
                out, rows = [], 0
        table[slot] = NONE
    if out:
        yield tuple(map(np.concatenate, zip(*out, strict=True)))


def meeting(tasks: list[list[tuple[int, int]]], files: dict[int, list[str]], rarity: bytes, threshold: float):
    """``a, b, score`` of the pairs of tiles of the tasks whose numbers come in."""

    def of(batches):
        table = np.frombuffer(rarity, np.uint8)
        for batch in batches:
            for task in batch.column(0).to_pylist():
                tiles: dict[int, Tile] = {}
                last = {t: at for at, pair in enumerate(tasks[task]) for t in pair}
                for at, (left, right) in enumerate(tasks[task]):
                    tiles = {t: x for t, x in tiles.items() if last[t] >= at}
                    for t in (left, right):
                        tiles[t] = tiles[t] if t in tiles else Tile(files[t], t, table, threshold)
                    x, y = tiles[left], tiles[right]
                    for p, q, ties in ((x, y, True),) if x is y else ((x, y, True), (y, x, False)):
                        for i, j, score in similar(p, q, threshold, ties):
                            yield pa.RecordBatch.from_arrays([p.k.take(pa.array(i)), q.k.take(pa.array(j)), pa.array(score)], ["a", "b", "score"])

    return of
