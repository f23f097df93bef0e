"""Covers of all profiles of a task at once, over duties whose blocks are packed.

A profile has many duties and a duty many blocks, so a row for each profile,
duty and block is never made.  A duty's blocks are packed once (gaps between
sorted ids in as few bytes as the widest needs, two bits of marks each), its
profiles get that as it is, and a task opens what some hundred profiles hold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURATED, HARD = 1, 2
#: Blocks that are opened together, if no profile has more.
ENTRIES = 1 << 20
PACKED = "n int, low long, wide byte, gaps binary, marks binary"


def packed(held: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the packed blocks of each, from ``held(*keys, block_id, mark)`` with a row for each key and block; null blocks leave a key without blocks."""
    both = F.when(F.col("block_id").isNotNull(), F.struct(F.col("block_id").cast("long").alias("b"), F.col("mark").cast("byte").alias("m")))
    lists = held.groupBy(*keys).agg(F.array_sort(F.collect_list(both)).alias("_l")).select(*keys, F.col("_l.b").alias("b"), F.col("_l.m").alias("m"))
    kinds = ", ".join(f"{k} {lists.schema[k].dataType.simpleString()}" for k in keys)
    return lists.mapInArrow(_pack, f"{kinds}, {PACKED}")


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _flat(column: pa.Array) -> np.ndarray:
    """Bytes of a binary column in a row."""
    if not len(column):
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in the row of each entry."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - (np.cumsum(n) - n)[row]


def _pack(batches):
    for batch in batches:
        lists = batch.column("b")
        at = lists.offsets.to_numpy()
        n = np.diff(at).astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64)
        marks = batch.column("m")
        marked = marks.offsets.to_numpy()
        marks = marks.values.to_numpy(zero_copy_only=False)[marked[0] : marked[-1]]
        row, place = _places(n)
        gap = np.diff(ids.view(np.uint64), prepend=np.uint64(0))
        gap[place == 0] = 0
        widest, some = np.zeros(len(n), np.uint64), n > 0
        if len(ids):
            widest[some] = np.maximum.reduceat(gap, (np.cumsum(n) - n)[some])
        wide = (1 << np.searchsorted(np.array([1 << 8, 1 << 16, 1 << 32], np.uint64), widest, side="right")).astype(np.int8)
        data = gap.astype("<u8").view(np.uint8).reshape(-1, 8)[(np.arange(8) < wide[row, None]) & (place > 0)[:, None]]
        size = (n + 3) // 4
        spot = (np.cumsum(size) - size)[row] + place // 4
        bits = np.bincount(spot, weights=marks.astype(np.int64) << (2 * (place % 4)), minlength=int(size.sum())).astype(np.uint8)
        low = np.zeros(len(n), np.int64)
        low[row[place == 0]] = ids[place == 0]
        held = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("b", "m")]
        names = [c for c in batch.schema.names if c not in ("b", "m")]
        columns = [pa.array(n.astype(np.int32)), pa.array(low), pa.array(wide), _binary(data, np.maximum(n - 1, 0) * wide), _binary(bits, size)]
        yield pa.RecordBatch.from_arrays(held + columns, [*names, "n", "low", "wide", "gaps", "marks"])


class Opened:
    """Rows of some whole profiles, their blocks opened: ``row, ids, marks`` of each entry."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        column = lambda c: rows.column(c).combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type)
        of = lambda c, none=0: column(c).fill_null(none).to_numpy(zero_copy_only=False)
        self.profile, self.null = of("profile_id"), column("profile_id").is_null().to_numpy(zero_copy_only=False)
        self.group = _groups(self.profile, self.null)
        self.first = np.flatnonzero(np.diff(self.group, prepend=-1))
        self.n = of("n").astype(np.int64)
        row, place = _places(self.n)
        wide = of("wide", 1)
        gaps = np.zeros((len(row), 8), np.uint8)
        gaps[(np.arange(8) < wide[row, None]) & (place > 0)[:, None]] = _flat(column("gaps"))
        gap = gaps.view("<u8").ravel()
        gap[place == 0] = of("low").view(np.uint64)[row[place == 0]]
        total, start = np.cumsum(gap), (np.cumsum(self.n) - self.n)[row]
        self.row, self.ids = row, (total - (total - gap)[start]).view(np.int64) if len(row) else np.zeros(0, np.int64)
        size = (self.n + 3) // 4
        self.marks = _flat(column("marks"))[(np.cumsum(size) - size)[row] + place // 4] >> (2 * (place % 4)).astype(np.uint8) & 3

    def counted(self, flags: np.ndarray) -> np.ndarray:
        """How many entries of each row are flagged."""
        total = np.concatenate([[0], np.cumsum(flags)])
        end = np.cumsum(self.n)
        return total[end] - total[end - self.n]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each entry's profile and block, in order of appearance; group and block of each number."""
        if not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, group, block = numbered(self.group[self.row], self.ids)
        return q, group, block


def numbered(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    least, most = int(ids.min()), int(ids.max())
    span, code, known = most - least + 1, ids - np.int64(least), None
    if span * (int(group.max()) + 1) >= 1 << 62:
        code, known = pd.factorize(ids)
        least, span = 0, len(known)
    q, found = pd.factorize(group * span + code)
    block = found % span
    return q, found // span, known[block] if known is not None else block + least


def _groups(profile: np.ndarray, null: np.ndarray) -> np.ndarray:
    new = np.ones(len(profile), bool)
    new[1:] = (profile[1:] != profile[:-1]) | (null[1:] != null[:-1])
    return np.cumsum(new) - 1


def whole(batches):
    """Tables of whole profiles from batches that are in their order."""
    held, size, most = [], 0, ENTRIES
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += int(np.sum(batch.column("n").fill_null(0).to_numpy(zero_copy_only=False))) + batch.num_rows
        if size < most:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        p = rows.column("profile_id").combine_chunks()
        group = _groups(p.fill_null(0).to_numpy(zero_copy_only=False), p.is_null().to_numpy(zero_copy_only=False))
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield rows.slice(0, cut)
            held, most = rows.slice(cut).to_batches(), ENTRIES
            size = int(np.sum(rows.column("n").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[cut:])) + rows.num_rows - cut
        else:
            held = rows.to_batches()
        most = max(most, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Cover:
    """Greedy covers as :func:`lexloom.operators.compose.minimise` has them, a round for all profiles at once.

    ``order`` is the round of a selected pair (0 for required ones, -1 for
    those that aren't chosen), ``place`` the first entry of each pair.
    """

    def __init__(self, o: Opened):
        self.o = o
        self.q, self.group, self.block = o.pairs()
        pairs = len(self.group)
        hard, curated = np.zeros(pairs, bool), np.zeros(pairs, bool)
        hard[self.q[o.marks & HARD > 0]] = True
        curated[self.q[o.marks & CURATED > 0]] = True
        self.hard = hard
        self.order = np.where(hard, 0, -1)
        hits = o.marks & HARD > 0
        self.place = np.full(pairs, len(o.ids))
        np.minimum.at(self.place, self.q[hits], np.flatnonzero(hits))
        open_ = (o.counted(hard[self.q]) == 0) & (o.n > 0)
        left = open_[o.row]
        row, q = o.row[left], self.q[left]
        last = 0
        if len(q):
            # pairs that open duties have, in the order in which a tie goes: profile, curated, least id
            mine = np.unique(q)
            mine = mine[np.lexsort((self.block[mine], ~curated[mine], self.group[mine]))]
            rank = np.empty(pairs, np.int64)
            rank[mine] = np.arange(len(mine))
            x, group = rank[q], self.group[mine]
            gain = np.bincount(x, minlength=len(mine))
            while len(x):
                last += 1
                start = np.flatnonzero(np.diff(group, prepend=-1))
                score = gain * (len(mine) + 1) + np.arange(len(mine), 0, -1)
                best = np.maximum.reduceat(score, start)
                picked = len(mine) - best % (len(mine) + 1)
                self.order[mine[picked]] = last
                taken = np.zeros(len(mine), bool)
                taken[picked] = True
                met = np.zeros(len(o.n), bool)
                met[row[taken[x]]] = True
                gone = met[row]
                gain = gain - np.bincount(x[gone], minlength=len(mine))
                row, x = row[~gone], x[~gone]
                some = gain > 0
                at = np.cumsum(some) - 1
                x, mine, group, gain = at[x], mine[some], group[some], gain[some]
        self._prune(last)

    def _prune(self, last: int) -> None:
        """Selected pairs whose duties others satisfy too go, the last of each profile first."""
        o = self.o
        times = o.counted(self.order[self.q] >= 0)
        mine = np.flatnonzero(self.order[self.q] > 0)
        mine = mine[np.argsort(self.order[self.q[mine]], kind="stable")]
        turn = self.order[self.q[mine]]
        for k in range(last, 0, -1):
            entries = mine[np.searchsorted(turn, k) : np.searchsorted(turn, k, side="right")]
            bears = np.unique(self.q[entries[times[o.row[entries]] < 2]])
            goes = entries[~np.isin(self.q[entries], bears)]
            np.subtract.at(times, o.row[goes], 1)
            self.order[self.q[goes]] = -1

    def picks(self) -> pa.RecordBatch:
        """``profile_id, block_id, position, basis``: required ones in the order of duty and block, then the selected."""
        chosen = np.flatnonzero(self.order >= 0)
        chosen = chosen[np.lexsort((self.place[chosen], self.order[chosen], self.group[chosen]))]
        group = self.group[chosen]
        position = np.arange(len(chosen)) - np.searchsorted(group, group) + 1
        basis = pa.array(["selected", "required"]).take(pa.array(self.hard[chosen].astype(np.int8)))
        return pa.RecordBatch.from_arrays([named(self.o, group), pa.array(self.block[chosen]), pa.array(position.astype(np.int32)), basis], ["profile_id", "block_id", "position", "basis"])

    def judged(self) -> pa.RecordBatch:
        """``profile_id, duties, all_covered, redundant``, from the picks alone and not from how they were found."""
        o, chosen = self.o, self.order >= 0
        times = o.counted(chosen[self.q])
        covered = np.minimum.reduceat(times, o.first) > 0
        bears = np.zeros(len(chosen), bool)
        bears[self.q[times[o.row] == 1]] = True
        idle = np.bincount(self.group[chosen & ~self.hard & ~bears], minlength=len(o.first))
        duties = np.diff(np.append(o.first, len(o.n)))
        return pa.RecordBatch.from_arrays([named(o, np.arange(len(o.first))), pa.array(duties.astype(np.int64)), pa.array(covered), pa.array(idle.astype(np.int64))], ["profile_id", "duties", "all_covered", "redundant"])


def named(o: Opened, group: np.ndarray) -> pa.Array:
    """Ids of profiles by their number."""
    at = o.first[group]
    return pa.array(o.profile[at].astype(np.int64), mask=o.null[at])


def _picks(batches):
    for rows in whole(batches):
        yield Cover(Opened(rows)).picks()


def _judged(batches):
    for rows in whole(batches):
        yield Cover(Opened(rows)).judged()


def _hashed(batches):
    for rows in whole(batches):
        o = Opened(rows)
        _, group, block = o.pairs()
        ids, code = np.unique(block, return_inverse=True)
        told = np.array([str(b) for b in ids.tolist()], object)
        by_name = np.argsort(told) if len(ids) else np.zeros(0, np.int64)
        rank = np.empty(len(ids), np.int64)
        rank[by_name] = np.arange(len(ids))
        rank, told = rank[code], told[by_name]
        held = np.lexsort((rank, group))
        ends = np.searchsorted(group[held], np.arange(len(o.first) + 1))
        names = told[rank[held]].tolist()
        hashes = [hashlib.sha256(",".join(names[a:b]).encode()).hexdigest() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([named(o, np.arange(len(o.first))), pa.array(np.diff(ends).astype(np.int64)), pa.array(hashes)], ["profile_id", "blocks", "composition_hash"])


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("profile_id").sortWithinPartitions("profile_id", "obligation_id")


def picks(rows: DataFrame) -> DataFrame:
    """``profile_id, block_id, position, basis`` of the packed ``rows(profile_id, obligation_id, ...)``, which have each duty of a profile once."""
    return _gathered(rows).mapInArrow(_picks, "profile_id long, block_id long, position int, basis string")


def judged(rows: DataFrame) -> DataFrame:
    """``profile_id, duties, all_covered, redundant`` of the same picks."""
    return _gathered(rows).mapInArrow(_judged, "profile_id long, duties long, all_covered boolean, redundant long")


def hashed(rows: DataFrame) -> DataFrame:
    """``profile_id, blocks, composition_hash`` of all blocks that a profile's duties have."""
    return _gathered(rows).mapInArrow(_hashed, "profile_id long, blocks long, composition_hash string")


def _problems(batches):
    """A row without a duty but with ``item`` is a picked block; others are duties with their packed blocks."""
    for rows in whole(batches):
        o = Opened(rows)
        item = rows.column("item").combine_chunks()
        picked = rows.column("picked").combine_chunks().to_numpy(zero_copy_only=False)
        entries, listed = len(o.ids), np.flatnonzero(picked)
        unknown = item.is_null().to_numpy(zero_copy_only=False)[listed]
        block = item.fill_null(0).to_numpy(zero_copy_only=False)[listed]
        q, group = np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.zeros(0, np.int64)
        if entries + len(listed):
            q, group, known = numbered(np.concatenate([o.group[o.row], o.group[listed]]), np.concatenate([o.ids, block]))
        # nothing is equal to a null: such profiles and items meet none
        meets = ~o.null
        chosen, asked, hard = (np.zeros(len(group), bool) for _ in range(3))
        chosen[q[entries:][meets[listed] & ~unknown]] = True
        asked[q[:entries][meets[o.row]]] = True
        hard[q[:entries][o.marks & HARD > 0]] = True
        stray = np.flatnonzero(unknown | ~asked[q[entries:]])
        missing = np.flatnonzero(hard & ~chosen)
        duty = ~picked
        bare = np.flatnonzero(duty & (o.counted(chosen[q[:entries]]) == 0))
        dead = np.flatnonzero(duty & ~rows.column("live").combine_chunks().to_numpy(zero_copy_only=False))
        obligation = rows.column("obligation_id").combine_chunks()
        parts = [
            ("item without duty", o.group[listed[stray]], pa.array(block[stray].astype(np.int64), mask=unknown[stray])), ("duty without item", o.group[bare], obligation.take(pa.array(bare))),
            ("required not picked", group[missing], pa.array(known[missing].astype(np.int64))), ("duty not live", o.group[dead], obligation.take(pa.array(dead))),
        ]
        for problem, at, ref in parts:
            yield pa.RecordBatch.from_arrays([named(o, at), pa.array([problem] * len(at), pa.string()), ref.cast(pa.int64())], ["profile_id", "problem", "ref"])


def problems(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """As :func:`lexloom.operators.blueprint.problems`, from packed ``rows(profile_id, obligation_id, live, ...)`` and distinct ``chosen(profile_id, block_id)``."""
    none = lambda kind: F.lit(None).cast(kind)
    duties = rows.select("profile_id", "obligation_id", "live", F.lit(False).alias("picked"), none("long").alias("item"), *[F.coalesce(c, F.lit(0).cast("int")).alias("n") if c == "n" else _filled(c, k) for c, k in (x.split() for x in PACKED.split(", "))])
    items = chosen.select(F.col("profile_id").cast("long").alias("profile_id"), none("long").alias("obligation_id"), F.lit(True).alias("live"), F.lit(True).alias("picked"), F.col("block_id").cast("long").alias("item"), F.lit(0).alias("n"), *[_filled(c, k, True) for c, k in (x.split() for x in PACKED.split(", ")[1:])])
    return _gathered(duties.union(items)).mapInArrow(_problems, "profile_id long, problem string, ref long")


def _filled(c: str, kind: str, empty: bool = False) -> Column:
    none = F.lit(b"") if kind == "binary" else F.lit(1 if c == "wide" else 0).cast(kind)
    return (none if empty else F.coalesce(F.col(c), none)).alias(c)
