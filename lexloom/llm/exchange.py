"""Finding keys that several members share, with one packed shuffle.

Keys (64-bit hashes) by the tens of millions are costly as rows.  Mappers
instead deal them to ``parts`` by key and send, for each piece of input and
part, one row whose binary columns hold the sorted keys and what belongs to
them.  Before that, a piece settles what it can by itself: a key that two
members share inside the piece is known to be shared, so its entries are
passed on as found and only one of them travels, marked, to tell the other
pieces.  A key that a third of all rows have thus sends one entry for each
piece, not one for each row.
"""

from __future__ import annotations

import numpy as np


def deal(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def groups(*columns: np.ndarray) -> np.ndarray:
    """Whether a new group starts at each place of sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def split_known(keys: np.ndarray, members: np.ndarray, *others: np.ndarray):
    """Sorts entries by key and member and tells which keys several members share.

    Returns the sorted columns, whether each entry's key is shared here, and
    whether the entry is the one that travels (all entries of keys that are
    not shared do).
    """
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    others = tuple(o[order] for o in others)
    new = groups(keys)
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.append(start[1:], len(keys)) - 1
    shared = (members[last] != members[start])[group] if len(keys) else new
    return keys, members, others, shared, ~shared | new


def by_part(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """For each part that gets entries, their places in order."""
    if not len(keys):
        return []
    part = deal(keys, parts)
    order = np.argsort(part, kind="stable")
    sorted_ = part[order]
    cut = np.flatnonzero(groups(sorted_))
    return [(int(sorted_[a]), order[a:b]) for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True)]


def joined(values: list, kind) -> np.ndarray:
    """One array from the binary values of a column."""
    return np.frombuffer(b"".join(values), kind)
