"""Exact Jaccard self-join of shingle sets by partitioning their universe.

Sets are handled in size bands.  If ``J(X, Y) >= t`` then ``|Y| >= t |X|`` and
the symmetric difference has at most ``H = (1-t)/(1+t) (|X|+|Y|)`` shingles.
For each band the hash space is cut into ``m`` equal segments, and segment i
is given ``v_i`` of 0 or 1 deletions so that the sum of ``v_i + 1`` is
``H + K + 1``: by the pigeonhole principle the segments that differ in at most
``v_i`` shingles then weigh at least ``K + 1``.  A set is indexed by what each
of its segments holds (a sum of hashes, one key) and, where ``v_i`` is 1, also
by the segment without each single shingle; two linked sets share keys.  A key
of an empty segment tells nothing and would gather a share of all sets.  The
spare weight K pays for leaving such keys out: a set whose segments that could
give one weigh at most K has no need of them, since a linked set's key that
one of the two lacks is such a segment of both.  A set in which they weigh
more has them all.  The allocation is the one of least cost for the band,
counting keys and how often empty ones are needed.

Keys are met in a packed exchange; buckets that hold the same members are
reduced to one.  Within a bucket not all pairs are formed: members are compared
with a pivot; those of one component need no comparison; each round has four
times as many pivots, until every bucket lies in one component or every member
has been a pivot.  Large buckets are dealt in slots, each with all pivots.
Texts that are alike but not linked share many buckets, none of which closes:
after the first round such buckets are united where that makes no more pairs,
or compared only from the members that a larger bucket lacks (``_united``).
Pairs that sizes or bitmaps rule out go: bit i of a set's bitmap is the parity
of its shingles that hash to i, so the bits in which two bitmaps differ are no
more than the shingles in which the sets do.  Pairs that are left meet wider
bitmaps, whose length follows the set's, and only then the texts: a pivot's
text travels once for each slot of its partners, and a link counts only if the
shingles agree as words.  No bucket, member or partner is ever dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import exchange
from lexloom.llm import textkit as tk
from lexloom.llm.graph import components
from lexloom.llm.store import discard, fits, parts_for, sized_join, small_batches, work_dir, written

U = np.uint64
SALT = (U(0x2545F4914F6CDD1D), U(0xDA942042E4DD58B5), U(0x8CB92BA72F3D8DD7))
#: A band's largest size over its smallest.
BAND = Fraction(3, 2)
#: Rows of ids, and of ids with bitmaps, that may be broadcast.
SMALL, SMALL_BITS = 1_000_000, 100_000
#: Pairs, with a bitmap each at most, that may be broadcast.
FEW = 50_000
#: Bytes of input for each part of the exchange.
PART_BYTES = 4 << 20
#: Members of a bucket in one slot, and partners of one text.
SLOT = 4096
PARTNERS = 512


def _ratio(threshold: float) -> Fraction:
    return Fraction(str(threshold))


@lru_cache(8)
def bands(threshold: float, largest: int) -> list[int]:
    """First sizes of the bands, up to the one that has ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND)))
    return edges


#: What a key of an empty segment costs, in other keys.
EMPTY_COST = 2000.0


@lru_cache(4096)
def allocation(threshold: float, low: int, high: int) -> tuple[int, int, int]:
    """Segments with one deletion, segments with none, and the spare weight, for smaller sets of ``low..high`` shingles.

    ``2 q + r = H + K + 1``.  A segment without deletion costs a key; one with
    a deletion saves a segment but costs a key for each shingle in it.  The
    weight of segments that could give an empty key is taken as a Poisson
    variable, with the mean that the band's smallest sets have.
    """
    t = _ratio(threshold)
    h = int((1 - t) / (1 + t) * (high + int(high / t)))
    best = None
    for k in sorted({int(x) for x in np.geomspace(1, 24 + h // 4, 24)} | {0, 2, 3}):
        total = h + 1 + k
        q = np.unique(np.linspace(0, total // 2, 33).astype(np.int64))
        m = total - q
        none, one = (1 - 1 / m) ** low, low / m * (1 - 1 / m) ** max(0, low - 1)
        mean = (m - q) * none + 2 * q * (none + one)
        i = np.arange(k + 1)
        within = np.exp(i[:, None] * np.log(np.maximum(mean, 1e-12)) - mean - np.cumsum(np.log(np.maximum(i, 1)))[:, None]).sum(0)
        cost = (m - q) + q * (1 + (low + high) / 2 / m) + EMPTY_COST * mean * np.maximum(1 - within, 0)
        at = int(np.argmin(cost))
        if best is None or cost[at] < best[0]:
            best = (float(cost[at]), int(q[at]), int(total - 2 * q[at]), k)
    return best[1:]


@lru_cache(65536)
def cells(n: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """Where a set of ``n`` shingles is indexed: ``(band, q, r, K)`` of its own
    band, and of those below in which a set can be similar to it."""
    edges = bands(threshold, n)
    own = len(edges) - 2
    out = [(own, *allocation(threshold, edges[own], edges[own + 1] - 1))]
    below = own - 1
    while below >= 0 and _ratio(threshold) * n <= edges[below + 1] - 1:
        out.append((below, *allocation(threshold, edges[below], edges[below + 1] - 1)))
        below -= 1
    return out


def set_keys(u: np.ndarray, threshold: float, spread: np.ndarray) -> np.ndarray:
    """Keys of one sorted set; ``spread`` are its shingles' second hashes."""
    total = np.zeros(len(u) + 1, U)
    np.cumsum(spread, out=total[1:])
    out = []
    for band, q, r, k in cells(len(u), threshold):
        m = q + r
        edges = (np.arange(1, m, dtype=np.float64) / m * 2.0**64).astype(U)
        cut = np.concatenate([[0], np.searchsorted(u, edges), [len(u)]])
        sums, size = total[cut[1:]] - total[cut[:-1]], np.diff(cut)
        salt = tk.mix(np.arange(m, dtype=U) + U(band << 32) + SALT[2])
        # the first q segments have a deletion
        bare = 2 * int((size[:q] <= 1).sum()) + int((size[q:] == 0).sum()) > k
        whole = tk.mix(sums ^ salt)
        out.append(whole if bare else whole[size > 0])
        if q:
            inside = int(cut[q])
            segment = np.repeat(np.arange(q), size[:q])
            less = tk.mix((sums[segment] - spread[:inside]) ^ salt[segment])
            out.append(less if bare else less[size[segment] > 1])
    return np.concatenate(out)


def _spread(u: np.ndarray, salt: int) -> np.ndarray:
    """Second hashes of shingles; another ``salt`` gives others."""
    return tk.mix(u ^ U((int(SALT[0]) + salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1))


def _digests(u: np.ndarray, spread: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = tk.mix(spread.sum(dtype=U).reshape(1) + U(len(u)) * SALT[0])[0]
        b = tk.mix(tk.mix(u + SALT[1]).sum(dtype=U).reshape(1))[0]
    return int(a.view(np.int64)), int(b.view(np.int64))


#: Longs in a bitmap.
WORDS = 8


def bitmap(spread: np.ndarray) -> np.ndarray:
    """Parities of the shingles that hash to each of ``64 * WORDS`` bits."""
    bits = np.bincount((spread & U(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_bitmap(spread: np.ndarray) -> np.ndarray:
    """A bitmap of four to eight bits for each shingle, a power of two of longs."""
    longs = 1 << max(0, (len(spread) - 1) // 16).bit_length()
    bits = np.bincount((spread & U(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


SHARED = "kind int, part int, doc_id long, mark long, n int, member long, digest long, bits array<long>, wide array<long>, keys binary, members binary, known binary"
KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
SHARED_NAMES = [x.split()[0] for x in SHARED.split(", ")]


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    """A column of longs; a set that a piece has met before has none."""
    sizes = [0 if v is None else len(v) for v in values]
    flat = [v for v in values if v is not None]
    out = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(flat) if flat else np.zeros(0, np.int64))
    return pa.ListArray.from_arrays(out.offsets, out.values, mask=pa.array([v is None for v in values]))


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, t) for x, t in zip(SHARED_NAMES, KINDS, strict=True)], SHARED_NAMES)


def _mapped(docs: DataFrame, words: int, threshold: float, parts: int, salt: int) -> DataFrame:
    """A row for each document (kind 0), found entries (kind 1), and entries for each part (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tk.pieces(batches, size=tk.BLOCK):
            sizes, first, second, maps, wide, keys, owner = [], [], [], [], [], [], []
            seen = set()
            for u in tk.shingle_sets(buf, off, words):
                spread = _spread(u, salt)
                a, b = _digests(u, spread) if len(u) else (0, 0)
                sizes.append(len(u))
                first.append(a)
                second.append(b)
                fresh = len(u) and a not in seen  # equal sets have equal keys
                maps.append(bitmap(spread) if fresh else None)
                wide.append(wide_bitmap(spread) if fresh else None)
                if fresh:
                    seen.add(a)
                    k = set_keys(u, threshold, spread)
                    keys.append(k)
                    owner.append(np.full(len(k), a, np.int64))
            marks = batch.column(batch.schema.get_field_index("mark"))
            here = tk.mix(marks.to_numpy().view(U))
            yield _batch({
                "kind": pa.array(np.zeros(len(sizes), np.int32)), "part": pa.array((here % U(parts)).astype(np.int32)), "doc_id": batch.column(batch.schema.get_field_index("doc_id")),
                "mark": marks, "n": pa.array(sizes, pa.int32()), "member": pa.array(first, pa.int64()), "digest": pa.array(second, pa.int64()), "bits": _lists(maps), "wide": _lists(wide),
            }, len(sizes))
            if not keys:
                continue
            k, m, _, shared, goes = exchange.split_known(np.concatenate(keys), np.concatenate(owner))
            once = exchange.groups(k, m)
            shared, goes = shared & once, goes & once
            rows = [(1, int(here[0] % U(parts)), k[shared].tobytes(), m[shared].tobytes(), None)] if shared.any() else []
            known = shared[goes].astype(np.uint8)
            k, m = k[goes], m[goes]
            rows += [(2, part, k[at].tobytes(), m[at].tobytes(), known[at].tobytes()) for part, at in exchange.by_part(k, parts)]
            kind, part, *packed = zip(*rows, strict=True)
            yield _batch({"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int32())} | {x: pa.array(c, pa.binary()) for x, c in zip(("keys", "members", "known"), packed, strict=True)}, len(rows))

    return docs.mapInArrow(run, SHARED)


FOUND = "doc_id long, mark long, n int, member long, digest long, bits array<long>, wide array<long>, bucket long"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _entries(k: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(k), 50_000):
        a, b = k[i : i + 50_000].view(np.int64), m[i : i + 50_000]
        have = {"member": pa.array(b), "bucket": pa.array(a)}
        kinds = dict(zip(SHARED_NAMES, KINDS, strict=True))
        yield pa.RecordBatch.from_arrays([have[x] if x in have else pa.nulls(len(a), kinds[x]) for x in FOUND_NAMES], FOUND_NAMES)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one part meet; passes documents and what was found before on."""
    keys, members, known = [], [], []
    for b in batches:
        kind = tk.integers(b, "kind")
        if (kind == 0).any():
            d = b.filter(pa.array(kind == 0))
            yield pa.RecordBatch.from_arrays([*d.columns[2:9], pa.nulls(d.num_rows, pa.int64())], FOUND_NAMES)
        found = b.filter(pa.array(kind == 1))
        yield from _entries(exchange.joined(found.column(9).to_pylist(), U), exchange.joined(found.column(10).to_pylist(), np.int64))
        sent = b.filter(pa.array(kind == 2))
        keys += sent.column(9).to_pylist()
        members += sent.column(10).to_pylist()
        known += sent.column(11).to_pylist()
    if keys:
        k, m, (w,), shared, _ = exchange.split_known(exchange.joined(keys, U), exchange.joined(members, np.int64), exchange.joined(known, np.uint8))
        start = np.flatnonzero(exchange.groups(k))
        told = np.repeat(np.maximum.reduceat(w, start) > 0, np.diff(np.append(start, len(k))))
        # an entry that was known has been passed on where it was found
        keep = (shared | told) & (w == 0) & exchange.groups(k, m, w)
        yield from _entries(k[keep], m[keep])


def _texts(docs: DataFrame, first: DataFrame, words: int, salt: int) -> DataFrame:
    """``member, text``: a text of each member, once for each time that its row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tk.pieces(batches, size=tk.BLOCK):
            member = [_digests(u, _spread(u, salt))[0] if len(u) else 0 for u in tk.shingle_sets(buf, off, words)]
            yield pa.RecordBatch.from_arrays([pa.array(member, pa.int64()), batch.column(0)], ["member", "text"])

    wanted = first.select(F.col("at.doc_id").alias("at_id"), F.col("at.mark").alias("at_mark"))
    texts = sized_join(docs, wanted, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("mark") == F.col("at_mark")), "left_semi", SMALL).select("text")
    return sized_join(texts.mapInArrow(run, "member long, text string"), first.select("member"), "member", "left_semi", SMALL)


def _shingles(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    w = text.lower().split()  # bytes: folds A-Z only and splits at ASCII white space
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough: ``100 * |X and Y| >= 100 t * |X or Y|``, exactly.

    A text comes once for each slot of its partners, before them.  Hashes rule
    pairs out; what they let through is compared as words.
    """
    top, base = _ratio(threshold).as_integer_ratio()

    def alike(x, y) -> bool:
        both = len(x & y) if isinstance(x, set) else int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
        return base * both >= top * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine, exact = None, None, None
        for batch, buf, off in tk.pieces(batches, size=tk.BLOCK):
            a, b, out = tk.integers(batch, "a"), batch.column(batch.schema.get_field_index("b")).to_pylist(), []
            for i, u in enumerate(tk.shingle_sets(buf, off, words)):
                if b[i] is None:
                    head, mine, exact = buf[off[i] : off[i + 1]].tobytes(), u, None
                elif alike(mine, u):
                    exact = exact or _shingles(head, words)
                    if alike(exact, _shingles(buf[off[i] : off[i + 1]].tobytes(), words)):
                        out.append((a[i], b[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    few = fits(pairs, FEW)
    few_of = F.broadcast if few else lambda x: x
    hot = pairs.groupBy("a").agg(F.count("*").alias("size")).where(F.col("size") > PARTNERS).select("a", F.ceil(F.col("size") / PARTNERS).alias("slots"))
    dealt = sized_join(pairs, hot, "a", "left", SMALL).select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("slots")), F.lit(0)).alias("slot"))
    heads = texts.withColumnRenamed("member", "a").join(few_of(dealt.select("a", "slot").distinct()), "a").select("a", "slot", F.lit(None).cast("long").alias("b"), "text")
    tails = texts.withColumnRenamed("member", "b").join(few_of(dealt), "b").select("a", "slot", "b", "text")
    streamed = heads.union(tails).repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return streamed.select("a", "b", "text").mapInArrow(run, "a long, b long")


def _classes(spark: SparkSession, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """``doc_id, mark, n, root`` of every row; ``root`` names the component, and is null for those without words."""
    small_batches(spark)
    folder = work_dir(spark, "ngram-join")
    parts = parts_for(docs, PART_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(F.col("text")).alias("mark"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for salt in count():  # until no two sets share a digest: once, but for chance
        met = written(_mapped(rows, words, threshold, parts, salt).repartitionById(parts, F.col("part")).mapInArrow(_met, FOUND), f"{folder}/met-{salt}")
        doc = met.where("bucket is null").drop("bucket")
        if doc.where("n > 0").groupBy("member").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").isEmpty():
            break
    root = _linked(rows, doc, met.where("bucket is not null").select("bucket", "member"), folder, words, threshold, salt)
    # copies of one text by the thousand: the rows that read the result can be split
    return doc.join(F.broadcast(root) if fits(root, SMALL) else root, "member", "left").select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("root", "member")).alias("root"))


def _mark(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def classes(spark: SparkSession, docs: DataFrame, *, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set has the
    distinct runs of ``words`` words; a text with fewer words has its whole
    sequence as one; null, empty and blank texts have none and are linked with
    nothing.  Two documents link when their Jaccard similarity is at least
    ``threshold`` (compared as an exact fraction).  ``component_id`` is the
    smallest doc_id that links reach.  Rows that repeat an id are rows of
    their own (they agree if their texts do; an id with several texts joins
    their components through each text, not through the id).  Rows without an
    id take part; their component's id is that of the others, or null.  Two
    sets are the same when 128 bits of hash are.
    """
    found = written(_classes(spark, docs, words, threshold), f"{work_dir(spark, 'classes')}/rows")
    # combined before the shuffle
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size"))
    several = written(least.where("size > 1").drop("size"), f"{work_dir(spark, 'classes')}/least")
    out = found.join(F.broadcast(several) if fits(several, SMALL) else several, "root", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _possible(threshold: float) -> Column:
    """Whether sizes and bitmaps of a member (``n, bits``) and its pivot (``pivot_n, pivot_bits``) allow a link."""
    top, base = _ratio(threshold).as_integer_ratio()
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("pivot_bits")[i])) for i in range(WORDS)), F.lit(0))
    n, m = F.col("n"), F.col("pivot_n")
    return (n * top <= m * base) & (m * top <= n * base) & (apart * (base + top) <= (n + m) * (base - top))


def _near(pairs: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """Pairs that their wide bitmaps allow; the longer of two is folded onto the shorter."""
    top, base = _ratio(threshold).as_integer_ratio()
    side = lambda m: first.select(F.col("member").alias(m), F.col("n").alias(f"n_{m}"), F.col("wide").alias(f"w_{m}"))
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda w: F.zip_with(F.slice(w, F.lit(1), (F.size(w) / 2).cast("int")), F.slice(w, (F.size(w) / 2 + 1).cast("int"), (F.size(w) / 2).cast("int")), xor)
    x, y = F.col("w_a"), F.col("w_b")
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(x, y, xor), F.lit(0), lambda n, z: n + F.bit_count(z))
    both = sized_join(side("b"), sized_join(side("a"), pairs, "a", "inner", FEW), "b", "inner", FEW)
    # sets more than twice as large as others are folded once only: such a pair is left to the verification
    folded = F.size("w_a") * 2 < F.size("w_b")
    folded = folded | (F.size("w_b") * 2 < F.size("w_a"))
    return both.where(folded | (apart * (base + top) <= (F.col("n_a") + F.col("n_b")) * (base - top))).select("a", "b")


def _slots(bucket_slots: DataFrame) -> DataFrame:
    """One row for each slot of each bucket."""
    return bucket_slots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))


def _distinct_buckets(entries: DataFrame, folder: str) -> DataFrame:
    """``bucket, slot, slots, member``; of buckets with the same members one stays.

    Buckets are told apart by their size and two sums modulo two of the
    members' hashes.  Buckets of more than ``SLOT`` members lie in slots.
    """
    entries = written(entries.distinct(), f"{folder}/entries")
    about = written(
        entries.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("member")).alias("x"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("y")).where("size > 1"), f"{folder}/about",
    )
    slots = F.ceil(F.col("size") / SLOT)
    kept = about.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", slots.alias("slots"))
    hot = about.where(F.col("size") > SLOT).select("bucket", slots.alias("parts"))
    dealt = sized_join(entries, hot, "bucket", "left", SMALL).select("bucket", "member", F.coalesce(F.pmod(F.xxhash64("member"), F.col("parts")), F.lit(0)).alias("slot"))
    return written(dealt.join(_slots(kept), ["bucket", "slot"]).select("bucket", "slot", "slots", "member"), f"{folder}/buckets")


def _united(active: DataFrame, folder: str) -> DataFrame:
    """``bucket, slot, slots, member, root, outside`` of buckets that overlap less; every pair that met before still meets.

    A member's home is its largest bucket, and a bucket's host the home that
    most of its members have, if it is its own host and they are half of the
    bucket at least.  A host takes in all its buckets if that makes no more
    pairs than it and they have.  Else they stay: their members of that home
    meet one another in the host, so only the others, ``outside``, need to be
    pivots, and as all of them are at once, the bucket is then done with.
    ``outside`` is null in buckets without a host.
    """
    sizes = written(active.groupBy("bucket").agg(F.count("*").alias("size")), f"{folder}/sizes")
    sized = sized_join(active.select("bucket", "member"), sizes, "bucket", "inner", SMALL)
    homes = written(sized.groupBy("member").agg(F.max(F.struct("size", "bucket")).alias("most")).select("member", F.col("most.bucket").alias("home")), f"{folder}/homes")
    votes = sized_join(sized, homes, "member", "inner", SMALL).groupBy("bucket", "size", "home").agg(F.count("*").alias("votes"))
    hosts = votes.groupBy("bucket", "size").agg(F.max(F.struct("votes", "home")).alias("most"))
    hosts = written(hosts.select("bucket", "size", F.col("most.home").alias("host"), F.col("most.votes").alias("votes")), f"{folder}/hosts")
    own = hosts.where("host = bucket").select("host", F.col("size").alias("own"))
    hosted = written(sized_join(hosts.where("host <> bucket and votes * 2 >= size"), own, "host", "inner", SMALL).select("bucket", "host", "size", "own"), f"{folder}/hosted")
    members = active.select("bucket", "member", "root")
    # what a host would have, against what it and its buckets have
    taken = sized_join(members.drop("root"), hosted.select("bucket", "host").union(hosted.select("host", "host").distinct()), "bucket", "inner", SMALL)
    whole = taken.select("host", "member").distinct().groupBy("host").agg(F.count("*").cast("double").alias("whole"))
    apart = hosted.groupBy("host").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("apart"), F.max(F.col("own").cast("double")).alias("own"))
    good = written(whole.join(apart, "host").where("whole * whole <= apart + own * own").select("host"), f"{folder}/good")
    into = written(sized_join(hosted.select("bucket", "host"), good, "host", "left_semi", SMALL), f"{folder}/into")
    left = written(sized_join(hosted.select("bucket", "host"), good, "host", "left_anti", SMALL), f"{folder}/left")
    united = written(sized_join(members, into, "bucket", "left", SMALL).select(F.coalesce("host", "bucket").alias("bucket"), "member", "root").distinct(), f"{folder}/united")
    homes = sized_join(homes, into.select(F.col("bucket").alias("home"), "host"), "home", "left", SMALL).select("member", F.coalesce("host", "home").alias("home"))
    homes = written(homes, f"{folder}/homes-united")
    hot = written(united.groupBy("bucket").agg(F.ceil(F.count("*") / SLOT).alias("slots")).where("slots > 1"), f"{folder}/hot")
    out = sized_join(sized_join(sized_join(united, left, "bucket", "left", SMALL), homes, "member", "left", SMALL), hot, "bucket", "left", SMALL)
    slots = F.coalesce("slots", F.lit(1).cast("long"))
    return out.select("bucket", F.pmod(F.xxhash64("member"), slots).alias("slot"), slots.alias("slots"), "member", "root", (F.col("home") != F.col("host")).alias("outside"))


def _linked(rows: DataFrame, doc: DataFrame, entries: DataFrame, folder: str, words: int, threshold: float, salt: int) -> DataFrame:
    """``member, root`` of every member with a link to another."""
    spark, left = rows.sparkSession, _distinct_buckets(entries, folder)
    discard(spark, f"{folder}/entries", f"{folder}/about")
    first = written(
        doc.where("n > 0").groupBy("member").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.min("n").alias("n"), F.first("bits", True).alias("bits"), F.first("wide", True).alias("wide"))
        .join(left.select("member").distinct(), "member", "left_semi"), f"{folder}/members",
    )
    about, root, links = first.select("member", "n", "bits"), None, []
    hint = F.broadcast if fits(about, SMALL_BITS) else lambda x: x
    for turn in count():
        here = f"{folder}/round-{turn}"
        active = left.withColumn("root", F.col("member")) if root is None else sized_join(left, root, "member", "left", SMALL).withColumn("root", F.coalesce("root", "member"))
        if turn:
            open_ = active.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("slots").alias("slots")).where("lo <> hi").select("bucket", "slots")
            active = written(sized_join(active, written(_slots(open_).drop("slots"), f"{here}/open"), ["bucket", "slot"], "left_semi", SMALL), f"{here}/active")
            if active.isEmpty():
                break
        elif active.isEmpty():
            break
        active = written(_united(active, f"{here}/unite"), f"{here}/united") if turn == 1 else active.withColumn("outside", F.lit(None).cast("boolean"))
        choice = F.pmod(F.xxhash64("member", F.lit(turn)), F.lit(4**turn))
        chosen = active.where("outside is null").groupBy("bucket", choice.alias("_")).agg(F.min(F.struct("member", "root")).alias("pivot"), F.max("slots").alias("slots"))
        chosen = chosen.select("bucket", "slots", F.col("pivot.member").alias("member"), F.col("pivot.root").alias("pivot_root"))
        if turn == 1:
            discard(spark, f"{here}/unite", f"{here}/active")
            chosen = chosen.union(active.where("outside").select("bucket", "slots", "member", F.col("root").alias("pivot_root")))
        chosen = written(chosen, f"{here}/chosen")
        pivots = _slots(chosen.join(hint(about), "member")).select("bucket", "slot", F.col("member").alias("pivot"), "pivot_root", F.col("n").alias("pivot_n"), F.col("bits").alias("pivot_bits"))
        known = active.drop("slots", "outside").join(hint(about), "member")
        # what the join itself rules out is never a row
        met = (known["bucket"] == pivots["bucket"]) & (known["slot"] == pivots["slot"]) & (F.col("root") != F.col("pivot_root")) & _possible(threshold)
        pairs = written(known.join(pivots, met).select(F.least("member", "pivot").alias("a"), F.greatest("member", "pivot").alias("b")).distinct(), f"{here}/pairs")
        pairs = written(_near(pairs, first, threshold), f"{here}/near")
        if not pairs.isEmpty():
            ends = written(pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct(), f"{here}/members")
            ends = written(sized_join(first.select("member", "at"), ends, "member", "left_semi", SMALL), f"{here}/ends")
            texts = written(_texts(rows, ends, words, salt), f"{here}/texts")
            if texts.count() > ends.count():  # repeated rows
                texts = written(texts.dropDuplicates(["member"]), f"{here}/texts-once")
            links.append(written(_verified(pairs, texts, threshold, words), f"{here}/links"))
            discard(spark, f"{here}/texts", f"{here}/texts-once", f"{here}/pairs")
            root = _lowered(links[-1], root, here)
        if turn:
            discard(spark, *(f"{folder}/round-{turn - 1}/{x}" for x in ("active", "united", "near")))
        # pivots have been compared with all members of their buckets
        left = sized_join(active.where("outside is null").select("bucket", "slot", "slots", "member"), chosen, ["bucket", "member"], "left_anti", SMALL)
    if root is None:
        return first.select("member", F.col("member").alias("root")).limit(0)
    return written(components(reduce(DataFrame.union, links), f"{folder}/components").withColumnRenamed("u", "member"), f"{folder}/root")


def _lowered(links: DataFrame, root: DataFrame | None, here: str) -> DataFrame | None:
    """Roots after more links: each takes the least root that its links reach, and that one's.

    Members of one root are of one component, which is all that the rounds
    need; the components themselves are found once, from all links.
    """
    if links.isEmpty():
        return root
    if root is None:
        ends = links
    else:
        up = lambda end: root.select(F.col("member").alias(end), F.col("root").alias(f"root_{end}"))
        both = sized_join(sized_join(links, up("a"), "a", "left", SMALL), up("b"), "b", "left", SMALL)
        ends = both.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b")
    near = ends.union(ends.select("b", "a")).groupBy("a").agg(F.min("b").alias("low"))
    step = written(near.select("a", F.least("a", "low").alias("low")), f"{here}/step")
    jump = sized_join(step, step.toDF("low", "lower"), "low", "left", SMALL).select(F.col("a").alias("old"), F.coalesce("lower", "low").alias("new"))
    jump = written(jump, f"{here}/jump")
    if root is None:
        return written(jump.toDF("member", "root"), f"{here}/root")
    known = root.union(sized_join(jump.select(F.col("old").alias("member"), F.col("old").alias("root")), root, "member", "left_anti", SMALL))
    return written(sized_join(known, jump.withColumnRenamed("old", "root"), "root", "left", SMALL).select("member", F.coalesce("new", "root").alias("root")), f"{here}/root")


def one_of_each(spark: SparkSession, docs: DataFrame, *, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each component, with all columns: the one with the smallest id.

    Rows with an id stay before rows without one.  Of rows that repeat the
    smallest id with different texts one stays; rows that repeat both id and
    text are one document and stay or go together.  Documents without words
    stay.
    """
    found = written(_classes(spark, docs, words, threshold).where("root is not null"), f"{work_dir(spark, 'near')}/rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark")
    keeper = found.groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("root", "first")
    gone = sized_join(found, written(keeper, f"{work_dir(spark, 'near')}/keeper"), "root", "inner", SMALL).where(order != F.col("first"))
    gone = written(gone.select(F.col("doc_id").alias("__lexloom_id"), F.col("mark").alias("__lexloom_mark")).distinct(), f"{work_dir(spark, 'near')}/gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__lexloom_id")) & (_mark(F.col("text")) == F.col("__lexloom_mark"))
    return docs.join(F.broadcast(gone) if fits(gone, SMALL) else gone, same, "left_anti")
