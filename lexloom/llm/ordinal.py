"""Cumulative-link (proportional-odds) regression on hashed words.

``P(grade > k | x) = sigmoid(w.x - c_k)`` with one weight vector for all grades
and ordered thresholds ``c_0 < c_1 < ...``.  A text's features are the distinct
64-bit hashes of its lower-cased words, of their last three bytes and of their
first three, five, six and seven (stems that take many endings), each once more
as a dense feature if one word in a hundred has it.  Features found in at least
``min_df`` fitted texts whose mean grade is ``screen`` standard errors from the
overall one keep a weight, however many they are; because the whole hash is
compared, unseen words weigh nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexloom.llm import exchange
from lexloom.llm import textkit as tk
from lexloom.llm.store import open_file, parts_for, small_batches, work_dir, write_file, written

#: Bound of the labelled rows that a model is fitted on.
FIT_ROWS = 12_000
#: Standard errors by which a feature's mean grade must differ.
SCREEN = 4.0
#: Fitted texts that must have a feature.
MIN_DF = 8
#: Bytes at a word's end and at its start that are features of their own.
TAILS, HEADS = (3,), (3, 5, 6, 7)
DENSE = np.uint64(0xE7037ED1A0B428DB)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word, then of the words' last and first bytes."""
    s, e, first = tk.spans(buf, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    whole = tk.slice_hashes(buf, s, e, tk.LOWER)
    size, out = e - s, [whole]
    for salt, ends, sign in ((1, TAILS, -1), (2, HEADS, 1)):
        code = np.zeros(len(s), np.uint64)
        for step in range(max(ends)):
            have = np.flatnonzero(size > step)
            at = s[have] + step if sign > 0 else e[have] - 1 - step
            code[have] = code[have] * np.uint64(256) + tk.LOWER[buf[at]] + np.uint64(1)
            if step + 1 in ends:
                out.append(tk.mix(code + np.uint64(0x5851F42D4C957F2D * (salt * 16 + step) & (1 << 64) - 1)))
    return np.tile(doc, len(out)), np.concatenate(out)


def described(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, plain and dense ones, in the order of texts."""
    doc, key = features(buf, off)
    words = np.bincount(doc, minlength=len(off) - 1) / (1 + len(TAILS) + len(HEADS))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    doc, key, count = doc[start], key[start], np.diff(np.append(start, len(key)))
    doc2, key2 = dense(doc, key, count, words)
    doc, key = np.concatenate([doc, doc2]), np.concatenate([key, key2])
    order = np.argsort(doc, kind="stable")
    return doc[order], key[order]


def dense(doc: np.ndarray, key: np.ndarray, count: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct features, those that one word in a hundred has: features of their own."""
    kept = often(count, words[doc])
    return doc[kept], tk.mix(key[kept] ^ DENSE)


def often(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether one word in a hundred has the feature, and more than one word."""
    return (count * 100 >= words) & (count > 1)


@dataclass
class OrdinalModel:
    """Sorted feature hashes with their weights, and the ordered thresholds."""

    keys: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray
    _slots: np.ndarray | None = field(default=None, repr=False)

    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.zeros(1 << 22, bool)
            self._slots[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        return self._slots

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if not len(self.keys):
            return np.zeros(n)
        doc, h = features(buf, off)
        words = np.bincount(doc, minlength=n) / (1 + len(TAILS) + len(HEADS))
        at, _ = self._counted(doc, h)
        # the plain feature of a dense one need not be kept, so every word's dense feature is looked up
        at2, count = self._counted(doc, tk.mix(h ^ DENSE))
        at2 = at2[often(count, words[at2 // len(self.keys)])]
        at = np.concatenate([at, at2])
        return np.bincount(at // len(self.keys), self.weights[at % len(self.keys)], n)

    def _counted(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs ``text * len(keys) + place`` of the hashes that have a weight, and how often each is met."""
        doc, at = self._known(doc, h)
        return np.unique(doc * len(self.keys) + at, return_counts=True)

    def _known(self, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(self.slots()[(h >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        hit = self.keys[at] == h[near]
        return doc[near[hit]], at[hit]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and each threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.cuts[None, :], -60, 60)))

    def save(self, uri: str) -> None:
        write_file(uri, lambda out: out.write(pa.serialize_pandas(self._frame()).to_pybytes()))

    def _frame(self):
        import pandas as pd

        return pd.DataFrame({k: [getattr(self, k).tobytes()] for k in ("keys", "weights", "cuts", "grades")})

    @staticmethod
    def load(uri: str) -> OrdinalModel:
        with open_file(uri) as f:
            row = pa.deserialize_pandas(f.read()).iloc[0]
        kinds = {"keys": np.uint64, "weights": np.float64, "cuts": np.float64, "grades": np.int64}
        return OrdinalModel(**{k: np.frombuffer(row[k], t).copy() for k, t in kinds.items()})


@lru_cache(4)
def loaded(uri: str) -> OrdinalModel:
    """A worker's copy of a saved model."""
    return OrdinalModel.load(uri)


def fit_arrays(doc: np.ndarray, key: np.ndarray, y: np.ndarray, grades: np.ndarray, *, l2: float, steps: int) -> OrdinalModel:
    """Adam on the full penalised likelihood; deterministic.

    The thresholds are a first one and positive gaps, so they stay ordered.
    Rows are weighted so that every grade counts alike.
    """
    n, levels = len(y), len(grades)
    keys, col, df = np.unique(key, return_inverse=True, return_counts=True)
    share = np.bincount(y, minlength=levels) / n
    row_weight = 1 / (levels * share[y] * n)
    above = np.cumsum(share[::-1])[::-1][1:].clip(1e-6, 1 - 1e-6)
    first = np.log((1 - above) / above)
    if not len(keys):  # nothing tells grades apart: base rates
        return OrdinalModel(keys, np.zeros(0), np.maximum.accumulate(first) + np.arange(len(first)) * 1e-9, grades)
    theta = np.concatenate([np.zeros(len(keys)), first[:1] * 0, np.log(np.maximum(np.diff(first), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(keys)
    gain = 1 / np.sqrt(np.maximum(1, df) / max(1, n) * 20 + 1)  # frequent words move less
    for t in range(1, steps + 1):
        w = theta[:k] * gain
        cuts = np.cumsum(np.concatenate([theta[k : k + 1], np.exp(theta[k + 1 :])]))
        score = np.bincount(doc, w[col], n)
        edge = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -40, 40)))  # P(grade <= k)
        edge = np.concatenate([np.zeros((n, 1)), edge, np.ones((n, 1))], 1)
        slope = edge * (1 - edge)
        at = np.arange(n)
        p = np.maximum(edge[at, y + 1] - edge[at, y], 1e-9)
        up, low = slope[at, y + 1] / p * row_weight, slope[at, y] / p * row_weight
        g_score = up - low  # of the loss: the score lowers both edges
        g_cut = np.zeros(levels + 1)
        np.add.at(g_cut, y + 1, -up)
        np.add.at(g_cut, y, low)
        g_cut = g_cut[1:levels]
        reach = np.cumsum(g_cut[::-1])[::-1]
        g_theta = np.concatenate([np.bincount(col, g_score[doc], k) * gain + l2 * theta[:k], reach[:1], reach[1:] * np.exp(theta[k + 1 :])])
        m = 0.9 * m + 0.1 * g_theta
        v = 0.99 * v + 0.01 * g_theta**2
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    cuts = np.cumsum(np.concatenate([theta[k : k + 1], np.exp(theta[k + 1 :])]))
    return OrdinalModel(keys, theta[:k] * gain, cuts, grades)


def fit(
    spark: SparkSession, docs: DataFrame, ratings: DataFrame, grade: str, *, fit_rows: int = FIT_ROWS, min_df: int = MIN_DF, screen: float = SCREEN, l2: float = 1e-4, steps: int = 200,
) -> OrdinalModel | None:
    """Fits on at most ``fit_rows`` rated documents, chosen by a hash of the id.

    Ratings without an id or a grade are left out; a document rated several
    times counts once for each rating.  Fewer than two grades give no model.
    Features are counted and screened on the executors; chance features would
    share the cues' weight.  The driver gets, of each fitted document, the
    places of the features that are left.
    """
    small_batches(spark)
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("long").alias("grade")).dropna()
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(fit_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tk.pieces(batches, size=tk.BLOCK // 2):
            doc, key = described(buf, off)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("grade")), tk.strings([key[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])],
                ["doc_id", "grade", "keys"],
            )

    # the chosen rows are bounded by fit_rows, so they may be broadcast
    told = written(texts.join(F.broadcast(chosen), "doc_id").mapInArrow(describe, "doc_id long, grade long, keys binary"), f"{work_dir(spark, 'fit')}/rows")
    counts = {r.grade: r["n"] for r in told.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    grades = np.array(sorted(counts), np.int64)
    if len(grades) < 2:
        return None
    size = np.array([counts[int(g)] for g in grades], float)
    kept = _screened(told, grades, size, min_df, screen)

    def only_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                x = np.frombuffer(x, np.uint64)
                at = np.minimum(np.searchsorted(kept, x), max(0, len(kept) - 1))
                out.append(at[kept[at] == x].astype(np.uint32).tobytes() if len(kept) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tk.strings(out)], ["doc_id", "grade", "keys"])

    rows = told.mapInArrow(only_kept, "doc_id long, grade long, keys binary").toArrow().sort_by([(c, "ascending") for c in ("doc_id", "grade", "keys")])
    y = np.searchsorted(grades, rows["grade"].to_numpy())
    places, off = tk.column(rows["keys"])
    sizes = np.diff(off) // 4
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    model = fit_arrays(doc, places.view(np.uint32), y, grades, l2=l2, steps=steps)
    return OrdinalModel(kept[model.keys], model.weights, model.cuts, model.grades)


def _screened(told: DataFrame, grades: np.ndarray, size: np.ndarray, least: int, screen: float) -> np.ndarray:
    """All features that tell grades apart, sorted.

    Counted on the executors: pieces send each part their features' counts and
    sums of grades, packed, and only those that pass come to the driver.
    """
    rank, parts = np.arange(len(grades)), parts_for(told)
    mean = float((size * rank).sum() / size.sum())
    var = float((size * (rank - mean) ** 2).sum() / size.sum())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tk.pieces(batches, "keys"):
            key = np.frombuffer(buf.tobytes(), np.uint64)
            y = np.repeat(np.searchsorted(grades, tk.integers(batch, "grade")), np.diff(off) // 8)
            key, back, df = np.unique(key, return_inverse=True, return_counts=True)
            total = np.bincount(back, y, len(key)) if len(key) else np.zeros(0)
            rows = [(p, key[i].tobytes(), df[i].astype(np.int64).tobytes(), total[i].tobytes()) for p, i in exchange.by_part(key, parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "keys", "counts", "sums"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        for b in batches:
            for x, c in zip(held, b.columns[1:], strict=True):
                x += c.to_pylist()
        key, df, total = (exchange.joined(x, t) for x, t in zip(held, (np.uint64, np.int64, np.float64), strict=True))
        if len(key):
            key, back = np.unique(key, return_inverse=True)
            df, total = np.bincount(back, df), np.bincount(back, total)
            lean = np.abs(total - df * mean) / np.sqrt(np.maximum(df * var, 1e-9))
            yield pa.RecordBatch.from_arrays([tk.strings([key[(df >= least) & (lean >= screen)].tobytes()])], ["keys"])

    rows = told.mapInArrow(count, "part int, keys binary, counts binary, sums binary").repartitionById(parts, F.col("part")).mapInArrow(keep, "keys binary").collect()
    return np.sort(exchange.joined([bytes(r["keys"]) for r in rows], np.uint64))


def score(spark: SparkSession, docs: DataFrame, model: OrdinalModel | None, *, tail_grade: int, prefix: str) -> DataFrame:
    """All columns of ``docs`` and ``<prefix>_expected``, ``<prefix>_tail`` (which replace columns so named).

    The expected grade is ``sum of g * P(g)``; the tail is ``P(grade >=
    tail_grade)``.  Without a model both are null.  A null or empty text has
    no features and gets the model's base rates.
    """
    expected, tail = f"{prefix}_expected", f"{prefix}_tail"
    docs = docs.drop(expected, tail)
    if model is None:
        return docs.select("*", F.lit(None).cast("double").alias(expected), F.lit(None).cast("double").alias(tail))
    uri = f"{work_dir(spark, prefix)}/model"
    model.save(uri)
    schema = StructType([*docs.schema.fields, StructField(expected, DoubleType()), StructField(tail, DoubleType())])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(uri)
        at = int(np.searchsorted(m.grades, tail_grade))
        for whole in batches:
            column = whole.column(place)
            filled = pa.RecordBatch.from_arrays([column.fill_null("")], ["text"])
            parts = [m.scores(buf, off) for _, buf, off in tk.pieces(iter([filled]), size=tk.BLOCK // 2)]
            tails = m.tails(np.concatenate(parts) if parts else np.zeros(0))
            mean = m.grades[0] + tails @ np.diff(m.grades)
            top = np.ones(len(mean)) if at == 0 else np.zeros(len(mean)) if at >= len(m.grades) else tails[:, at - 1]
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(mean), pa.array(top)], names=[*(f"c{i}" for i in range(whole.num_columns)), expected, tail])

    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, _renamed(schema)).toDF(*schema.names)


def _renamed(schema: StructType) -> StructType:
    """Columns by place, so that no name of the input can clash."""
    n = len(schema.fields)
    return StructType([StructField(f"c{i}" if i < n - 2 else f.name, f.dataType) for i, f in enumerate(schema.fields)])
