"""Token counts of documents of any length, by overlap resynchronisation.

Every text is encoded by the library itself in chunks with offsets; a text
that one chunk holds is encoded once, as it is.  Two neighbouring chunks
overlap and are spliced at a boundary that both have and that is provably
stable: a word ends there and ASCII white space follows, where no pre-token
(or piece) and no normalisation reaches across, and from which on both
encodings agree up to the end of the overlap.  If an overlap has no such
boundary it is widened, twofold each time, up to the rest of the text.  Memory
is bounded by the chunk (or by the longest run without white space).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import encoders
from lexloom.llm import textkit as tk
from lexloom.llm.store import small_batches

#: Characters of a chunk and of the first overlap; bytes of texts that are handed to the library at once.
CHUNK, OVERLAP, AT_ONCE = 8_192, 384, 1 << 18
WHITE = " \t\n\v\f\r"


@lru_cache(2)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(2)
def crosses_words(path: str) -> bool:
    """Whether a piece of a sentencepiece model has white space (U+2581) after something else: then no place is stable."""
    model = _pieces(path)
    return any("\u2581" in model.id_to_piece(i).lstrip("\u2581") for i in range(model.get_piece_size()))


class Tokens:
    """Where the tokens of a chunk start, in the whole text's offsets; only those that are asked for are fetched."""

    def __init__(self, path: str, text: str, base: int):
        if path.endswith(".model"):
            at = np.array([x.begin for x in _pieces(path).encode(text, return_type="proto").pieces], np.int64)
            # the library counts bytes, and a character may be several pieces
            inner = (np.frombuffer(text.encode() + b" ", np.uint8) & 0xC0) == 0x80
            at = (at - np.cumsum(inner)[at] + base).tolist()
            self.n, self.start = len(at), at.__getitem__
        else:
            found = encoders.tokenizer(path).encode(text, add_special_tokens=False)
            self.n, self.start = len(found), lambda i: found.token_to_chars(i)[0] + base

    def before(self, place: int) -> int:
        """How many tokens start before a place."""
        return bisect_left(range(self.n), place, key=self.start)

    def inside(self, lo: int, hi: int) -> list[int]:
        """Starts in ``(lo, hi)``."""
        return [self.start(i) for i in range(self.before(lo + 1), self.before(hi))]


def counts_of(path: str, texts: list[str]) -> list[int]:
    if path.endswith(".model"):
        return [len(x) for x in _pieces(path).encode(texts, num_threads=1)]
    return [len(x) for x in encoders.plain(path, texts)]


def stable_boundary(text: str, left: Tokens, right: Tokens, lo: int, hi: int, white: str = WHITE) -> int | None:
    """Least place in ``(lo, hi)`` where a word ends before white space and
    from which both encodings start the same tokens up to the last such place.

    What comes after the last one may be the half of a word in the left
    encoding, and is not looked at; one token at least must agree.
    """
    ends = [i for i in range(lo + 1, hi) if text[i] in white and text[i - 1] not in WHITE and not encoders.OTHER_SPACE.match(text[i - 1])]
    if not ends:
        return None
    a, b = left.inside(lo, ends[-1]), right.inside(lo, ends[-1])
    n, same = min(len(a), len(b)), 0
    while same < n and a[len(a) - 1 - same] == b[len(b) - 1 - same]:
        same += 1
    return next((i for i in ends if i >= a[len(a) - same]), None) if same else None


def count_long(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, encoded in overlapping chunks.

    A text with white space beyond ASCII is cut where its neighbours are words
    only, as everywhere; a text without any white space is encoded whole.
    """
    white = " " if path.endswith(".model") else WHITE  # pieces may have other white space inside
    total, start, end = 0, 0, min(len(text), chunk)
    own, skipped = Tokens(path, text[start:end], start), 0
    while end < len(text):
        width = overlap
        while True:
            begin = max(start, end - width)
            stop = min(len(text), begin + max(chunk, 2 * width))
            after = Tokens(path, text[begin:stop], begin)
            cut = stable_boundary(text, own, after, begin, end, white)
            if cut is not None:
                break
            if begin == start:  # nothing in this chunk is stable: lengthen it
                end = min(len(text), end + max(chunk, end - start))
                skip = int(white == " " and start > 0)  # such a model adds a space of its own at the start
                own, skipped = Tokens(path, text[start + skip : end], start + skip), 0
                if end == len(text):
                    return total + own.n
                width = overlap
                continue
            width *= 2
        total += own.before(cut) - skipped
        start, end, own, skipped = cut, stop, after, after.before(cut)
    return total + own.n - skipped


def token_counts(docs: DataFrame, path: str, *, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``path`` is a ``.json`` for the tokenizers library or a ``.model`` for
    sentencepiece.  No special tokens are added; special strings inside texts
    are treated as the library does by default.  A null text is empty and has
    no tokens; repeated rows are counted each; ids may be null; the order of
    rows and further columns don't matter.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = path.endswith(".model") and crosses_words(path)
        for batch, _, off in tk.pieces(batches, size=AT_ONCE):
            size = np.diff(off)
            texts = batch.column(1).to_pylist()
            short = [len(t) <= chunk or whole for t in texts]
            counts = np.zeros(len(texts), np.int64)
            counts[short] = counts_of(path, [t for t, s in zip(texts, short, strict=True) if s])
            for i, t in enumerate(texts):
                if not short[i]:
                    counts[i] = count_long(path, t, chunk, overlap)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int64)), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
