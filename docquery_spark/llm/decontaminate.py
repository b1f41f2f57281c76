"""Benchmark decontamination by normalised n-grams.

The benchmark's windows of ``n`` words (an item with fewer words, but not none, is one window) are
indexed on the driver and broadcast, a block of items at a time. A block holds at most
``BLOCK_WORDS`` words, of long items in pieces that overlap by ``n - 1`` words, and its index some 40
bytes a word besides the words themselves, so what is broadcast has a fixed bound. A Python stage
holds at most ``RESIDENT`` blocks; a larger benchmark means more passes over the documents, each
written down and adding to the hits of the one before. Documents are scanned in Arrow batches, which
hold their texts only: words become numbers of the block's vocabulary, candidate positions are found
by a rolling hash over runs of known words, and each is verified word by word.

Nulls: a null text, of a document or an item, has no words; a null item_id is called ``null``; a
null doc_id is a document like any other. Empty texts have no words. Repeated rows give repeated
rows. An item repeated under one id counts once. Empty tables give no rows (documents) or no hits
(benchmark). Other columns of the documents are kept, whatever their names; only
:func:`find_contamination` and :func:`verdicts` replace those named like a column that they add.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._frames import free_name, quoted, written
from ._words import WORD_BYTES, alnum_words, mix64

BLOCK_WORDS = 1 << 20
#: Words of a piece of a long item, besides the overlap.
PIECE_WORDS = 1 << 14
RESIDENT = 4
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
ADDED = tuple(f.name for f in FOUND)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class NgramIndex:
    """Windows of benchmark items: vocabulary, word numbers of all items in a row, and hashes of windows by length."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)], dtype=np.uint32) for _, text in items]
        self.words = np.concatenate([*words, np.zeros(0, dtype=np.uint32)])
        at, by_length = 0, {}
        for (name, _), own in zip(items, words, strict=True):
            if length := min(n, len(own)):
                starts = np.arange(at, at + len(own) - length + 1, dtype=np.uint32)
                by_length.setdefault(length, []).append((starts, np.full(len(starts), number[name], dtype=np.uint32)))
            at += len(own)
        #: length -> (sorted hashes, where each window starts in ``words``, its item)
        self.windows = {}
        for length, found in by_length.items():
            starts, item = (np.concatenate(x) for x in zip(*found, strict=True))
            h = self._hash(self.words, starts, length)
            order = np.argsort(h, kind="stable")
            self.windows[length] = h[order], starts[order], item[order]

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(length):
            out = out * _FACTOR + mix64(ids[at + j].astype(np.uint64))
        return mix64(out)

    def find(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(starts, length, numbers of items) of verified windows; 0 is no word of the benchmark."""
        gaps = np.flatnonzero(ids == 0)
        ends = np.append(gaps, len(ids))
        run = ends[np.searchsorted(gaps, np.arange(len(ids)))] - np.arange(len(ids))
        for length, (known, starts, item) in self.windows.items():
            at = np.flatnonzero(run >= length)
            if not len(at):
                continue
            h = self._hash(ids, at, length)
            first = np.searchsorted(known, h)
            near = known[np.minimum(first, len(known) - 1)] == h
            at, h, first = at[near], h[near], first[near]
            # each window of the index under the same hash
            times = np.searchsorted(known, h, side="right") - first
            at = np.repeat(at, times)
            entry = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
            same = np.ones(len(at), dtype=bool)
            for j in range(length):
                same &= ids[at + j] == self.words[starts[entry] + j]
            if same.any():
                yield at[same], length, item[entry[same]]


def _spans(mask: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scanned(pdf: pd.DataFrame, texts: list, blocks) -> pd.DataFrame:
    """Adds the hits of some blocks to those that ``pdf`` (n_words, hits, items) has."""
    tokens = [alnum_words(x) for x in texts]
    n = np.array([len(x) for x in tokens], dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(n + 1)))  # a zero parts the documents
    hits, items = list(pdf["hits"]), list(pdf["items"])
    masks: dict[int, np.ndarray] = {}
    for held in blocks:
        block = held.value
        ids = np.zeros(at[-1], dtype=np.uint32)
        get = block.vocabulary.get
        for i, x in enumerate(tokens):
            ids[at[i] : at[i] + len(x)] = np.fromiter(map(get, x, repeat(0)), dtype=np.uint32, count=len(x))
        for starts, length, which in block.find(ids):
            doc = np.searchsorted(at, starts, side="right") - 1
            for d in np.unique(doc).tolist():
                own = doc == d
                if d not in masks:
                    masks[d] = np.zeros(n[d], dtype=bool)
                    for span in hits[d]:
                        masks[d][span["start"] : span["end"]] = True
                for start in np.unique(starts[own] - at[d]).tolist():
                    masks[d][start : start + length] = True
                items[d] = sorted({*items[d], *(block.names[i] for i in np.unique(which[own]).tolist())})
    for d, mask in masks.items():
        hits[d] = _spans(mask)
    return pd.DataFrame({"n_words": n, "hits": pd.Series(hits, dtype=object), "items": pd.Series(items, dtype=object)})


def _scan(blocks, text: Column, before: Column | None) -> Column:
    if before is None:

        @F.pandas_udf(FOUND)
        def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                none = pd.DataFrame({"hits": [[] for _ in texts], "items": [[] for _ in texts]})
                yield _scanned(none, texts.tolist(), blocks)

        return first(text)

    @F.pandas_udf(FOUND)
    def more(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            yield _scanned(found, texts.tolist(), blocks)

    return more(text, before)


def _pieces(n: int, piece_words: int):
    def run(batches):
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["item_id"], pdf["text"], strict=True):
                own = alnum_words(bytes(text))
                for i in range(0, max(1, len(own) - n + 1), piece_words):
                    piece = own[i : i + piece_words + n - 1]
                    rows.append((name, b" ".join(piece), len(piece)))
            yield pd.DataFrame(rows, columns=["item_id", "text", "n"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, n: int, text: str, block_words: int, piece_words: int) -> tuple[DataFrame, str]:
    """docs with a column (its name is returned) of n_words, hits and items."""
    sc, name = docs.sparkSession.sparkContext, free_name(docs, "found")
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    ).mapInPandas(_pieces(n, piece_words), "item_id string, text binary, n long").filter("n > 0").dropDuplicates()
    total = items.agg(F.sum("n")).first()[0] or 0
    # the hash spreads the pieces, and each block is checked
    parts = [items]
    if total > block_words:
        k = -(-2 * total // block_words)
        parts = [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == b) for b in range(k)]
    out, held = docs, []

    def scanned(df: DataFrame) -> DataFrame:
        before = F.col(name) if name in df.columns else None
        return df.withColumn(name, _scan(list(held), F.col(quoted(text)).cast("binary"), before))

    block, size = [], 0
    for part in parts:
        for r in part.toLocalIterator():
            if block and size + r["n"] > block_words:
                held.append(sc.broadcast(NgramIndex(block, n)))
                block, size = [], 0
                if len(held) == RESIDENT:
                    out, held = written(scanned(out)), []
            block.append((r["item_id"], bytes(r["text"])))
            size += r["n"]
    held.append(sc.broadcast(NgramIndex(block, n)))
    return scanned(out), name


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, text: str = "text", block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """docs with n_words, hits (spans of word positions, end excluded, merged) and items (ids)."""
    found, name = _found(docs, benchmark, n, text, block_words, piece_words)
    return found.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in ADDED], f"{name}.*")


def _n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def _contaminated(n_hit: Column, n_words: Column, least_share: float) -> Column:
    return (n_hit > 0) & (n_hit * round(1 / least_share) >= n_words)


def verdicts(found: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Adds n_hit, n_items and contaminated (hit words are at least ``least_share`` of all)."""
    return found.withColumn("n_hit", _n_hit(F.col("hits"))).withColumn("n_items", F.size("items").cast("long")).withColumn(
        "contaminated", _contaminated(F.col("n_hit"), F.col("n_words"), least_share)
    )


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, hits: pd.Series) -> pd.Series:
    def one(x, spans):
        if x is None or not len(spans):  # documents that aren't cut come here too
            return x
        raw = x.encode()
        flat = raw.translate(WORD_BYTES)
        starts, ends, at = [], [], 0
        for w in flat.split():
            at = flat.index(w, at)
            starts.append(at)
            at += len(w)
            ends.append(at)
        out, last = [], 0
        for s in spans:
            out.append(raw[last : starts[s["start"]]])
            last = ends[s["end"] - 1]
        return b"".join([*out, raw[last:]]).decode()

    return pd.Series([one(x, s) for x, s in zip(text, hits, strict=True)], index=text.index, dtype=object)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", n: int = 13, least_share: float = 0.05) -> DataFrame:
    """docs without contaminated documents, or (mode ``"span"``) with their hit words cut out.

    Cutting keeps all else of the text as it is. Only contaminated documents are cut.
    """
    if mode not in ("document", "span"):
        raise ValueError("mode is 'document' or 'span'")
    found, name = _found(docs, benchmark, n, "text", BLOCK_WORDS, PIECE_WORDS)
    hit = _contaminated(_n_hit(F.col(f"{name}.hits")), F.col(f"{name}.n_words"), least_share)
    if mode == "document":
        return found.filter(~hit).select(*[F.col(quoted(c)) for c in docs.columns])
    text = F.when(hit, _cut("text", F.col(f"{name}.hits"))).otherwise(F.col("text")).alias("text")
    return found.select(*[text if c.lower() == "text" else F.col(quoted(c)) for c in docs.columns])
