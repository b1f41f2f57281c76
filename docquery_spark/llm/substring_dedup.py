"""Substring dedup with a count-min prefilter.

A window is ``n`` consecutive words of a document. Each word covered by a window whose words also
start earlier (smaller doc_id, or earlier in the same document) is removed.

Documents are dealt once into groups of a few MB of text; the three passes below read that one
shuffle. What groups know of a cell or a window meets in shards, by ``_exchange``: the rows that a
group sends are bounded, and shards grow in number with the input.

1. Every group makes a count-min sketch of its windows: two rows of cells, counts capped at 2, the
   touched cells only, in sorted order. Sketches are merged shard by shard of cells. The number of
   cells follows the input, so the share of false positives stays the same at any size.
2. Each shard answers each group with one bit for each cell that the group touched: is the merged
   count 2 or more. A window is estimated repeated when both its cells are; estimates are never too
   low, so no repeated window is lost. Only those windows go on, as 128-bit fingerprints, of each
   fingerprint the first in the group; they are grouped exactly, and all but the first learn it.
3. Each group marks the words of its later windows and gives out what is left.

No task sees all windows of a frequent passage: a group sends one entry a passage. What a task holds
is a group of documents, a shard of cells, or a shard of the fingerprints.

Nulls: a null text has no words; a null doc_id comes after all others. Documents that share a
doc_id are ordered by their hash group, then text, then arrival, so of repeated rows one comes
first and the others repeat it. Documents with fewer than ``n`` words have no window and stay
whole. An empty table gives an empty result. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import ASKS, Protocol, ask, levels, packed, parts, unpacked
from ._frames import text_bytes
from ._words import mix64, words

GROUP_BYTES = 6 << 20
LEAST_GROUPS = 64
#: Bits of a shard's cell numbers, and bytes of text whose windows are counted in one shard of a row.
CELL_BITS = 23
BLOCK_BYTES = 8 << 20
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LAST_ID = np.iinfo(np.int64).max
MEMO_WORDS = 300_000
_memo: dict[bytes, bytes] = {}


def _word_codes(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit codes of each word."""
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in tokens), dtype=np.int64, count=len(tokens))
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    digests = []
    for w in ids:
        d = _memo.get(w)
        if d is None:
            d = _memo[w] = hashlib.blake2b(w, digest_size=16).digest()
        digests.append(d)
    codes = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
    return codes[at, 0], codes[at, 1]


class _Group:
    """The documents of one group in order, and the hashes of their windows."""

    def __init__(self, pdf: pd.DataFrame, n: int, hashes: bool = True):
        self.named = pdf["named"].to_numpy(dtype=bool)
        self.ids = np.where(self.named, pdf["doc_id"].to_numpy(dtype=np.int64), LAST_ID)
        texts = [b"" if x is None else bytes(x) for x in pdf["text"].tolist()]
        self.order = sorted(range(len(texts)), key=lambda i: (self.ids[i], not self.named[i], texts[i]))
        self.tokens = [words(texts[i]) for i in self.order]
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.sizes)))
        self.n = n
        if hashes:
            flat = [w for t in self.tokens for w in t]
            count = len(flat) - n + 1
            # windows that start in one document and end in another don't count
            left = np.repeat(self.at[1:], self.sizes) - np.arange(len(flat))
            self.starts = np.flatnonzero(left >= n)
            self.h = [np.empty(0, dtype=np.uint64)] * 2
            if len(self.starts):
                for r, codes in enumerate(_word_codes(flat)):
                    f, out = np.uint64(FACTORS[r]), codes[:count].copy()
                    for j in range(1, n):
                        out *= f
                        out += codes[j : j + count]
                    self.h[r] = mix64(out[self.starts])

    def cells(self, width: int) -> np.ndarray:
        """Cell numbers of ``width`` bits in all of every window, a row of the sketch after the other; the first bit is the row's."""
        return np.concatenate([(h >> np.uint64(65 - width)) | np.uint64(r << (width - 1)) for r, h in enumerate(self.h)])

    def doc_ids(self) -> np.ndarray:
        return np.repeat(self.ids[self.order], self.sizes)


def _rows(arrays: dict[str, np.ndarray], bits: int, width: int, asker: int) -> list[tuple]:
    return [(path, asker, packed(**{c: a[at] for c, a in arrays.items()})) for path, at in parts(arrays["key"], bits, width)]


# -- the sketch: key is a cell, many whether its count is 2 or more, of one group or of all


def _merged_cells(pieces: list[dict]) -> dict[str, np.ndarray]:
    key = np.concatenate([p["key"] for p in pieces])
    own = 1 + np.concatenate([p["many"] for p in pieces])
    order = np.argsort(key, kind="stable")
    key, own = key[order], own[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    return {"key": key[heads], "many": (np.add.reduceat(own, heads) > 1).astype(np.uint64) if len(key) else key}


def _answer_cells(path, pieces, askers):
    count = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    low = np.uint64((1 << CELL_BITS) - 1)
    for p in pieces:
        at = p["key"] & low
        count[at] = np.minimum(count[at] + 1 + p["many"].astype(np.uint8), 2)
    return [{"many": count[p["key"] & low] > 1} for p in pieces]


def _back_cells(pieces, askers, below):
    held = _merged_cells(pieces)["key"]
    return [{"many": below["many"][np.searchsorted(held, p["key"])]} for p in pieces]


def _sketch(n: int, bits: int, width: int):
    def run(key, pdf):
        cells, times = np.unique(_Group(pdf, n).cells(width), return_counts=True)
        rows = _rows({"key": cells, "many": (times > 1).astype(np.uint64)}, bits, width, int(key[0]))
        return pd.DataFrame(rows, columns=["path", "asker", "body"])

    return run


# -- windows: key and low are the fingerprint, id and g the document's and group's, start its place in the group

WINDOW = ("key", "low", "id", "g", "start")


def _least(pieces: list[dict]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(the first window of each fingerprint, all others), by fingerprint."""
    all_ = {c: np.concatenate([p[c] for p in pieces]) for c in WINDOW}
    order = np.lexsort((all_["g"], all_["id"], all_["low"], all_["key"]))
    all_ = {c: a[order] for c, a in all_.items()}
    new = np.ones(len(order), dtype=bool)
    new[1:] = (all_["key"][1:] != all_["key"][:-1]) | (all_["low"][1:] != all_["low"][:-1])
    return {c: a[new] for c, a in all_.items()}, {c: a[~new] for c, a in all_.items()}


def _later(later: list[dict], pieces: list[dict], askers) -> list[dict | None]:
    """(g, start) of the later windows to the asker that brought them."""
    g, start = (np.concatenate([x[c] for x in later]) for c in ("g", "start"))
    order = np.lexsort((start, g))
    g, start = g[order], start[order]
    out = []
    for p in pieces:
        # an asker is a group, or a cell that stands for several
        at = np.flatnonzero(np.isin(g, np.unique(p["g"])))
        out.append({"g": g[at], "start": start[at]} if len(at) else None)
    return out


def _answer_windows(path, pieces, askers):
    if path < 0:  # what a group has settled by itself passes through
        return [{"g": p["g"], "start": p["start"]} for p in pieces]
    return _later([_least(pieces)[1]], pieces, askers)


def _merged_windows(pieces: list[dict]) -> dict[str, np.ndarray]:
    return _least(pieces)[0]


def _back_windows(pieces, askers, below):
    return _later([_least(pieces)[1], below], pieces, askers)


def _candidates(n: int, bits: int, width: int):
    def run(key, pdf, replies):
        g, own = _Group(pdf, n), int(key[0])
        cells, back = np.unique(g.cells(width), return_inverse=True)
        some = [unpacked(b, "many")["many"] for b in replies.sort_values("path")["body"]]
        many = np.concatenate(some).astype(bool)[back] if some else np.empty(0, dtype=bool)
        at = np.flatnonzero(many[: len(g.starts)] & many[len(g.starts) :])
        rows = []
        if len(at):
            h1, h2, start = g.h[0][at], g.h[1][at], g.starts[at]
            by = np.lexsort((start, h2, h1))
            h1, h2, start = h1[by], h2[by], start[by]
            first = np.ones(len(by), dtype=bool)
            first[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            zero = np.zeros(len(by), dtype=np.uint64)
            arrays = {"key": h1, "low": h2, "id": g.doc_ids()[start], "g": zero + np.uint64(own), "start": start}
            if not first.all():
                again = np.sort(start[~first])
                rows.append((-1 - own, own, packed(**{c: zero[: len(again)] for c in WINDOW[:3]}, g=arrays["g"][: len(again)], start=again)))
            # ids in the order of unsigned numbers
            arrays["id"] = arrays["id"].view(np.uint64) ^ np.uint64(1 << 63)
            rows += _rows({c: a[first] for c, a in arrays.items()}, bits, 64, own)
        return pd.DataFrame(rows, columns=["path", "asker", "body"])

    return run


def _cut(n: int):
    def run(key, pdf, later):
        g, own = _Group(pdf, n, hashes=False), int(key[0])
        edge = np.zeros(g.at[-1] + 1, dtype=np.int64)
        for body in later["body"]:
            x = unpacked(body, "g", "start")
            starts = x["start"][x["g"] == own].astype(np.int64)
            edge[starts] += 1
            edge[starts + n] -= 1
        # a window may be listed by several: any count above none is a removal
        gone = np.cumsum(edge)[:-1] > 0
        rows = []
        for k, i in enumerate(g.order):
            mask = gone[g.at[k] : g.at[k + 1]]
            lost = int(mask.sum())
            kept = g.tokens[k] if not lost else [w for w, m in zip(g.tokens[k], mask.tolist(), strict=True) if not m]
            rows.append((int(g.ids[i]), bool(g.named[i]), len(mask), lost, b" ".join(kept)))
        return pd.DataFrame(rows, columns=["doc_id", "named", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, n: int = 20) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_text (kept words, one space between)."""
    total = text_bytes(docs)
    groups = max(LEAST_GROUPS, -(-total // GROUP_BYTES))
    # the sketch's first bit is its row, and a shard holds 2 ** CELL_BITS cells
    bits = levels(2 * max(1, -(-total // BLOCK_BYTES)))
    width = sum(bits) + CELL_BITS
    number = F.col("doc_id").cast("long")
    dealt = docs.select(
        F.coalesce(number, F.lit(0)).alias("doc_id"),
        number.isNotNull().alias("named"),
        F.col("text").cast("binary").alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"),
    ).repartition(groups, "g")
    by_group = F.col("asker").cast("int")
    cells = Protocol(("key", "many"), ("many",), _merged_cells, _answer_cells, _back_cells, width)
    sketches = dealt.groupBy("g").applyInPandas(_sketch(n, bits[0], width), ASKS)
    answers = ask(sketches, bits, cells).withColumn("g", by_group)
    shares = levels(groups)
    found = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(_candidates(n, shares[0], width), ASKS)
    windows = Protocol(WINDOW, ("g", "start"), _merged_windows, _answer_windows, _back_windows)
    later = ask(found, shares, windows).withColumn("g", by_group)
    out = dealt.groupBy("g").cogroup(later.groupBy("g")).applyInPandas(
        _cut(n), "doc_id long, named boolean, n_words long, n_removed long, kept_text binary"
    )
    return out.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text"))
