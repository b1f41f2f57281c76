"""LM scoring by cross-entropy difference of two matched bigram models.

The background model counts all documents, the target model the target ones. Both share one
vocabulary, every word of the corpus, whatever its frequency and the corpus's size, and one
smoothing: bigram and unigram parts of the model's own counts, and a small part of the corpus's word
frequencies, which no word of it is without. A word's loss difference is its target loss less its
background loss, in nats; a document's score is the mean over its words, so lower is closer to the
target text.

Documents are dealt once into groups of a few MB. Each group sends its distinct words and bigrams, by
56-bit hashes, with both counts to the shards that own them (see ``_exchange``), and gets the counts
over the whole corpus back. Counts thus never meet in one place: shards and groups grow in number
with the input, and no table of words is held or broadcast. Two n-grams with one hash, of which
there are about n * n / 2 ** 57 among n, are counted as one.

Nulls: a null text has no words; a document without words has a null score; a null doc_id is scored
and never a target. Repeated rows count, and are scored, each. Documents that share an id are all
targets if the id is. An empty table gives an empty result; without target documents the target
model is the corpus's word frequencies. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import ASKS, Protocol, ask, levels, packed, parts, unpacked
from ._frames import text_bytes
from ._words import WordHashes, mix64, words

#: Weights of the bigram part, the unigram part, and the corpus's word frequencies.
WEIGHTS = (0.6, 0.399, 0.001)
GROUP_BYTES = 8 << 20
LEAST_GROUPS = 32
#: Bits of a key.
WIDTH = 56
#: Keys of the number of words, and of the start of a document as a word.
TOTAL, START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_hashes = WordHashes(b"lm")


def _deal(docs: DataFrame, targets: DataFrame, groups: int) -> DataFrame:
    """Documents, and a row with a null text and mark for each target id, by group."""
    number = F.col("doc_id").cast("long").alias("doc_id")
    own = docs.select(number, F.col("text").cast("binary").alias("text"), F.lit(False).alias("mark"))
    marks = targets.filter("doc_id is not null").select(number, F.lit(None).cast("binary").alias("text"), F.lit(True).alias("mark")).distinct()
    # rows without an id are never targets, so that their text can deal them; ids pass Python as plain numbers
    g = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(groups))
    rows = own.unionByName(marks).select(g.cast("int").alias("g"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text", "mark")
    return rows.repartition(groups, "g")


class _Group:
    """Documents of a group as word numbers of its own, and the keys of its words and bigrams.

    ``key`` holds the sorted distinct keys; ``word``, ``before`` and ``pair`` say where in it those of
    each word's place are.
    """

    def __init__(self, pdf: pd.DataFrame):
        marked = pdf["mark"].to_numpy(dtype=bool)
        self.own = pdf[~marked]
        self.target = (self.own["doc_id"].isin(pdf.loc[marked, "doc_id"]) & self.own["named"]).to_numpy(dtype=bool)
        self.sizes = np.zeros(len(self.own), dtype=np.int64)
        ids: dict[bytes, int] = {}
        parts = [np.empty(0, dtype=np.int64)]
        for i, text in enumerate(self.own["text"]):
            own = words(text)
            self.sizes[i] = len(own)
            parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in own), dtype=np.int64, count=len(own)))
        word = np.concatenate(parts)
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = len(ids)
        hashes = np.append(_hashes.array(list(ids)), START)
        code, pair = np.unique(before * (len(ids) + 1) + word, return_inverse=True)
        pairs = mix64(mix64(hashes[code // (len(ids) + 1)]) * _FACTOR + hashes[code % (len(ids) + 1)])
        every = np.concatenate((hashes, pairs, [TOTAL])) >> np.uint64(64 - WIDTH)
        order = np.argsort(every, kind="stable")
        heads = np.concatenate(([True], every[order][1:] != every[order][:-1]))
        place = np.empty(len(every), dtype=np.int64)
        place[order] = np.cumsum(heads) - 1
        self.key = every[order][heads]
        self.word, self.before, self.pair, self.total = place[word], place[before], place[pair + len(hashes)], int(place[-1])
        self.start = int(place[len(ids)])

    def asked(self) -> dict[str, np.ndarray]:
        """The keys with their counts in all documents, and in targets."""
        out = {"key": self.key}
        for name, docs in (("n", np.ones(len(self.target), dtype=bool)), ("aimed", self.target)):
            at = np.repeat(docs, self.sizes)
            n = np.bincount(self.word[at], minlength=len(self.key)) + np.bincount(self.pair[at], minlength=len(self.key))
            n[self.start] += np.count_nonzero(self.sizes[docs])
            n[self.total] += int(at.sum())
            out[name] = n
        return out


def _summed(pieces: list[dict]) -> dict[str, np.ndarray]:
    key = np.concatenate([p["key"] for p in pieces])
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sums = {c: np.add.reduceat(np.concatenate([p[c] for p in pieces]).astype(np.uint64)[order], heads) for c in ("n", "aimed")}
    return {"key": key[heads], **sums}


def _counts(keys: list[np.ndarray], held: dict) -> list[dict]:
    at = [np.searchsorted(held["key"], k) for k in keys]
    return [{"n": held["n"][i], "aimed": held["aimed"][i]} for i in at]


def _answer(path, pieces, askers):
    return _counts([p["key"] for p in pieces], _summed(pieces))


def _back(pieces, askers, below):
    keys = np.unique(np.concatenate([p["key"] for p in pieces]))
    return _counts([p["key"] for p in pieces], {"key": keys, **below})


COUNTS = Protocol(("key", "n", "aimed"), ("n", "aimed"), _summed, _answer, _back, WIDTH)


def _requests(bits: int):
    def run(key, pdf):
        asked = _Group(pdf).asked()
        rows = [(path, int(key[0]), packed(**{c: a[at] for c, a in asked.items()})) for path, at in parts(asked["key"], bits, WIDTH)]
        return pd.DataFrame(rows, columns=["path", "asker", "body"])

    return run


def _scores(key, pdf, answers):
    group = _Group(pdf)
    some = [unpacked(b, "n", "aimed") for b in answers.sort_values("path")["body"]]
    two, one, base = WEIGHTS
    loss = []
    for c in ("n", "aimed"):
        n = np.concatenate([x[c] for x in some]).astype(np.float64)
        share = n / max(1.0, n[group.total])
        if c == "n":
            common = share
        p = two * n[group.pair] / np.maximum(n, 1)[group.before] + (one * share + base * common)[group.word]
        loss.append(-np.log(p))
    sums = np.concatenate(([0.0], np.cumsum(loss[1] - loss[0])))
    ends = np.cumsum(group.sizes)
    score = (sums[ends] - sums[ends - group.sizes]) / np.maximum(group.sizes, 1)
    return pd.DataFrame({"doc_id": group.own["doc_id"].to_numpy(), "named": group.own["named"].to_numpy(), "n_words": group.sizes, "score": score})


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, score (mean loss difference, lower is nearer to targets).

    targets: (doc_id) of the target documents.
    """
    groups = max(LEAST_GROUPS, -(-text_bytes(docs) // GROUP_BYTES))
    bits = levels(groups)
    dealt = _deal(docs, targets, groups)
    asks = dealt.groupBy("g").applyInPandas(_requests(bits[0]), ASKS)
    answers = ask(asks, bits, COUNTS).withColumn("g", F.col("asker").cast("int"))
    done = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(_scores, "doc_id long, named boolean, n_words long, score double")
    return done.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "n_words", F.when(F.col("n_words") > 0, F.col("score")).alias("score"))
