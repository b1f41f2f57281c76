"""Quality classifier: perplexity under trusted text, words of toxic documents, and repetition.

The perplexity is that of an interpolated modified Kneser-Ney model on UTF-8 bytes.

Training takes the whole text of every trusted document. Counts of 4-grams are sharded over the
cluster; lower orders use continuation counts, and probabilities come from sharded joins of each
order's counts with its context sums and with the order below. The finished model, a sorted table of
grams and one of contexts by order, is broadcast, laid out as a table of contexts and symbols where
that is small. A model of more than ``MOST_GRAMS`` rows is broadcast in slices, one pass over the texts
each: a slice has all grams around some pairs of symbols, a gram's last but two and last but one, which
it shares with all that it backs off to. A text's perplexity is looked up byte by byte, in Arrow
batches, over every whole text; nothing but three measures is kept.

A mean over a text can't see a few bad words in good prose, nor a few words said over and over, so
two local measures stand beside it. ``toxicity`` is the log likelihood ratio of the text's words
between all toxic and all trusted documents of the language: words and word beginnings that occur in
significantly more of the toxic ones bear their log odds, all others the odds of a word that bears
none. A language without toxic documents uses the marks of all together.
``repeats`` is the most words in a window of ``WINDOW`` that equal one of the ``LAG`` before them.

All trusted documents also set the thresholds, each measured by what it didn't teach: they are dealt
over two folds by id, and a second and a third model and set of marks come from the trusted documents
of one fold each, to measure the other fold's. (While one fold is empty, the model of all does it.) A
document is accepted when its perplexity, under the model of all, is no higher than its language's
threshold: the ``QUANTILE`` of the trusted documents of that language, from a full histogram of log
perplexities, times ``SLACK``. A language without such documents uses the threshold of all of them
together. The two local measures are held against the same quantile of the same documents, or against
``LEAST_TOXICITY`` and ``LEAST_REPEATS`` where that is lower.

Nulls: a null lang is a language of its own; a null text, like an empty one, has no perplexity and
is not accepted; a null doc_id is scored but never trusted. Repeated rows get a row each, and rows that
share an id are judged each by its text; a repeated label counts as trusted only if all its rows do.
Ties at the threshold are accepted. Without any trusted document there is no limit on perplexity. An
empty table gives an empty result. Other columns are ignored by :func:`classify` and kept, whatever
their names, by :func:`accepted`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._frames import Scratch, checkpoint, quoted, small_batches, written

ORDER, BITS = 4, 8
ALPHABET = 1 << BITS
#: Stands before a text; no UTF-8 text holds this byte.
START = 0xFF
#: Names of what is learned: from all trusted documents, or, to measure a fold, from those of the other one.
ALL, FOLDS = 2, (0, 1)
#: Most rows of a model that are sent to the driver and broadcast at once; the rest follow in further slices.
MOST_GRAMS = 2_000_000
#: Most ids of labelled documents that are broadcast; with more, documents and ids are shuffled.
MOST_IDS = 2_000_000
#: Characters whose grams are looked up or counted at once.
BLOCK = 1 << 18
#: Largest table that a model is laid out as; a larger one is looked up as it is.
LAID_BYTES = 96 << 20
#: Most languages whose limits are broadcast.
MOST_LANGUAGES = 50_000
QUANTILE = 0.995
#: Room above the quantile, which few documents set where a language is rare.
SLACK = 1.1
#: Histogram steps for a factor of e in perplexity, and for one in the toxicity's likelihood ratio.
STEPS, TOXICITY_STEPS = 1000, 10
LETTERS = re.compile(r"[^\W\d_]+")
#: Word beginnings that may be marks, by length; whole words are, too.
BEGINNINGS = range(3, 9)
#: A mark occurs in this many toxic documents, and at least this share of them.
MARK_DOCS, MARK_SHARE = 3, 1 / 200
#: Least log odds and least likelihood-ratio statistic of a mark.
MARK_ODDS, MARK_TEST = 1.5, 12.0
LEAST_TOXICITY = float(np.log(20))
WINDOW, LAG = 32, 2
LEAST_REPEATS = WINDOW // 4 - 1
#: Units that a worker counts at once, and words that it remembers for each language.
HELD, MEMO_WORDS = 200_000, 50_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of labelled documents of good quality that aren't toxic."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")
    ).filter("q = 1 and t = 0").select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents that any label calls toxic."""
    return labels.filter("doc_id is not null and toxic = 1").select("doc_id").distinct()


def _key() -> Column:
    """Name of a row's language; null is a language of its own."""
    return F.concat(F.lit("="), F.coalesce("lang", F.lit("\0")))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ORDER - 1 start marks; where each text's own begin, and how many they are."""
    pad = bytes([START]) * (ORDER - 1)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(t) for t in raw], dtype=np.int64)
    codes = np.frombuffer(b"".join([pad + t for t in raw]), dtype=np.uint8)
    return codes, np.cumsum(lengths + ORDER - 1) - lengths, lengths


def _grams(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The gram of ORDER symbols that ends at each byte of the texts."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    g = np.zeros(len(at), dtype=np.uint32)
    for j in range(ORDER - 1, -1, -1):
        g <<= np.uint32(BITS)
        g |= codes[at - j]
    return g


def _fold() -> Column:
    """Fold of a trusted document."""
    return F.pmod(F.xxhash64("doc_id", F.lit(len(FOLDS))), F.lit(len(FOLDS))).cast("int")


def _blocks(texts: list) -> Iterator[list[int]]:
    """Places of the texts that aren't empty, some hundred thousand characters at once."""
    some = [i for i, t in enumerate(texts) if t]
    block, size = [], 0
    for pos, i in enumerate(some):
        block.append(i)
        size += len(texts[i])
        if size >= BLOCK or pos == len(some) - 1:
            yield block
            block, size = [], 0


def _gram_counts(texts: DataFrame) -> DataFrame:
    """texts: (fold, text) -> fold, g, c."""

    def grams(batches):
        for pdf in batches:
            for fold, own in pdf.groupby("fold")["text"]:
                own = own.tolist()
                for block in _blocks(own):
                    found, n = np.unique(_grams(*_codes([own[i] for i in block])), return_counts=True)
                    yield pd.DataFrame({"fold": np.int32(fold), "g": found.astype(np.int64), "c": n})

    return texts.mapInPandas(grams, "fold int, g long, c long").groupBy("fold", "g").agg(F.sum("c").alias("c"))


def _orders(counts: DataFrame) -> DataFrame:
    """counts: (part, g, c) of grams of ORDER symbols -> part, k, g, c: those, and of the shorter ones how many symbols come before each."""
    low = lambda g, k: g.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k * BITS) - 1)
    ends = [F.struct(F.lit(k).alias("k"), low(F.col("g"), F.lit(k + 1)).alias("longer")) for k in range(1, ORDER)]
    longer = counts.select("part", F.explode(F.array(*ends)).alias("end")).select("part", "end.*").distinct()
    shorter = longer.groupBy("part", "k", low(F.col("longer"), F.col("k")).alias("g")).agg(F.count("*").alias("c"))
    return counts.select("part", F.lit(ORDER).alias("k"), "g", "c").unionByName(shorter)


def _trained(scratch: Scratch, counts: DataFrame) -> DataFrame:
    """counts: (part, g, c) of grams of ORDER symbols, which are read twice -> part, k, pair, g, value: models by part, written.

    For each order k the probabilities of grams, and at -k the back-off weights of contexts; ``pair``:
    the two symbols before a gram's last one, 0 below order 3. Counts, discounts and context sums of
    all orders come from one query each: the driver keeps threads and plans of every query for a while,
    which small tables, whose queries follow each other fast, add up to more than their rows.
    """
    with Scratch(scratch.spark) as steps:
        counted = steps.written(_orders(counts))
        # a row for each part and order
        found = counted.groupBy("part", "k").agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).collect()
        off = F.lit(None).cast("double")
        for part, k, *n in found:
            one, two, more = discounts(n)
            own = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
            off = F.when((F.col("part") == part) & (F.col("k") == k), own).otherwise(off)
        context = F.call_function("shiftright", F.col("g"), F.lit(BITS)).alias("ctx")
        sums = counted.groupBy("part", "k", context).agg(F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("back"))
        sums = steps.written(sums)
        last = F.lit((1 << 2 * BITS) - 1)
        pair = lambda c: F.when(F.col("k") > 2, c.bitwiseAND(last)).otherwise(0).cast("int").alias("pair")
        rows, lower = [sums.select("part", (-F.col("k")).alias("k"), pair(F.col("ctx")), F.col("ctx").alias("g"), F.col("back").alias("value"))], None
        for k in range(1, ORDER + 1):
            own, over = (t.filter(F.col("k") == k) for t in (counted, sums))
            joined = own.select("part", "k", "g", "c", off.alias("off"), context).join(over.drop("k"), ["part", "ctx"])
            joined = joined.withColumn("own", (F.col("c") - F.col("off")) / F.col("total"))
            if lower is None:
                joined = joined.withColumn("below", F.lit(1.0 / ALPHABET))
            else:
                suffix = F.col("g").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))
                joined = joined.withColumn("suffix", suffix).join(
                    lower.select("part", F.col("g").alias("suffix"), F.col("p").alias("below")), ["part", "suffix"]
                )
            lower = steps.written(joined.select("part", "k", "g", (F.col("own") + F.col("back") * F.col("below")).alias("p")))
            rows.append(lower.select("part", "k", pair(context), "g", F.col("p").alias("value")))
        return scratch.written(reduce(DataFrame.unionByName, rows))


def _slices(rows: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """For each part, ranges of pairs with at most MOST_GRAMS rows, or one pair, each."""
    out: dict[int, list[tuple[int, int]]] = {}
    # at most 65,536 pairs a part
    sizes = rows.groupBy("part", "pair").agg(F.count("*").alias("n")).toArrow().to_pandas()
    for part, own in sizes.groupby("part"):
        own = own.sort_values("pair")
        starts, held = [0], 0
        for pair, n in zip(own["pair"].tolist(), own["n"].tolist(), strict=True):
            if held and held + n > MOST_GRAMS:
                starts.append(pair)
                held = 0
            held += n
        out[int(part)] = list(zip(starts, [*starts[1:], 1 << 2 * BITS], strict=True))
    return out


def _slice(rows: DataFrame, part: int, pairs: tuple[int, int]) -> dict:
    """A part's model as far as the range of pairs goes.

    ``p[k]``: (grams of k symbols, probabilities), ``back[k]``: (contexts, weights of the order below);
    grams as integers of BITS bits a symbol, sorted.
    """
    mine = (F.col("pair") >= pairs[0]) & (F.col("pair") < pairs[1]) | F.col("k").between(-2, 2)
    found = rows.filter((F.col("part") == part) & mine).select("k", "g", "value").toArrow()
    k, g, value = (found[c].to_numpy() for c in ("k", "g", "value"))
    model = {"p": {}, "back": {}, "pairs": pairs}
    for name, sign in (("p", 1), ("back", -1)):
        for i in range(1, ORDER + 1):
            at = np.flatnonzero(k == sign * i)
            at = at[np.argsort(g[at])]
            model[name][i] = (g[at].astype(np.uint32), value[at].astype(np.float64))
    return model


def train(texts: DataFrame) -> dict:
    """texts: (text) -> the model of them all, in one slice."""
    with Scratch(texts.sparkSession) as scratch:
        counts = _gram_counts(texts.select(F.lit(ALL).alias("fold"), "text")).withColumnRenamed("fold", "part")
        return _slice(_trained(scratch, scratch.written(counts)), ALL, (0, 1 << 2 * BITS))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from counts of counts 1..4."""
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in range(3)]
    return [float(min(max(d, 0.05), i + 0.95)) for i, d in enumerate(raw)]


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there) of each key."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def probabilities(grams: np.ndarray, model: dict, order: int = ORDER) -> np.ndarray:
    """Probability of the last symbol of each gram of ``order`` symbols after the others."""
    out = np.zeros(len(grams))
    weight = np.ones(len(grams))
    left = np.arange(len(grams))
    for k in range(order, 0, -1):
        own = grams[left] & np.uint32((1 << (BITS * k)) - 1)
        at, known = _found(model["p"][k][0], own)
        out[left[known]] = weight[known] * model["p"][k][1][at[known]]
        left, weight, own = left[~known], weight[~known], own[~known]
        if not len(left):
            return out
        # a context that wasn't seen gives all its weight to the one without its first symbol
        at, known = _found(model["back"][k][0], own >> np.uint32(BITS))
        weight = weight * np.where(known, model["back"][k][1][at] if len(model["back"][k][1]) else 1.0, 1.0)
    out[left] = weight / ALPHABET
    return out


class Laid:
    """The model as a table: context -> row, row and symbol -> log probability.

    Bytes that the sample doesn't have are one symbol here, as they are equally likely everywhere.
    """

    def __init__(self, model: dict):
        seen = sorted({START, *model["p"][1][0].tolist()})
        rest = [b for b in range(ALPHABET) if b not in seen][:1]
        self.symbol = np.full(ALPHABET, len(seen), dtype=np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.bits = (len(seen) + len(rest) - 1).bit_length() or 1
        stands = np.array([*seen, *rest], dtype=np.uint32)
        n, self.row_of = 0, np.zeros(1, dtype=np.int32)
        self.logs = np.empty((1 + sum(len(model["back"][k + 1][0]) for k in range(1, ORDER)), len(stands)))
        for k in range(ORDER):
            contexts = model["back"][k + 1][0] if k else np.zeros(1, dtype=np.uint32)
            # some grams at once, as what stands beside their probabilities takes several times their room
            step = max(1, BLOCK // len(stands))
            for first in range(0, len(contexts), step):
                some = contexts[first : first + step]
                grams = ((some[:, None] << np.uint32(BITS)) | stands[None, :]).ravel()
                logs = np.log(probabilities(grams, model, k + 1))
                self.logs[n + first : n + first + len(some)] = logs.reshape(len(some), len(stands))
            at = np.zeros(len(contexts), dtype=np.int64)
            for j in range(k):
                at |= self.symbol[(contexts >> np.uint32(BITS * j)) & np.uint32(ALPHABET - 1)].astype(np.int64) << (self.bits * j)
            # an unseen context stands for the one without its first symbol
            self.row_of = np.tile(self.row_of, 1 << self.bits if k else 1)
            self.row_of[at] = n + np.arange(len(contexts), dtype=np.int32)
            n += len(contexts)

    @staticmethod
    def size(model: dict) -> int:
        """Bytes of the table."""
        symbols = len(model["p"][1][0]) + 2
        return (4 << (symbols.bit_length() * (ORDER - 1))) + 8 * symbols * sum(len(model["back"][k][0]) for k in model["back"])

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Of each byte of texts after the ones before it; of the start marks any."""
        symbols = self.symbol[codes]
        context = np.zeros(len(symbols), dtype=np.int32)
        for j in range(1, ORDER):
            context[j:] |= symbols[:-j] << (self.bits * (j - 1))
        return self.logs[self.row_of[context], symbols]


class Sparse:
    """The model as it was trained, for one whose table would be too large, or a slice of it: other grams count nothing."""

    def __init__(self, model: dict):
        self.model = model

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        g = np.zeros(len(codes), dtype=np.uint32)
        for j in range(ORDER - 1, -1, -1):
            g <<= np.uint32(BITS)
            g[j:] |= codes[: len(codes) - j]
        found, back = np.unique(g, return_inverse=True)
        pair = (found >> np.uint32(BITS)) & np.uint32((1 << 2 * BITS) - 1)
        mine = (pair >= self.model["pairs"][0]) & (pair < self.model["pairs"][1])
        logs = np.zeros(len(found))
        logs[mine] = np.log(probabilities(found[mine], self.model))
        return logs[back]


def laid(model: dict) -> Laid | Sparse:
    """Both forms give the same probabilities; a slice of several isn't laid out."""
    whole = model["pairs"] == (0, 1 << 2 * BITS)
    return Laid(model) if whole and Laid.size(model) <= LAID_BYTES else Sparse(model)


def _log_sums(texts: list, form: Laid | Sparse) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text, and its bytes; NaN and 0 without one."""
    out, sizes = np.full(len(texts), np.nan), np.zeros(len(texts), dtype=np.int64)
    for block in _blocks(texts):
        codes, starts, lengths = _codes([texts[j] for j in block])
        sums = np.concatenate(([0.0], np.cumsum(form.log_probabilities(codes))))
        out[block], sizes[block] = sums[starts + lengths] - sums[starts], lengths
    return out, sizes


@cache
def _letters() -> np.ndarray:
    """Each code point, or a blank if it is no letter."""
    points = np.arange(0x110000, dtype=np.uint32)
    table = np.full(len(points), ord(" "), dtype=np.uint32)
    for run in LETTERS.finditer(points.tobytes().decode("utf-32-le", "surrogatepass")):
        table[run.start() : run.end()] = points[run.start() : run.end()]
    return table


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters: what LETTERS finds, which takes several times as long."""
    if not text:
        return []
    low, table = text.lower(), _letters()
    parts = (low[i : i + BLOCK].encode("utf-32-le", "surrogatepass") for i in range(0, len(low), BLOCK))
    return "".join([table[np.frombuffer(part, dtype=np.uint32)].tobytes().decode("utf-32-le") for part in parts]).split()


def _units(word: str) -> list[str]:
    """Beginnings of a word, and the whole word with an end mark."""
    return [word[:k] for k in BEGINNINGS if k <= len(word)] + [word + "$"]


class Numbers(dict):
    """word -> its number, from 0 in the order of first use; ``new``: words since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Noted:
    """Words by number, and a row of what is known of each, so that it is found out once and looked up by array."""

    def __init__(self, width: int, dtype):
        self.number, self.rows = Numbers(), np.zeros((1024, width), dtype=dtype)

    def full(self) -> bool:
        return len(self.number) >= MEMO_WORDS

    def forget(self) -> None:
        self.number.clear()

    def numbers(self, words: list[str], rows: Callable[[list[str]], list]) -> np.ndarray:
        """Numbers of the words; ``rows``: what is known of new ones."""
        at = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        if new := self.number.new:
            n = len(self.number)
            self.rows = _room(self.rows, n)
            self.rows[n - len(new) : n] = np.array(rows(new), dtype=self.rows.dtype).reshape(len(new), -1)
            new.clear()
        return at


def _room(table: np.ndarray, n: int) -> np.ndarray:
    """The table with at least ``n`` rows; new ones are zero."""
    if n <= len(table):
        return table
    return np.concatenate([table, np.zeros((max(n, 2 * len(table)) - len(table), *table.shape[1:]), dtype=table.dtype)])


def _distinct(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The different numbers in ``at``; ``place`` has a cell for each possible one, whatever is in it."""
    order = np.arange(len(at))
    place[at] = order
    return at[place[at] == order]


def most_repeats(words: list[str] | np.ndarray) -> int:
    """Most words, or numbers of words, in a window that equal one of the LAG before them."""
    n = len(words)
    if not isinstance(words, np.ndarray):
        words = np.fromiter(map(Numbers().__getitem__, words), dtype=np.int64, count=n)
    hit = np.zeros(n + 1, dtype=np.int64)
    for k in range(1, min(LAG, n - 1) + 1):
        hit[k + 1 :] |= words[k:] == words[:-k]
    upto = np.cumsum(hit)
    size = min(WINDOW, n)
    return int((upto[size:] - upto[: n + 1 - size]).max())


def _heads(units) -> set[str]:
    """The first three letters of all words that can have one of the units; fewer letters are whole words."""
    return {u[:3] for u in units} | {u[:-1] for u in units if u.endswith("$") and len(u) <= 3}


class Marks:
    """Log odds of one language's marks, and of a word without any."""

    def __init__(self, weights: dict[str, float], rest: float = 0.0):
        self.weights, self.rest = weights, rest
        self.heads = _heads(weights)
        self.noted = Noted(1, np.float64)

    def word(self, word: str) -> float:
        """Log odds of the word's strongest mark; 0 without one."""
        return max(self.weights.get(u, 0.0) for u in _units(word))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words as numbers, which hold until the next call."""
        if self.noted.full():
            self.noted.forget()
        return self.noted.numbers(words, lambda new: [self.word(w) if w[:3] in self.heads else 0.0 for w in new])

    def total(self, numbers: np.ndarray) -> float:
        if not self.weights:
            return 0.0
        odds = self.noted.rows[numbers, 0]
        return float(odds.sum() + self.rest * (len(odds) - np.count_nonzero(odds)))

    def text(self, words: list[str]) -> float:
        return self.total(self.numbers(words))


class UnitCounts:
    """Units of one language's words by fold, in occurrences and documents; unit 0, '', counts all words."""

    def __init__(self, wanted: set[str] | None):
        self.wanted = wanted
        self.unit, self.start = {"": 0}, {"": 0}
        # a word's start and, as a unit, the whole of it; a start's units; 0 where there is none
        self.noted, self.of_start = Noted(2, np.int32), np.zeros((1024, len(BEGINNINGS)), dtype=np.int32)
        self.times, self.docs = (np.zeros((1024, len(FOLDS)), dtype=np.int64) for _ in range(2))
        self.places = [np.zeros(1024, dtype=np.int64) for _ in range(3)]
        # words whose units' occurrences aren't counted yet
        self.waiting: list[list[np.ndarray]] = [[] for _ in FOLDS]
        self.held = 0

    def _rows(self, words: list[str]) -> list[tuple[int, int]]:
        out, longest, wanted, unit = [], BEGINNINGS[-1], self.wanted, self.unit
        for word in words:
            start, whole = word[:longest], word + "$"
            at = self.start.get(start)
            if at is None:
                at = self._started(start)
            out.append((at, unit.setdefault(whole, len(unit)) if wanted is None or whole in wanted else 0))
        return out

    def _started(self, start: str) -> int:
        """Number of the longest wanted beginning of a word's start, whose units are those of the start."""
        wanted, least = self.wanted, BEGINNINGS[0]
        while len(start) >= least and wanted is not None and start not in wanted:
            start = start[:-1]
        start = start if len(start) >= least else ""
        at = self.start.get(start)
        if at is None:
            at = self.start[start] = len(self.start)
            begin = [start[:k] for k in BEGINNINGS if k <= len(start)]
            own = [self.unit.setdefault(u, len(self.unit)) for u in begin if wanted is None or u in wanted]
            self.of_start = _room(self.of_start, at + 1)
            self.of_start[at, : len(own)] = own
        return at

    def add(self, fold: int, words: list[str]) -> None:
        """Counts a document."""
        if self.noted.full() or self.held >= BLOCK:
            self._settle()
        at = self.noted.numbers(words, self._rows)
        self.times, self.docs = (_room(t, len(self.unit)) for t in (self.times, self.docs))
        sizes = len(self.noted.number), len(self.start), len(self.unit)
        self.places = [_room(place, n) for place, n in zip(self.places, sizes, strict=True)]
        rows = self.noted.rows[_distinct(at, self.places[0])]
        starts, whole = _distinct(rows[:, 0], self.places[1]), rows[:, 1]
        for units in (_distinct(self.of_start[starts].ravel(), self.places[2]), whole):
            self.docs[units[units > 0], fold] += 1
        self.docs[0, fold] += 1
        self.times[0, fold] += len(at)
        self.waiting[fold].append(at)
        self.held += len(at)

    def _settle(self) -> None:
        for fold, waiting in enumerate(self.waiting):
            if waiting:
                n = np.bincount(np.concatenate(waiting))
                rows = self.noted.rows[: len(n)]
                starts = np.bincount(rows[:, 0], n, len(self.start))
                times = np.bincount(rows[:, 1], n, len(self.unit))
                times += np.bincount(self.of_start[: len(starts)].ravel(), np.repeat(starts, len(BEGINNINGS)), len(self.unit))
                self.times[1 : len(times), fold] += times[1:].astype(np.int64)
                waiting.clear()
        self.held = 0
        if self.noted.full():
            self.noted.forget()

    def rows(self, key: str) -> pd.DataFrame:
        self._settle()
        n = len(self.unit)
        counts = {f"{name}{f}": table[:n, f] for f in range(len(FOLDS)) for name, table in (("times", self.times), ("docs", self.docs))}
        return pd.DataFrame({"key": key, "unit": list(self.unit), **counts})


#: What UnitCounts counts.
COUNTS = [f"{name}{f}" for f in range(len(FOLDS)) for name in ("times", "docs")]


def _count_units(wanted):
    """Counts of words' units by language, a column for each fold. ``wanted``: broadcast units by language, or None for all."""

    def run(batches):
        counts: dict[str, UnitCounts] = {}
        held = 0
        for pdf in batches:
            for fold, key, text in zip(pdf["fold"], pdf["key"], pdf["text"], strict=True):
                if not (words := letter_words(text)):
                    continue
                if key not in counts:
                    counts[key] = UnitCounts(None if wanted is None else wanted.value.get(key, set()) | wanted.value.get("all", set()))
                own = counts[key]
                held -= len(own.unit)
                own.add(fold, words)
                held += len(own.unit)
                if held >= HELD:
                    yield from (own.rows(key) for key, own in counts.items())
                    counts.clear()
                    held = 0
        yield from (own.rows(key) for key, own in counts.items())

    return run


def _unit_counts(texts: DataFrame, wanted=None) -> DataFrame:
    """texts: (fold, key, text) -> key, unit and COUNTS, by language and for ``all``; a document has one language."""
    sums = [F.sum(c).alias(c) for c in COUNTS]
    rows = texts.mapInPandas(_count_units(wanted), ", ".join(["key string", "unit string", *[f"{c} long" for c in COUNTS]]))
    own = rows.groupBy("key", "unit").agg(*sums)
    return own.withColumn("key", F.explode(F.array("key", F.lit("all")))).groupBy("key", "unit").agg(*sums)


def _of_parts(counts: DataFrame) -> DataFrame:
    """key, unit and COUNTS -> part, key, unit, times, docs: a fold's count for all and for the other one."""
    of = {ALL: lambda c: F.col(f"{c}0") + F.col(f"{c}1"), **{1 - f: lambda c, f=f: F.col(f"{c}{f}") for f in FOLDS}}
    parts = [F.struct(F.lit(part).alias("part"), n("times").alias("times"), n("docs").alias("docs")) for part, n in of.items()]
    return counts.select("key", "unit", F.explode(F.array(*parts)).alias("of")).select("of.part", "key", "unit", "of.times", "of.docs")


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    """Of ``k`` hits in ``n`` at a rate of ``p``."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(k < n, (n - k) * F.log(1 - p)).otherwise(0.0)


class Bits:
    """For each word a bit for each of some marks that it bears one of, counted."""

    def __init__(self, marks: list[Marks]):
        self.of: dict[str, int] = {}
        for i, m in enumerate(marks):
            for u in m.weights:
                self.of[u] = self.of.get(u, 0) | 1 << i
        self.heads, self.size, self.noted = _heads(self.of), 1 << len(marks), Noted(1, np.uint8)

    def _rows(self, words: list[str]) -> list[int]:
        return [reduce(int.__or__, [self.of.get(u, 0) for u in _units(w)]) for w in words]

    def counts(self, words: list[str]) -> np.ndarray:
        """How many of the words bear each set of bits."""
        if self.noted.full():
            self.noted.forget()
        some = [w for w in words if w[:3] in self.heads]
        # before rows are read, which new words add to
        at = self.noted.numbers(some, self._rows)
        n = np.bincount(self.noted.rows[at, 0], minlength=self.size)
        n[0] += len(words) - len(some)
        return n


def train_marks(taught: DataFrame) -> dict[int, dict[str, Marks]]:
    """taught: (key, bad, fold, text) of toxic (bad) and trusted documents -> by part, marks by language, and of ``all``.

    Toxic documents teach every part, trusted ones of a fold that of all and that of the other fold.
    """
    sc = taught.sparkSession.sparkContext
    parts = [ALL, *FOLDS]
    texts = {b: taught.filter(F.col("bad") == b).select(F.lit(0).alias("fold") if b else "fold", "key", "text") for b in (True, False)}
    counted = checkpoint(_unit_counts(texts[True]).select("key", "unit", F.col("times0").alias("times"), F.col("docs0").alias("docs")))
    # a row a language
    sizes = counted.filter("unit = ''").select("key", F.col("times").alias("words"), F.col("docs").alias("n_docs"))
    weights: dict[int, dict[str, dict[str, float]]] = {part: {} for part in parts}
    for r in sizes.collect():
        for part in parts:
            weights[part][r["key"]] = {}
    if not weights[ALL]:
        return {part: {} for part in parts}
    # of units that too few toxic documents have, none can be a mark; of a language with many, at most
    # 1 / MARK_SHARE times those of a document are left
    often = counted.filter("unit <> ''").join(F.broadcast(sizes), "key")
    often = checkpoint(often.filter(F.col("docs") >= F.greatest(F.lit(MARK_DOCS), F.col("n_docs") * MARK_SHARE)))
    wanted: dict[str, set[str]] = {}
    for key, unit in often.select("key", "unit").toPandas().itertuples(index=False, name=None):
        wanted.setdefault(key, set()).add(unit)
    good = _of_parts(checkpoint(_unit_counts(texts[False], sc.broadcast(wanted))))
    good_sizes = good.filter("unit = ''").select("part", "key", F.col("times").alias("good_words"), F.col("docs").alias("good_docs"))
    both = often.withColumn("part", F.explode(F.array(*[F.lit(part) for part in parts])))
    both = both.join(good.select("part", "key", "unit", F.col("times").alias("good_times"), F.col("docs").alias("good_in")), ["part", "key", "unit"], "left")
    both = both.join(F.broadcast(good_sizes), ["part", "key"], "left").fillna(0)
    n, docs, n_docs, good_in, good_docs = (F.col(c) for c in ("times", "docs", "n_docs", "good_in", "good_docs"))
    odds = F.log((n + 0.5) / (F.col("words") + 1)) - F.log((F.col("good_times") + 0.5) / (F.col("good_words") + 1))
    rate = (docs + good_in) / (n_docs + good_docs)
    apart = _log_likelihood(docs, n_docs, docs / n_docs) + F.when(good_docs > 0, _log_likelihood(good_in, good_docs, F.try_divide(good_in, good_docs))).otherwise(0.0)
    test = 2 * (apart - _log_likelihood(docs, n_docs, rate) - _log_likelihood(good_in, good_docs, rate))
    found = both.select("part", "key", "unit", odds.alias("odds"), test.alias("test")).filter((F.col("odds") >= MARK_ODDS) & (F.col("test") >= MARK_TEST))
    for part, key, unit, weight in found.drop("test").toPandas().itertuples(index=False, name=None):
        weights[part][key][unit] = float(weight)
    held = sc.broadcast({part: {key: Marks(w) for key, w in own.items()} for part, own in weights.items()})

    def marked(batches):
        tables: dict[str, tuple[list, Bits]] = {}
        for pdf in batches:
            sums = {}
            for own, is_bad, fold, text in zip(pdf["key"], pdf["bad"], pdf["fold"], pdf["text"], strict=True):
                if own not in tables:
                    names = [(part, key) for part in parts for key in (own, "all") if key in held.value[part]]
                    tables[own] = names, Bits([held.value[part][key] for part, key in names])
                n = tables[own][1].counts(letter_words(text))
                sums[own, bool(is_bad), fold] = sums.get((own, bool(is_bad), fold), 0) + n
            out = Counter()
            for (own, is_bad, fold), n in sums.items():
                for bit, (part, key) in enumerate(tables[own][0]):
                    if is_bad or part in (ALL, 1 - fold):
                        out[part, key, is_bad, "n"] += int(n.sum())
                        out[part, key, is_bad, "marked"] += int(n[np.arange(len(n)) >> bit & 1 == 1].sum())
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["part", "key", "bad", "what", "n"])

    rows = taught.select("key", "bad", "fold", "text").mapInPandas(marked, "part int, key string, bad boolean, what string, n long")
    rows = rows.groupBy("part", "key", "bad", "what").agg(F.sum("n").alias("n")).collect()
    n = {(r["part"], r["key"], r["bad"], r["what"]): r["n"] for r in rows}
    rate = lambda *key: (n.get((*key, "marked"), 0) + 0.5) / (n.get((*key, "n"), 0) + 1)
    rest = lambda part, key: float(np.log1p(-rate(part, key, True)) - np.log1p(-rate(part, key, False)))
    return {part: {key: Marks(w, rest(part, key)) for key, w in own.items()} for part, own in weights.items()}


def perplexity(docs: DataFrame, model: dict) -> DataFrame:
    """docs: (doc_id, lang, text) -> doc_id, lang, perplexity (of a byte; null without text)."""
    m = _measured(docs, model, {})
    return docs.select("doc_id", "lang", m("lang", "text", F.lit(0.0))["perplexity"].alias("perplexity"))


def _added(docs: DataFrame, model: dict):
    """A function of (text, log probability by other slices) columns: the sum with this one's."""
    held = docs.sparkSession.sparkContext.broadcast(laid(model))

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, logs in batches:
            yield logs + np.nan_to_num(_log_sums(texts.tolist(), held.value)[0])

    return run


def _sliced(scratch: Scratch, docs: DataFrame, models: Callable[[tuple[int, int]], dict], slices: list[tuple[int, int]]) -> DataFrame:
    """docs with ``_judged_logs``: the log probability of the text by all slices but the last, which :func:`_measured` adds."""
    docs = docs.withColumn("_judged_logs", F.lit(0.0))
    for pairs in slices[:-1]:
        run = _added(docs, models(pairs))
        before, docs = docs, scratch.written(docs.withColumn("_judged_logs", run("text", "_judged_logs")))
        scratch.drop(before)
    return docs


def _measured(docs: DataFrame, model: dict, marks: dict[str, Marks]):
    """A function of (lang, text, log probability by other slices) columns: a struct of perplexity (null without text), toxicity and repeats."""
    held = docs.sparkSession.sparkContext.broadcast((laid(model), marks))

    @F.pandas_udf("perplexity double, toxicity double, repeats long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        form, marks = held.value
        other = marks.get("all", Marks({}))
        for langs, texts, logs in batches:
            texts = texts.tolist()
            sums, sizes = _log_sums(texts, form)
            out = np.exp(-(sums + logs.to_numpy()) / np.maximum(sizes, 1))
            toxicity, repeats = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
                words = letter_words(text)
                if words:
                    own = marks.get("=" + ("\0" if lang is None else lang), other)
                    numbers = own.numbers(words)
                    toxicity[i], repeats[i] = own.total(numbers), most_repeats(numbers)
            perplexity = pd.Series(out).astype("Float64").where(~np.isnan(out))
            yield pd.DataFrame({"perplexity": perplexity, "toxicity": toxicity, "repeats": repeats})

    return run


def _limits(scored: DataFrame, names: list[str], quantile: float) -> DataFrame:
    """scored: (lang, ..) -> key and limits: the least step of each measure that ``quantile`` of the rows reach, by language and for ``all``."""
    steps = {
        "threshold": F.floor(F.log("perplexity") * STEPS),
        "most_toxic": F.floor(F.col("toxicity") * TOXICITY_STEPS),
        "most_repeats": F.col("repeats"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), steps[n].cast("long").alias("step")) for n in names]))
    hist = scored.select(_key().alias("own"), each.alias("at")).filter("at.step is not null")
    hist = hist.select(F.explode(F.array("own", F.lit("all"))).alias("key"), "at.*")
    hist = hist.groupBy("key", "name", "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("key", "name")
    upto = hist.withColumn("upto", F.sum("n").over(w.orderBy("step"))).withColumn("total", F.sum("n").over(w))
    least = [F.min(F.when(F.col("name") == n, F.col("step"))).alias(n) for n in names]
    reached = upto.filter(F.col("upto") >= F.lit(quantile) * F.col("total")).groupBy("key").agg(*least).dropna(subset=names)
    limits = {
        "threshold": F.exp((F.col("threshold") + 1) / STEPS),
        "most_toxic": F.greatest(F.lit(LEAST_TOXICITY), (F.col("most_toxic") + 1) / TOXICITY_STEPS),
        "most_repeats": F.greatest(F.lit(LEAST_REPEATS), "most_repeats"),
    }
    return reached.select("key", *[limits[n].alias(n) for n in names])


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """scored: (lang, perplexity) of all trusted documents -> key, threshold; key ``all`` for any language."""
    return _limits(scored, ["threshold"], quantile)


def local_limits(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """scored: (lang, perplexity, toxicity, repeats) of all trusted documents -> key, most_toxic, most_repeats."""
    return _limits(scored.filter("perplexity is not null"), ["most_toxic", "most_repeats"], quantile)


def _taught(docs: DataFrame, labels: DataFrame, train_bytes: int | None) -> DataFrame:
    """(key, lang, bad, fold, text) of every trusted and every toxic (bad) document; ``train_bytes``: see :func:`classify`."""
    rows = docs.filter("doc_id is not null and text is not null")
    ids = trusted_ids(labels).withColumn("bad", F.lit(False)).unionByName(toxic_ids(labels).withColumn("bad", F.lit(True)))
    ids = checkpoint(ids)
    small = ids.count() <= MOST_IDS
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(ids) if small else ids, "doc_id")
    if train_bytes is not None:
        upto = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("bad").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
        rows = rows.withColumn("upto", upto).filter(F.col("upto") <= train_bytes)
    return rows.select(_key().alias("key"), "lang", "bad", _fold().alias("fold"), "text")


def _judged(docs: DataFrame, columns: list[Column], labels: DataFrame, train_bytes: int | None, quantile: float, slack: float) -> DataFrame:
    """docs with doc_id, lang, text -> ``columns`` and judged: perplexity, threshold, toxicity, repeats, accepted."""
    # texts go to Python in small batches; whole rows are written, so that they are neither scored twice nor looked up again
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession):
        taught = scratch.written(_taught(docs, labels, train_bytes))
        trusted = taught.filter("not bad")
        by_fold = scratch.written(_gram_counts(trusted.select("fold", "text")))
        of_all = by_fold.groupBy("g").agg(F.sum("c").alias("c")).withColumn("part", F.lit(ALL))
        counts = by_fold.select("g", "c", (1 - F.col("fold")).alias("part")).unionByName(of_all)
        rows = _trained(scratch, counts)
        slices, marks = _slices(rows), train_marks(taught)

        def measured(some: DataFrame, part: int, *cols: Column) -> DataFrame:
            """``cols`` of the rows, and what the part's model and marks make of their texts."""
            model, ranges = partial(_slice, rows, part), slices.get(part, [(0, 1 << 2 * BITS)])
            some = _sliced(scratch, some, model, ranges)
            run = _measured(some, model(ranges[-1]), marks[part])
            return some.select(*cols, run("lang", "text", "_judged_logs").alias("_judged"))

        held_out = [
            measured(trusted.filter(F.col("fold") == fold), fold if fold in slices else ALL, F.col("lang")) for fold in FOLDS
        ]
        held_out = scratch.written(reduce(DataFrame.unionByName, held_out)).select("lang", "_judged.*")
        # those of thresholds() and local_limits()
        limits = _limits(held_out.filter("perplexity is not null"), ["threshold", "most_toxic", "most_repeats"], quantile)
        limits = checkpoint(limits.withColumnRenamed("key", "_judged_key"))
        scored = written(measured(docs, ALL, *columns, F.col("lang").alias("_judged_lang")))
    every = limits.filter("_judged_key = 'all'").first()
    other = every.asDict() if every else dict.fromkeys(("threshold", "most_toxic", "most_repeats"), float("inf"))
    limit = lambda c: F.coalesce(F.col(c), F.lit(other[c]))
    m, most = (lambda c: F.col(f"_judged.{c}")), limit("threshold") * slack
    good = (m("perplexity") <= most) & (m("toxicity") <= limit("most_toxic")) & (m("repeats") <= limit("most_repeats"))
    judged = F.struct(
        m("perplexity").alias("perplexity"), most.alias("threshold"), m("toxicity").alias("toxicity"), m("repeats").alias("repeats"),
        F.coalesce(good, F.lit(False)).alias("accepted"),
    )
    key = F.concat(F.lit("="), F.coalesce("_judged_lang", F.lit("\0")))
    # one row a language of the trusted documents; without a broadcast all texts of a language would meet
    limits = F.broadcast(limits) if limits.count() <= MOST_LANGUAGES else limits
    return scored.join(limits, key == F.col("_judged_key"), "left").select(*[c for c in scored.columns if not c.startswith("_judged")], judged.alias("_judged"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, train_bytes: int | None = None) -> DataFrame:
    """One row a document: doc_id, lang, perplexity, threshold, toxicity, repeats, accepted.

    Every trusted and toxic document teaches, unless a caller sets ``train_bytes``, the most bytes of either kind.
    """
    plain = _plain(docs)
    done = _judged(plain, [F.col("doc_id"), F.col("lang")], labels, train_bytes, quantile, slack)
    return done.select("doc_id", "lang", "_judged.*")


def _plain(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *more)


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, train_bytes: int | None = None) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    read = ("doc_id", "lang", "text")
    names = {c: c.lower() if c.lower() in read else f"c{i}" for i, c in enumerate(docs.columns)}
    more = [F.col(quoted(c)).alias(n) for c, n in names.items() if n not in read]
    done = _judged(_plain(docs, *more), [F.col(n) for n in names.values()], labels, train_bytes, quantile, slack)
    return done.filter("_judged.accepted").select(*[F.col(n).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()])
