"""MinHash near-dedup on SetSketch registers.

Each document's set holds its distinct shingles of ``k`` words. Every register is a truncated,
exponentially spaced minimum: with h the least exponential hash of the set, K = floor(1 - log_b h),
kept within 0..q+1. Registers of a union are register-wise maxima, and equal registers are about as
likely as the sets are similar, so bands of register values find candidates. With BANDS bands of ROWS
registers a pair at the threshold 0.8 is missed with probability below 1e-6.

Candidates are verified: the joint likelihood of the registers (counts of larger, smaller and equal
ones, and both set sizes) gives an estimate, pairs far below the threshold go (6 standard errors, so
none above it is lost), the others are compared on their full sets of words.

Equal texts (but for the case of A-Z) are one node from the start, named by a number of its own, and
buckets with the same nodes are one. Then (1) each node is compared to one other, the heaviest of all its
buckets, which shares most buckets with most nodes, and so joins most of a large group; (2) in buckets whose nodes are still apart, registers of
nodes of different components are held against each other, in cells of two blocks; only which nodes
came near and the components thus connected leave a cell, never pairs; (3) connected components
make families, and near nodes of a family that are of different components are compared on their
full sets, in cells again: each text goes once to each block that it is to meet, and a cell gives out
no more links than join what it holds. The largest component's nodes aren't compared with each
other, so a group that step 1 has joined costs no more than its distance to the rest. Any two nodes
that share a bucket are thus in one component, or ruled out by their registers, or compared.

Nulls: a null text or a text without words has an empty set and is linked with nothing; a row with a
null doc_id is a document like others, its id comes after all others, and a group of such rows has a
null component. Documents with fewer than ``k`` words have one shingle, all their words. Repeated rows
are one node and get a row each. Documents that share a doc_id but not the text are nodes of their
own. An empty table gives an empty result. Other columns are ignored by :func:`clusters` and kept by
:func:`survivors`, where of a group's rows that agree in doc_id and text any one stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._frames import Scratch, by_salted_key, free_name, lower_az, quoted, salt_bits, salt_of, small_batches, written
from ._words import mix64
from .components import components

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate, and the limit of 16-bit registers.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Most rows of a block, in the mean, and most bytes of texts; a block without texts holds four times the rows.
BLOCK, CELL_BYTES = 512, 4 << 20
MEMO_WORDS = 100_000
CHUNK = 1 << 15
_memo: dict[bytes, int] = {}
_draw = np.random.default_rng(20)
FLIPS = _draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TURNS = _draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_F = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, k: int) -> frozenset:
    """The full set: tuples of k words, or of all words when there are fewer."""
    w = text.lower().split()
    if not w:
        return frozenset()
    if len(w) <= k:
        return frozenset([tuple(w)])
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False))


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the set's shingles."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    memo = _memo
    if len(memo) > MEMO_WORDS:
        memo.clear()
    codes = []
    for x in w:
        c = memo.get(x)
        if c is None:
            c = memo[x] = int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little")
        codes.append(c)
    a = np.array(codes, dtype=np.uint64)
    n = max(1, len(a) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(a))):
        out *= _F
        out += a[j : j + n]
    return np.unique(mix64(out + np.uint64(min(k, len(a)))))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (uint16) of non-empty sets of hashes, one row a set."""
    sizes = np.array([len(s) for s in sets])
    low = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, dtype=np.uint64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1)
        part = flat[at[first] : at[last]]
        starts = at[first:last] - at[first]
        work = np.empty_like(part)
        for r in range(REGISTERS):
            np.bitwise_xor(part, FLIPS[r], out=work)
            np.multiply(work, TURNS[r], out=work)
            low[first:last, r] = np.minimum.reduceat(work, starts)
        first = last
    h = -np.log1p(-((low >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of register rows, given both set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    c = (BASE - 1) / BASE
    log_b = math.log(BASE)

    def p(x):
        return np.clip(-np.log1p(-np.maximum(x, 0) * c) / log_b, 1e-12, 1 - 1e-12)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):  # the log-likelihood has one peak
        x, y = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = value(x) > value(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def _least_estimate(threshold: float) -> float:
    return threshold - 6 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _sketch(k: int):
    @F.pandas_udf("n_shingles long, regs binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sizes, out = np.zeros(len(texts), dtype=np.int64), [None] * len(texts)
            for first in range(0, len(texts), BLOCK):
                sets = [shingle_hashes(b"" if t is None else bytes(t), k) for t in texts.iloc[first : first + BLOCK]]
                some = [i for i, s in enumerate(sets) if len(s)]
                sizes[first : first + len(sets)] = [len(s) for s in sets]
                for i, row in zip(some, registers([sets[i] for i in some]), strict=True):
                    out[first + i] = row.tobytes()
            yield pd.DataFrame({"n_shingles": sizes, "regs": pd.Series(out, dtype=object)})

    return run


def _memberships(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, hub, weight): the buckets that hold several nodes; of buckets with the same nodes one.

    A node weighs the sizes of all its buckets, so what lies in the middle of a group weighs most;
    ``hub``: the heaviest node of the bucket, and its ``weight``.
    """
    bands = [F.xxhash64(F.lit(j), F.substring("regs", 2 * ROWS * j + 1, 2 * ROWS)) for j in range(BANDS)]
    banded = nodes.select(F.explode(F.array(*bands)).alias("bucket"), "node")
    shared = banded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("bucket")
    members = scratch.written(banded.join(shared, "bucket").withColumn("salt", salt_of("node")))
    same = ("x", "y", "n", "bits")  # salts follow from the nodes, so they agree where the nodes do
    marks = members.groupBy("bucket").agg(
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.count("*").alias("n"), salt_bits(F.col("salt")).alias("bits"),
    )
    kept = marks.groupBy(*same).agg(F.min("bucket").alias("bucket")).select("bucket", "n", "bits")
    sized = by_salted_key(members, kept, ["bucket"], "bits")
    # a node is in at most BANDS buckets
    weight = F.sum("n").over(Window.partitionBy("node"))
    weighed = scratch.written(sized.select("bucket", "node", "salt", weight.alias("weight")))
    rank = F.struct("weight", -F.col("node"))
    hubs = weighed.groupBy("bucket").agg(F.max_by("node", rank).alias("hub"), F.max("weight").alias("weight"), salt_bits(F.col("salt")).alias("bits"))
    out = scratch.written(by_salted_key(weighed.drop("weight"), hubs, ["bucket"], "bits").drop("salt"))
    scratch.drop(members, weighed)
    return out


def _leads(rows: DataFrame, group: str) -> DataFrame:
    """rows: (group, node, component) -> with ``lead``: not of the component that most rows of the group are of.

    Groups of one component are left out.
    """
    by = rows.groupBy(group, "component").agg(F.count("*").alias("n"), salt_bits(salt_of("node")).alias("bits"))
    main = by.groupBy(group).agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("components"), F.bit_or("bits").alias("bits")
    ).filter("components > 1").drop("components")
    met = by_salted_key(rows.withColumn("salt", salt_of("node")), main, [group], "bits")
    return met.withColumn("lead", F.col("component") != F.col("main")).drop("main", "salt")


def _cells(rows: DataFrame, group: str, most: int) -> DataFrame:
    """rows: (group, node, lead, size) -> a row for each cell: (i, j, block, inside) besides all columns.

    A group's lead rows are to meet each other and all the rest; the rest don't meet. Both are dealt
    into blocks of ``most`` rows or CELL_BYTES in the mean; cell (i, j) holds block i, a lead one, and
    block j. ``inside``: the lead rows of the cell are to meet each other in it.
    """
    def blocks(lead):
        n = F.greatest(F.count_if(lead) / most, F.sum(F.when(lead, F.col("size")).otherwise(0)) / CELL_BYTES)
        return F.ceil(n).cast("int")

    is_lead = F.col("lead")
    counts = rows.groupBy(group).agg(blocks(is_lead).alias("p"), blocks(~is_lead).alias("q"), salt_bits(salt_of("node")).alias("bits"))
    met = by_salted_key(rows.withColumn("salt", salt_of("node")), counts, [group], "bits").drop("salt")
    own = F.when(is_lead, F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).cast("int")
    last = F.when(is_lead, F.col("p") + F.col("q")).otherwise(F.col("p")) - 1
    met = met.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    # where there is one lead block, its rows meet in each of its cells with others
    met = met.filter("not (p = 1 and q > 0 and lead and other = 0)")
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return met.withColumns({"i": i, "j": j, "inside": (i == j) | (F.col("p") == 1)}).drop("other", "p", "q")


def _by_cell(cells: DataFrame, group: str, run, schema: str) -> DataFrame:
    """``run`` gets a dictionary of arrays, the rows of one cell, and gives a data frame or None."""
    key, columns = [group, "i", "j"], [c for c in cells.columns if c not in (group, "i", "j")]

    def each(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            at = pdf[key].to_numpy()
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1)]
            arrays = {c: pdf[c].to_numpy() for c in columns}
            found = [run({c: a[x:y] for c, a in arrays.items()}) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            if found := [f for f in found if f is not None]:
                yield pd.concat(found)
            held = pdf.iloc[cuts[-1] :]  # a cell may go on in the next batch
        if held is not None:
            found = run({c: held[c].to_numpy() for c in columns})
            if found is not None:
                yield found

    return cells.repartition(*key).sortWithinPartitions(*key).mapInPandas(each, schema)


def _meetings(cell: dict):
    """(row, rows that it is to meet) of a cell; ``label`` of the cell is looked up as it is by then."""
    lead = cell["lead"].astype(bool)
    leads, rest = np.flatnonzero(lead), np.flatnonzero(~lead)
    if not cell["inside"].all():  # two lead blocks
        low = cell["block"] == cell["block"].min()
        if lead.all():
            leads, rest = np.flatnonzero(low), np.flatnonzero(~low)
    for n, a in enumerate(leads):
        others = np.concatenate((leads[n + 1 :], rest)) if cell["inside"].all() else rest
        others = others[cell["label"][others] != cell["label"][a]]
        if len(others):
            yield a, others


def _join(cell: dict, a: int, b: int) -> None:
    label = cell["label"]
    label[label == label[b]] = label[a]


def _near_cell(threshold: float):
    """Nodes of a bucket's cell that are near one of another component, and a component that both are to be looked at with."""
    least = math.floor(_least_estimate(threshold) * REGISTERS)

    def run(cell):
        code = np.frombuffer(b"".join(cell["code"]), dtype=np.uint8).reshape(-1, REGISTERS)
        component = cell["component"]
        near, found = np.zeros(len(code), dtype=bool), []
        cell["label"] = component
        for a, others in _meetings(cell):
            hit = others[(code[others] == code[a]).sum(axis=1) >= least]
            if len(hit):
                near[hit] = near[a] = True
                found.append((a, hit))
        if not found:
            return None
        cell["label"] = component.copy()
        for a, hit in found:
            for b in hit:
                if cell["label"][a] != cell["label"][b]:
                    _join(cell, a, b)
        return pd.DataFrame({"node": cell["node"], "component": component, "family": cell["label"]})[near]

    return run


def _shingle_numbers(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's set as distinct numbers; equal numbers are equal shingles, not merely equal hashes."""
    ids: dict[bytes, int] = {}
    words = [np.array([ids.setdefault(w, len(ids)) for w in t.lower().split()], dtype=np.int64) for t in texts]
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate(words) if words else np.empty(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the text's end
    rank, at = flat, np.arange(len(flat))
    for j in range(1, k):
        go = left[at] > j
        # a text of fewer words is one shingle of its own length
        whole = ~go & (sizes[doc[at]] <= j) & (left[at] == sizes[doc[at]])
        keep = go | whole
        at, rank = at[keep], rank[keep]
        step = np.where(left[at] > j, flat[np.minimum(at + j, len(flat) - 1)] + 1, 0)
        _, rank = np.unique(rank * (len(ids) + 1) + step, return_inverse=True)
    order = np.lexsort((rank, doc[at]))
    own, number = doc[at][order], rank[order]
    first = np.ones(len(own), dtype=bool)
    first[1:] = (own[1:] != own[:-1]) | (number[1:] != number[:-1])
    own, number = own[first], number[first]
    return np.split(number, np.searchsorted(own, np.arange(1, len(texts)))) if len(texts) else []


def _link_cell(k: int, percent: int):
    """Links between components of a cell's nodes, by full sets: enough of them to join whatever is linked."""
    lowest = _least_estimate(percent / 100)
    least = math.floor(lowest * REGISTERS)

    def run(cell):
        regs = np.frombuffer(b"".join(cell["regs"]), dtype=np.uint16).reshape(-1, REGISTERS)
        n = cell["n_shingles"].astype(np.int64)
        cell["label"] = cell["component"].copy()
        near = []
        for a, others in _meetings(cell):
            others = others[(100 * np.minimum(n[a], n[others]) >= percent * np.maximum(n[a], n[others]))]
            others = others[(regs[others] == regs[a]).sum(axis=1) >= least]
            if len(others):
                own = np.broadcast_to(regs[a], (len(others), REGISTERS))
                others = others[estimate(own, regs[others], np.full(len(others), n[a]), n[others]) >= lowest]
            if len(others):
                near.append((a, others))
        if not near:
            return None
        wanted = np.unique(np.concatenate([np.append(o, a) for a, o in near]))
        sets = dict(zip(wanted.tolist(), _shingle_numbers([bytes(cell["text"][i]) for i in wanted], k), strict=True))
        mark = np.zeros(1 + max(int(s[-1]) for s in sets.values()), dtype=bool)
        found = []
        for a, others in near:
            others = others[cell["label"][others] != cell["label"][a]]
            if not len(others):
                continue
            mark[sets[a]] = True
            both = np.array([np.count_nonzero(mark[sets[b]]) for b in others.tolist()])
            mark[sets[a]] = False
            for b in others[100 * both >= percent * (n[a] + n[others] - both)]:
                if cell["label"][a] != cell["label"][b]:
                    _join(cell, a, b)
                    found.append((cell["component"][a], cell["component"][b]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64") if found else None

    return run


def _links(rows: DataFrame, group: str, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """rows: (group, node, component, lead, size) -> (a, b): components linked by lead rows and all others of their group."""
    cells = _cells(rows, group, BLOCK).drop("size").join(texts, "node")
    return _by_cell(cells, group, _link_cell(k, percent), "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame, of: str = "node") -> DataFrame:
    """rows with the component that labels has for a column, or the column itself."""
    own = labels.select(F.col("node").alias("_of"), F.col("component").alias("_found"))
    return rows.join(own, F.col(of) == F.col("_of"), "left").withColumn("component", F.coalesce("_found", of)).drop("_of", "_found")


def _contracted(edges: DataFrame) -> DataFrame:
    """(a, b): edges of as few distinct pairs: each a with its least b, and its other b with that one."""
    edges = edges.distinct()
    met = edges.join(edges.groupBy("a").agg(F.min("b").alias("least")), "a")
    return met.select("a", F.col("least").alias("b")).unionByName(met.select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct()


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row a document: doc_id, copy (hash of its text), n_shingles, component_id, stays.

    ``stays`` is true for one (doc_id, copy) of each group. A written table.
    """
    threshold = percent / 100
    body = _body("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(body)).alias("copy"), body.alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        sketched = rows.select("doc_id", "copy", F.octet_length("text").cast("long").alias("size"), _sketch(k)("text").alias("s"))
        with small_batches(docs.sparkSession):
            sketched = scratch.written(sketched.select("doc_id", "copy", "size", "s.n_shingles", "s.regs"))
        usable = sketched.filter("n_shingles > 0")
        salt = salt_bits(salt_of("doc_id")).alias("bits")
        copies = usable.groupBy("copy", "size", "n_shingles", "regs").agg(F.min("doc_id").alias("least_id"), salt)
        # numbers that are given once and for all by writing them down
        nodes = scratch.written(copies.withColumn("node", F.monotonically_increasing_id()))
        members = _memberships(nodes, scratch)
        sharing = scratch.written(nodes.join(members.select("node").distinct(), "node", "left_semi"))

        wanted = sharing.select(F.col("copy").alias("c"), F.col("least_id").alias("i"), "node", "n_shingles", "regs")
        found = rows.join(wanted, (F.col("copy") == F.col("c")) & F.col("doc_id").eqNullSafe(F.col("i")))
        texts = scratch.written(found.select("node", "n_shingles", "regs", "text").dropDuplicates(["node"]))

        # 1. each node and the heaviest hub of all its buckets
        pairs = members.filter("hub <> node").groupBy("node").agg(F.max_by("hub", F.struct("weight", -F.col("hub"))).alias("hub"))
        star = pairs.select("hub", "node", F.lit(False).alias("lead")).unionByName(
            pairs.select("hub", F.col("hub").alias("node"), F.lit(True).alias("lead")).distinct()
        )
        star = scratch.written(star.join(sharing.select("node", "size"), "node").withColumn("component", F.col("node")))
        links = scratch.written(_links(star, "hub", texts, k, percent))
        labels = components(links)
        # 2. nodes of different components that come near in a bucket, and families that hold all such
        code = F.unhex(F.regexp_replace(F.hex("regs"), "(..)..", "$1"))  # the lower byte of each register
        apart = scratch.written(_leads(_labelled(members.select("bucket", "node"), labels), "bucket").withColumn("size", F.lit(REGISTERS)))
        apart = _cells(apart, "bucket", 4 * BLOCK).join(sharing.select("node", code.alias("code")), "node")
        near = scratch.written(_by_cell(apart, "bucket", _near_cell(threshold), "node long, component long, family long"))
        if not near.isEmpty():
            families = components(_contracted(near.select(F.col("component").alias("a"), F.col("family").alias("b"))))
            active = near.select("node", "component").distinct().join(families.select(F.col("node").alias("component"), F.col("component").alias("family")), "component")
            # 3. the near ones of a family, by their full sets
            met = _leads(active.join(sharing.select("node", "size"), "node"), "family")
            more = scratch.written(_links(scratch.written(met), "family", texts, k, percent))
        placed = _labelled(nodes.select("node", "copy", "least_id", "bits"), labels)
        if not near.isEmpty() and not more.isEmpty():
            # these links are between components, which are far fewer than nodes
            placed = _labelled(placed.withColumnRenamed("component", "first"), components(more), "first").drop("first")
        best = F.min_by(F.struct("least_id", "copy"), F.struct(F.col("least_id").isNull(), "least_id", "copy"))
        groups = placed.groupBy("component").agg(best.alias("head"), salt_bits(salt_of("node")).alias("salts"))
        placed = by_salted_key(placed.withColumn("salt", salt_of("node")), groups, ["component"], "salts").select("copy", "head", "bits")
        linked = by_salted_key(usable.select("doc_id", "copy", "n_shingles").withColumn("salt", salt_of("doc_id")), placed, ["copy"], "bits")
        linked = linked.select(
            "doc_id", "copy", "n_shingles", F.col("head.least_id").alias("component_id"),
            (F.col("doc_id").eqNullSafe(F.col("head.least_id")) & (F.col("copy") == F.col("head.copy"))).alias("stays"),
        )
        alone = sketched.filter("n_shingles = 0").select("doc_id", "copy", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
        return written(linked.unionByName(alone))


def _body(text: str):
    return lower_az(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary")


def clusters(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("stays"))
    return _grouped(docs, k, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def survivors(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the least doc_id, with all its columns.

    Texts without words are in no group: all of them stay.
    """
    own, doc, copy, times = (free_name(docs, x) for x in ("own_copy", "stay_id", "stay_copy", "stay_times"))
    grouped = _grouped(docs, k, percent).filter("stays and n_shingles > 0")
    stay = grouped.groupBy(F.col("doc_id").alias(doc), F.col("copy").alias(copy)).agg(F.count("*").alias(times))
    columns = [F.col(quoted(c)) for c in docs.columns]
    marked = docs.withColumn(own, F.unhex(F.md5(_body("text"))))
    match = (F.col(own) == F.col(copy)) & F.col("doc_id").eqNullSafe(F.col(doc))
    found = marked.join(stay, match)
    one = found.filter(F.col(times) == 1).unionByName(found.filter(F.col(times) > 1).dropDuplicates([own, "doc_id"]))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return one.select(*columns).unionByName(docs.filter(wordless).select(*columns))
