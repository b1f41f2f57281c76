"""The pipeline's stages, each against brute force on what the one before kept."""

from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
from test_llm_operators import brute_clusters, brute_hits, split

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables aren't here")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:5])
    assert steps[5].columns == [*steps[0].columns, "size", "text_crc32", "shard", "slot"]


def test_classifier_keeps_trusted_and_drops_junk(spark):
    """On labels; 200 documents are too few to train on, so this one takes 1,000."""
    larger = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    kept = texts(corpus_pipeline.classify(spark, spark.read.parquet(f"{larger}/documents.parquet"), larger))
    clean = [i for i, x in labels.items() if x == (1, 0)]
    junk = [i for i, x in labels.items() if x[0] == 0]
    print(len(kept), len(clean), len(junk), sum(i in kept for i in junk))
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and sum(i in kept for i in junk) <= 0.2 * len(junk)
    assert len(kept) >= 0.78 * 1000


def test_near_duplicates(steps):
    want = brute_clusters(list(texts(steps[1]).items()), 5, 80)
    assert set(texts(steps[2])) == {i for i, w in want.items() if w[2]}
    assert len(want) > steps[2].count()


def test_decontamination(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for i, t in texts(steps[2]).items():
        n, hit, _ = brute_hits(t, items)
        if not (hit and 20 * hit >= n):
            want.add(i)
    assert set(texts(steps[3])) == want


def test_mixing(steps):
    before = {r["doc_id"]: (r["source"], len(split(r["text"]))) for r in steps[3].collect()}
    copies = Counter(r["doc_id"] for r in steps[4].collect())
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    size, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, (s, n) in before.items():
        size[s] += n
        taken[s] += n * copies[i]
        longest[s] = max(longest[s], n)
    names = sorted(size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        if not full:
            break
        target |= {s: 2 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in names)


def test_sharding(steps):
    rows = steps[5].collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in steps[4].collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))


def test_run_is_all_stages(spark, steps):
    key = lambda df: Counter((r["doc_id"], r["text_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[5])


def test_empty_tables(spark, steps, tmp_path):
    folder = str(tmp_path / "none")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
