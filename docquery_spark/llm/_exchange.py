"""Asking shards for what all groups know of a key, in messages whose number follows the input.

Groups of documents hold sorted keys with some figures each. A key's first bits are the path of the
shard that owns it. With few shards each group sends each a packed row and gets one back. With more
than ``2 ** FAN`` shards the way goes over levels: a level reads at most FAN bits of the key, so a
group never sends more than ``2 ** FAN`` rows; a cell takes the rows of ``2 ** FAN`` askers for one
path, merges them, and asks the next level like a group. Answers come back the same way. What a task
holds is the rows of ``2 ** FAN`` askers or one shard, and rows grow with the input, not its square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 8
ASKS = "path long, asker long, body binary"


def packed(**arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers: bytes of equal rank lie together, empty ranks are left out. ``key`` must be sorted."""
    out = []
    for name, a in arrays.items():
        a = np.asarray(a).astype(np.int64, copy=False).view(np.uint64) if np.asarray(a).dtype != np.uint64 else np.asarray(a)
        if name == "key":
            a = np.diff(a, prepend=np.uint64(0))
        ranks = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :ranks].T
        out += [np.array([len(a)], dtype="<u8").tobytes(), bytes([ranks]), planes.tobytes()]
    return b"".join(out)


def unpacked(body: bytes, *names: str) -> dict[str, np.ndarray]:
    """The arrays again, as unsigned numbers of 64 bits."""
    out, at = {}, 0
    for name in names:
        n, ranks = int.from_bytes(body[at : at + 8], "little"), body[at + 8]
        at += 9
        a = np.zeros((n, 8), dtype=np.uint8)
        a[:, :ranks] = np.frombuffer(body, dtype=np.uint8, count=n * ranks, offset=at).reshape(ranks, n).T
        at += n * ranks
        a = a.view("<u8").ravel()
        out[name] = np.cumsum(a, dtype=np.uint64) if name == "key" else a
    return out


def levels(shards: int, fan: int | None = None) -> list[int]:
    """Bits that each level reads, for at least so many shards."""
    fan = fan or FAN
    bits = max(1, (shards - 1).bit_length())
    n = -(-bits // fan)
    return [bits // n + (i < bits % n) for i in range(n)]


def parts(key: np.ndarray, bits: int, width: int) -> list[tuple[int, slice]]:
    """(path, slice) of sorted keys of ``width`` bits by their first ``bits`` bits; empty ones left out."""
    if not len(key):
        return []
    path = (key >> np.uint64(width - bits)).astype(np.int64)
    heads = np.flatnonzero(np.diff(path, prepend=-1))
    return [(int(path[a]), slice(a, b)) for a, b in zip(heads, [*heads[1:], len(path)], strict=True)]


@dataclass
class Protocol:
    """How keys are merged and answered. Pieces are dictionaries of arrays, one for each asker.

    merge: pieces -> one piece with sorted, distinct keys. answer: (path, pieces, askers) -> answers, one a piece.
    back: (pieces, askers, merged answers of the next level, in the order of the merged keys) -> answers.
    Rows with a path below 0 ask nobody: they are answered where they first arrive.
    """

    asked: tuple[str, ...]
    answered: tuple[str, ...]
    merge: Callable
    answer: Callable
    back: Callable
    width: int = 64


def _replies(path: int, askers, answers) -> pd.DataFrame:
    rows = [(path, int(a), packed(**x)) for a, x in zip(askers, answers, strict=True) if x is not None]
    return pd.DataFrame(rows, columns=["path", "asker", "body"])


def _joined(replies: pd.DataFrame, names) -> dict[str, np.ndarray]:
    some = [unpacked(b, *names) for b in replies.sort_values("path")["body"]]
    return {n: np.concatenate([x[n] for x in some]) if some else np.empty(0, dtype=np.uint64) for n in names}


def ask(asks: DataFrame, bits: list[int], protocol: Protocol) -> DataFrame:
    """asks: (path, asker, body), with paths of ``bits[0]`` bits -> the answers, in the same columns."""
    return _ask(asks, bits, 0, protocol)


def _ask(asks: DataFrame, bits: list[int], level: int, p: Protocol) -> DataFrame:
    read = lambda pdf: [unpacked(b, *p.asked) for b in pdf["body"]]
    if level == len(bits) - 1:

        def answer(key, pdf):
            askers = pdf["asker"].to_numpy()
            return _replies(int(key[0]), askers, p.answer(int(key[0]), read(pdf), askers))

        return asks.groupBy("path").applyInPandas(answer, ASKS)
    upto, step = sum(bits[: level + 2]), bits[level + 1]

    def up(key, pdf):
        if key[0] < 0:
            return pd.DataFrame({"path": [], "asker": [], "body": []})
        merged = p.merge(read(pdf))
        rows = [(path, int(key[1]), packed(**{n: a[at] for n, a in merged.items()})) for path, at in parts(merged["key"], upto, p.width)]
        return pd.DataFrame(rows, columns=["path", "asker", "body"])

    def down(key, pdf, replies):
        if not len(pdf):
            return pd.DataFrame({"path": [], "asker": [], "body": []})
        askers = pdf["asker"].to_numpy()
        if key[0] < 0:
            return _replies(int(key[0]), askers, p.answer(int(key[0]), read(pdf), askers))
        return _replies(int(key[0]), askers, p.back(read(pdf), askers, _joined(replies, p.answered)))

    cells = asks.withColumn("bundle", F.call_function("shiftright", F.col("asker"), F.lit(max(bits))))
    deeper = _ask(cells.groupBy("path", "bundle").applyInPandas(up, ASKS), bits, level + 1, p)
    below = deeper.select(F.call_function("shiftright", F.col("path"), F.lit(step)).alias("own"), F.col("asker").alias("cell"), "path", "body")
    return cells.groupBy("path", "bundle").cogroup(below.groupBy("own", "cell")).applyInPandas(down, ASKS)
