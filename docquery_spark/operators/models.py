"""Roles that models play, and offline stand-ins for them.

A role is a function on an iterator of pandas frames, run by ``mapInPandas``. The stand-ins are
rules: they make every stage testable and are no match for trained models.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd


class Extractor(Protocol):
    """Answers (chunk_type, content, retry) with the text that a model would return.

    A figure's image, where there is one, comes as a fourth argument. On a retry a model is to be told
    :data:`RETRY_NOTE`, which is no part of the content.
    """

    def __call__(self, chunk_type: str, content: str, retry: bool, image: bytes | None = None) -> str: ...


class Judge(Protocol):
    """Answers (claim, sources) with the JSON that a validator would return.

    Of a chunk the claim is the JSON of its fields, and a figure's image comes as a third argument.
    """

    def __call__(self, text: str, sources: str, image: bytes | None = None) -> str: ...


class Generator(Protocol):
    """Answers (question, context) with an answer, its reasoning in a block before it."""

    def __call__(self, question: str, context: str) -> str: ...


class Embedder(Protocol):
    """The vector of a text."""

    def __call__(self, text: str, dimensions: int) -> np.ndarray: ...


# Fixed value: what a model is told when its first reply was of no use.
RETRY_NOTE = "\n\nReturn only one JSON object."


def routed(**by_type: Extractor) -> Extractor:
    """One extractor a chunk type, as ``routed(text=..., table=..., figure=...)``; another type is a KeyError."""

    def extract(chunk_type, content, retry, *image):
        return by_type[chunk_type](chunk_type, content, retry, *image)

    return extract


class Held:
    """A model that is loaded on first use in a worker and let go with the iterator."""

    def __init__(self, load: Callable[[], Any]):
        self._load, self._model = load, None

    def __enter__(self):
        self._model = self._model if self._model is not None else self._load()
        return self

    def __exit__(self, *exc):
        self._model = None

    @property
    def model(self):
        if self._model is None:
            raise RuntimeError("the model isn't loaded")
        return self._model


def in_batches(load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]):
    """A ``mapInPandas`` function around a frame function that is loaded once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Held(load) as held:
            for pdf in batches:
                yield held.model(pdf)

    return run


_WORD = re.compile(r"[^\W_]{4,}")


def rule_extractor(chunk_type: str, content: str, retry: bool, image: bytes | None = None) -> str:
    """Cleans white space, takes the first sentence as summary and frequent long words as concepts."""
    clean = content if chunk_type == "table" else re.sub(r"[ \t]+", " ", content).strip()
    first = re.split(r"(?<=[.!?])\s", clean.strip(), maxsplit=1)[0][:200]
    top = [w for w, _ in sorted(Counter(_WORD.findall(clean.lower())).items(), key=lambda x: (-x[1], x[0]))[:5]]
    if len(clean) < 20 and not retry:
        return "no structure found"
    return json.dumps({"structured_text": clean, "intuition_summary": first, "key_concepts": top, "confidence": 0.9 if len(clean) >= 100 else 0.6})


#: Characters that the identity extractor keeps, and the confidence that it states.
IDENTITY_CHARS, IDENTITY_CONFIDENCE = 2000, 0.8


def identity_extractor(chunk_type: str, content: str, retry: bool, image: bytes | None = None) -> str:
    """The start of the content as it is."""
    return json.dumps({"structured_text": content[:IDENTITY_CHARS], "confidence": IDENTITY_CONFIDENCE}, ensure_ascii=False)


_CLAIM = re.compile(r"\d[\d,.]*|\b[A-Z][\w-]+\b")


def _claim(text: str) -> str:
    """The text of a chunk's JSON; any other text as it is."""
    if text.startswith("{"):
        try:
            return str(json.loads(text).get("structured_text", ""))
        except ValueError:
            pass
    return text


def lexical_judge(text: str, sources: str, image: bytes | None = None) -> str:
    """Numbers and names of the text, citations in brackets aside, that no source has.

    It misses paraphrase and accepts true-looking errors, and looks at no image.
    """
    low = sources.lower()
    claims = [c.rstrip(".,") for c in _CLAIM.findall(re.sub(r"\[[^\]]*\]", "", _claim(text)))]
    missing = [c for c in dict.fromkeys(claims) if c.lower() not in low]
    score = 1.0 - len(missing) / len(set(claims)) if claims else 1.0
    return json.dumps({"is_valid": not missing, "is_grounded": not missing, "issues": missing, "hallucinations": missing, "verdict_score": round(score, 3), "confidence": round(score, 3), "validator_notes": "lexical check"})


def hashed_words(text: str, dimensions: int = 64) -> np.ndarray:
    """Signed word hashing, unit length. It knows spelling, not meaning."""
    import hashlib

    out = np.zeros(dimensions)
    for w, n in Counter(re.findall(r"\w+", text.lower())).items():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % dimensions] += n * (1 if h >> 63 else -1)
    length = float(np.linalg.norm(out))
    return out / length if length else out
