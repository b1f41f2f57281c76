"""Byte-level word splitting and vectorised hashing shared by the operators.

Texts reach Python as UTF-8 bytes, so that ``bytes.split`` and ``bytes.lower`` give the word
and case rules of the operators exactly: they know only the six ASCII white-space bytes
(``\\x20 \\x09-\\x0D``) and the letters A-Z.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Lower-cases A-Z and turns every ASCII byte but digits and letters into a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of non-white-space bytes."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit words (public splitmix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit keyed hash, filled on first use and emptied when it holds ``bound`` words."""

    def __init__(self, salt: bytes, bound: int = 400_000):
        super().__init__()
        self.salt, self.bound = salt, bound

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.salt).digest(), "little")
        if len(self) >= self.bound:
            self.clear()
        self[word] = value
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
