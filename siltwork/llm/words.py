"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are cut into words at a time; words that keep their hash, and the length up to which they do.
SLICE, KEPT, SHORT = 1 << 21, 1 << 19, 64
KEY = b"siltwork words"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


class Hashes(dict):
    """64 bits of a keyed BLAKE2b of each word."""

    def __missing__(self, word: bytes) -> int:
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY).digest(), "little")
        if len(word) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[word] = got
        return got


@functools.cache
def _hashes() -> Hashes:
    return Hashes()


def slices(raw: bytes) -> Iterator[bytes]:
    """raw in slices of about SLICE bytes that end at white space; a longer word is a slice of its own length."""
    at = 0
    while len(raw) - at > SLICE:
        end = max(raw.rfind(c, at, at + SLICE) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        if end <= at:
            later = [p for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") if (p := raw.find(c, at + 1)) > 0]
            end = min(later, default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text); words are runs without ASCII white space, A-Z lower-cased.

    A null text has no words. Two different words share a hash with a chance of 2**-64, whatever they are.
    """
    get = _hashes().__getitem__
    flat: list[bytes] = []
    done, sizes = [], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        for piece in slices((t or "").encode("utf-8", "surrogatepass").lower()):
            words = piece.split()  # at ASCII white space, as lower() above is ASCII's
            sizes[k] += len(words)
            flat += words
            if len(flat) > 1 << 18:
                done.append(np.fromiter(map(get, flat), np.uint64, len(flat)))
                flat = []
    done.append(np.fromiter(map(get, flat), np.uint64, len(flat)))
    return np.concatenate(done), sizes


def text_runs(texts, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of an Arrow array of texts of about most characters, with the place of their first."""
    first, now, size = 0, [], 0
    for k, t in enumerate(texts):
        now.append(t.as_py())
        size += len(now[-1] or "")
        if size >= most:
            yield first, now
            first, now, size = k + 1, [], 0
    if now:
        yield first, now
