"""Word shingles of whole texts as sorted arrays of 64-bit hashes, a batch at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

from .common import blank_words, lower_ascii, mix, word_hashes

_STEPS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The set of n-word shingles of each text; with fewer words, the whole sequence; without words, empty."""
    if n > len(_STEPS):
        raise ValueError(f"shingles of {n} words; at most {len(_STEPS)}")
    buffer = np.frombuffer(lower_ascii(b"\n".join(texts)) + b"\n", np.uint8)
    starts, ends = blank_words(buffer)
    words = word_hashes(buffer, starts, ends)
    limits = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    low = 0
    for high in limits:
        own = words[low:high]
        low = high
        if len(own) >= n:
            total = own[: len(own) - n + 1] * _STEPS[0]
            for k in range(1, n):
                total = total + own[k : len(own) - n + 1 + k] * _STEPS[k]
            yield np.unique(mix(total))
        elif len(own):
            yield mix((own * _STEPS[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))
        else:
            yield own


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit key of the whole set, as a signed integer."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)
