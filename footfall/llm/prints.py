"""SimHash fingerprints of texts: word shingles, their hashes, and the majority of the hashes' bits."""

from __future__ import annotations

import numpy as np

MASK64 = (1 << 64) - 1


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """A hash of each run of `shingle` words, of a shorter text as a whole; none without words."""
    import xxhash

    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    take, n = xxhash.xxh64_intdigest, len(words) - k + 1
    return np.fromiter((take(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; further lanes are 64-bit finalisers of it."""
    if lane:
        h = h + np.uint64(lane * 0x9E3779B97F4A7C15 & MASK64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(hashes: np.ndarray, lanes: int) -> list[int]:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    n = len(hashes)
    if not n:
        return [0] * lanes
    out = []
    for lane in range(lanes):
        total = np.zeros((8, 256), np.int64)
        for i in range(0, n, 65536):
            octets = mixed(hashes[i : i + 65536], lane).view(np.uint8).reshape(-1, 8)
            total += np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
        bits = (total @ BITS).ravel() * 2 > n
        out.append(int(np.packbits(bits, bitorder="little").view(np.int64)[0]))
    return out
