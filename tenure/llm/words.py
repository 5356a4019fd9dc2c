"""64-bit hashes of the words of a text, computed for many words at once."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_P, i, 1 << 64) for i in range(64)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(data: np.ndarray) -> np.ndarray:
    inside = ~_GAP[data]
    data, starts = data[inside], np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    starts = (np.cumsum(inside) - 1)[starts]
    size = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, size)
    power = _POWERS[place & 63]
    if size.max() > 64:  # later 64-byte pieces of a long word are weighted by their number, with odd weights
        later = np.flatnonzero(place >= 64)
        power[later] *= mix((place[later] >> 6).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat((_LOWER[data] + np.uint64(1)) * power, starts) + size.astype(np.uint64))


def blocks(data: np.ndarray, size: int):
    """(start, end) of blocks of about ``size`` bytes that end at white space (or with the text)."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data):
            gaps = np.flatnonzero(_GAP[data[max(at, end - size) : end]])
            if len(gaps):
                end = max(at, end - size) + int(gaps[-1]) + 1
                break
            end += size
        yield at, min(end, len(data))
        at = end


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word ([^ \\t-\\r]+, A-Z as a-z) of ``text``, in order.

    The text is hashed in blocks that end at white space, so its length bounds only the
    result (8 bytes a word).
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found = [_block(data[i:j]) for i, j in blocks(data, BLOCK)]
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
