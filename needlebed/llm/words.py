"""Words of texts as 64-bit hashes, in whole numpy batches."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[BLANK] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words between blanks, lower-case, and where each text's begin, with the total at the end."""
    raw = [t.lower().encode(errors="replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = BLANK[data]
    at = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    span = np.diff(np.r_[at, len(data)])
    power = np.cumprod(np.full(int(span.max()), _STEP, np.uint64))
    place = np.arange(at[0], len(data)) - np.repeat(at, span)
    word = mix(np.add.reduceat(_BYTE[data[at[0] :]] * power[place], at - at[0]))
    return word, np.searchsorted(at, np.cumsum([0] + [len(r) + 1 for r in raw]))


def stretches(column, most_chars: int):
    """(first row, texts) of stretches of a binary Arrow column that hold about so many characters; nulls are empty
    texts, and what isn't UTF-8 becomes U+FFFD."""
    start = 0
    while start < len(column):
        part, chars = [], 0
        while start + len(part) < len(column) and chars < most_chars:
            part.append((column[start + len(part)].as_py() or b"").decode(errors="replace"))
            chars += len(part[-1])
        yield start, part
        start += len(part)
