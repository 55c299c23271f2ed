"""Words of texts, their hashes, and rolling hashes of windows of them."""

from __future__ import annotations

import functools
from typing import TYPE_CHECKING

from loomwright.llm.chunks import ChunkTable

if TYPE_CHECKING:
    import numpy as np

#: Odd multipliers of two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@functools.cache
def _table() -> ChunkTable:
    import xxhash

    return ChunkTable(xxhash.xxh64_intdigest)


def words_of(text: str | None) -> list[bytes]:
    """The words between white space (0x20, 0x09-0x0D), in UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word."""
    import numpy as np

    return np.fromiter(map(_table().__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(x: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of each window of so many word hashes: sum of x[p + j] * base**j, modulo 2**64."""
    import numpy as np

    n = len(x)
    if n < length:
        return np.zeros(0, dtype=np.uint64)
    powers, back = _powers(base, 1 << max(n, 1024).bit_length())
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * powers[:n], dtype=np.uint64)])
    return (total[length:] - total[:-length]) * back[: n - length + 1]


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    import numpy as np

    up = lambda b: np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(n, b, dtype=np.uint64), dtype=np.uint64)])
    return up(base), up(pow(base, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers, each mixed by two rounds of multiplication and shift."""
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(BASES[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(BASES[1])
    return x ^ (x >> np.uint64(32))


def _is_space() -> np.ndarray:
    import numpy as np

    out = np.zeros(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def rolled_shingles(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text a 64-bit hash of each of its shingles of so many words, with A-Z lower-cased, repeats included.

    A text with fewer words is one shingle, one without a word (null too) has none. Hashes are rolled
    over the bytes of all texts at once, and then over their words, so that neither a word nor a
    shingle costs a call of its own.
    """
    import numpy as np

    # On bytes, lower() changes A-Z alone.
    raw = [(t or "").encode("utf-8", "replace").lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    gap = _is_space()[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    edge = edge if not len(data) or gap[0] else np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(BASES[1], 1 << max(len(data), 1024).bit_length())
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    # The factor by the word's length tells words apart whose sums begin alike.
    x = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(BASES[0]))
    firsts = np.searchsorted(begin, np.cumsum([0, *map(len, raw)]))
    out = []
    for a, z in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        own = x[a:z]
        out.append(mixed(window_hashes(own, min(words, len(own)), BASES[0])) if len(own) else own)
    return out
