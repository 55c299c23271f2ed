"""A table of distinct text chunks that remembers what a tokenizer makes of each."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

#: Entries that one worker's table holds; beyond them chunks are computed anew each time.
TABLE_ENTRIES = 400_000
#: Longer chunks are never kept.
KEPT_CHARS = 64


class ChunkTable(dict):
    """Maps a chunk to its computed value; each distinct chunk is computed once while there is room."""

    def __init__(self, compute: Callable[[str], Any], entries: int = TABLE_ENTRIES) -> None:
        super().__init__()
        self.compute, self.entries = compute, entries
        self.plain: Callable[[str], Any] = compute

    def __missing__(self, chunk: str) -> Any:
        value = self.compute(chunk)
        if len(self) < self.entries and len(chunk) <= KEPT_CHARS:
            self[chunk] = value
        return value
