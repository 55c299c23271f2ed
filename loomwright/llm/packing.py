"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Documents are tokenised and cut into pieces. Each partition packs its pieces best-fit decreasing, so
many at a time; bins that are nearly full are final, the others go up a tree as items: at each level
the open bins of ``FAN_IN`` neighbouring groups meet in one task, which packs them best-fit
decreasing again. A bin is a row of its number and fill there; the few that move into another bin are
joined to their pieces at the end.

Of the open bins of one fill, a group hands on at most ``FAN_IN * LEVELS``. That loses nothing: best
fit leaves at most one bin that is at most half full, and two bins that are over half full don't
fit together. So on each level above at most ``FAN_IN`` bins look for a place, each takes one bin at
most, and bins of one fill are as good as each other. No task grows with the input.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.chunks import ChunkTable
from loomwright.llm.common import pick, sized, stored, values

FAN_IN = 8
#: Levels that the tree may have: enough for 8**16 groups.
LEVELS = 16
#: The part of a bin, as 1 / NEARLY_FULL, that may be free in one that counts as nearly full.
NEARLY_FULL = 256
#: Pieces that one task packs at a time at the lowest level.
LOCAL_ITEMS = 200_000

_BESIDE_SPACE = re.compile(r" \s|\s ")
#: White space but for the space and the line feed; looking for each is faster than a regular expression.
_ODD_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.cache
def _table(path: str) -> tuple[ChunkTable, str, dict[str, int]]:
    """(table from a chunk of text to its ids as uint32 bytes, regex of special strings, their ids).

    The tokenizer file holds a byte-level BPE; its ranks are handed to tiktoken, which merges the
    same pairs in the same order several times faster.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    bytes_of = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(bytes_of.__getitem__, piece)): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    encode = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # Keyed by a word, for the ids of the word after a space.
    table = ChunkTable(lambda word: array("I", encode(" " + word)).tobytes())
    table.plain = lambda text: array("I", encode(text)).tobytes()
    return table, "|".join(map(re.escape, sorted(special, key=len, reverse=True))), special


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level BPE files write for bytes, and the bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ids(text: str, path: str) -> bytes:
    """The ids of a text as little-endian uint32."""
    table, special, special_ids = _table(path)
    if any(s in text for s in special_ids):
        ordinary, found = re.split(special, text), re.findall(special, text)
        out = [_ids(ordinary[0], path)]
        for token, part in zip(found, ordinary[1:], strict=True):
            out += [special_ids[token].to_bytes(4, "little"), _ids(part, path)]
        return b"".join(out)
    if "  " in text or " \n" in text or "\n " in text or (any(c in text for c in _ODD_SPACES) and _BESIDE_SPACE.search(text)):
        return table.plain(text)
    # A space that has no white space beside it starts a new chunk for the tokenizer.
    first, *rest = text.split(" ")
    return table.plain(first) + b"".join(map(table.__getitem__, rest))


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    end, names = end_id.to_bytes(4, "little"), ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        rows: list[tuple] = []
        for key, text in zip(values(b.column(0)), values(b.column(1)), strict=True):
            ids = memoryview(_ids(text or "", path) + end)
            n = len(ids) // 4
            first = (n - 1) % size + 1
            start = 0
            for k, stop in enumerate(range(first, n + 1, size)):
                rows.append((key, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                start = stop
        columns = zip(*rows, strict=True) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens of each tokenised document, only a long one's first piece shorter.

    Columns: doc_id, piece (from 0), start (the document's tokens before it), length, ids_crc32 (of
    the ids as little-endian uint32). A document is its ids followed by ``end_id``; a null text
    counts as empty, so has that id alone. A very long text is held whole with its ids. Repeated rows
    repeat their pieces, null ids stay null, an empty table gives an empty result; columns are found by
    exact name, and others are not looked at.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(functools.partial(_pieces, path=tokenizer_path, end_id=end_id, size=size), PIECE_FIELDS)


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins, as lists of positions in ``sizes``, by best-fit decreasing; equal sizes in given order."""
    free: list[list[int]] = [[] for _ in range(room + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        if fits := mask >> size:
            left = size + (fits & -fits).bit_length() - 1
            k = free[left].pop()
            if not free[left]:
                mask &= ~(1 << left)
            bins[k].append(i)
        else:
            k, left = len(bins), room
            bins.append([i])
        left -= size
        if left:
            free[left].append(k)
            mask |= 1 << left
    return bins


def _handed_on(fills: list[int], room: int) -> list[bool]:
    """Which bins go up the tree: those that aren't nearly full, of each fill as many as can be needed."""
    seen, out = [0] * (room + 1), []
    for fill in fills:
        seen[fill] += 1
        out.append(room - fill > room // NEARLY_FULL and seen[fill] <= FAN_IN * LEVELS)
    return out


def _local(batches: Iterator[pa.RecordBatch], room: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The lowest level: packs the pieces of a partition, LOCAL_ITEMS at a time."""
    import numpy as np
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    groups = itertools.count(part, parts)

    def pack(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal made
        lengths = batch.column("length").to_pylist()
        bins = best_fit(lengths, room)
        fills = [sum(lengths[i] for i in members) for members in bins]
        counts = [len(members) for members in bins]
        rows = np.array([i for members in bins for i in members], dtype=np.int64)
        offsets = [at for members in bins for at in itertools.accumulate([0, *(lengths[i] for i in members[:-1])])]
        out = batch.take(pa.array(rows))
        number = (part << 36) + made + np.arange(len(bins))
        made += len(bins)
        columns = {
            "bin": np.repeat(number, counts), "offset": np.array(offsets, dtype=np.int64), "fill": np.repeat(np.array(fills, dtype=np.int64), counts),
            "handed": np.repeat(np.array(_handed_on(fills, room), dtype=bool), counts), "origin": np.full(len(rows), next(groups)),
        }
        for name, column in columns.items():
            out = out.append_column(name, pa.array(column))
        yield from out.to_batches()

    held: list[pa.RecordBatch] = []
    for b in (whole.slice(i, LOCAL_ITEMS) for whole in batches for i in range(0, whole.num_rows, LOCAL_ITEMS)):
        held.append(b)
        if sum(x.num_rows for x in held) >= LOCAL_ITEMS:
            yield from pack(pa.Table.from_batches(held))
            held = []
    if held:
        yield from pack(pa.Table.from_batches(held))


def _merged(pdf, room: int):
    """Packs the open bins of a group of a higher level; a sequence has the number of its first bin."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values(["fill", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
    fills, numbers = pdf["fill"].tolist(), pdf["bin"].to_numpy()
    packed = best_fit(fills, room)
    totals, counts = [sum(fills[i] for i in members) for members in packed], [len(members) for members in packed]
    rows = np.array([i for members in packed for i in members], dtype=np.int64)
    shifts = [at for members in packed for at in itertools.accumulate([0, *(fills[i] for i in members[:-1])])]
    heads = numbers[[members[0] for members in packed]]
    return pd.DataFrame({
        "bin": numbers[rows], "sequence": np.repeat(heads, counts), "shift": shifts, "fill": np.repeat(totals, counts),
        "handed": np.repeat(_handed_on(totals, room), counts), "origin": np.full(len(rows), pdf["origin"].iloc[0]),
    })


def best_fit_pack(pieces: DataFrame, size: int) -> DataFrame:
    """The pieces with sequence_id and offset: their sequence of at most ``size`` tokens and place in it.

    ``pieces`` has the columns of :func:`token_pieces` with lengths from 1 to ``size``. Sequences have
    no gaps and start at offset 0. Rows count one by one, also when ids repeat or are null; equal
    lengths are packed in the order of the rows. An empty table gives an empty result, and other
    columns are not looked at.
    """
    columns = [x.split()[0] for x in PIECE_FIELDS.split(", ")]
    pieces = pieces.select(columns)
    local = functools.partial(_local, room=size, parts=max(1, pieces.rdd.getNumPartitions()))
    placed = stored(pieces.mapInArrow(local, f"{PIECE_FIELDS}, bin long, offset long, fill long, handed boolean, origin long"), "pack")
    groups = (placed.agg(F.max("origin")).first()[0] or 0) + 1
    opened, moves = placed.where("handed and offset = 0").select("bin", "fill", "origin"), []
    while groups > 1:
        groups = -(-groups // FAN_IN)
        met = opened.withColumn("origin", F.floor(F.col("origin") / FAN_IN))
        merged = met.groupBy("origin").applyInPandas(functools.partial(_merged, room=size), "bin long, sequence long, shift long, fill long, handed boolean, origin long")
        level = stored(merged, "pack")
        moves.append(level.where("bin <> sequence").select("bin", "sequence", "shift"))
        opened = level.where("handed and bin = sequence").select("bin", "fill", "origin")
    if not moves:
        return placed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    # About one move for each group of the lowest level. What a bin moved into may have moved on a later level.
    final = moves.pop()
    while moves:
        later = final.select(F.col("bin").alias("sequence"), F.col("sequence").alias("last"), F.col("shift").alias("more"))
        earlier = moves.pop().join(later, "sequence", "left").select("bin", F.coalesce("last", "sequence").alias("sequence"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        final = earlier.unionByName(final)
    found = placed.join(sized(stored(final, "moves")), "bin", "left")
    return found.select(*columns, F.coalesce("sequence", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents, tokenised, cut and packed: the columns of :func:`token_pieces`, sequence_id and offset.

    Null texts count as empty, repeated rows are packed each for itself, equal lengths in the order of
    the rows. A very long text is cut into pieces, the first of which may be shorter. An empty table
    gives an empty result; columns are found by exact name, and others are not looked at.
    """
    return best_fit_pack(stored(token_pieces(docs, tokenizer_path, end_id, size, id_col, text_col), "pieces"), size)
