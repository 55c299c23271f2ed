"""SentencePiece encoding and decoding with a distinct-chunk table.

In the vocabularies meant here, white-space markers occur only at the start of a piece, so no piece
crosses from one marked word (a run of markers and what follows up to the next marker) into the
next. BPE merges therefore never cross either, and every distinct marked word needs to be segmented
only once. Each worker keeps a table from marked words to ids; a text's ids are the table's entries
joined by position. The table is local to a worker, so no row is shuffled.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomwright.llm.chunks import ChunkTable
from loomwright.llm.common import pick, values

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of text that are turned into one Arrow batch.
BATCH_CHARS = 4_000_000


@functools.cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def whole_words_only(path: str) -> bool:
    """True if the model's pieces hold markers only at their start, and nothing is normalised away."""
    sp = _processor(path)
    probe = " a  b  ﬁ"
    plain = sp.normalize(probe).replace(MARK, " ") == " " + probe
    return plain and not any(re.search(f"[^{MARK}]{MARK}", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


@functools.cache
def _table(path: str) -> ChunkTable:
    """From a marked word less its first marker to (ids as int32 bytes, decoded text).

    The library puts one marker before whatever it encodes, and takes one off what it decodes.
    """
    sp = _processor(path)
    alone = [sp.piece_to_id(MARK)]

    def compute(word: str) -> tuple[bytes, str]:
        ids = sp.encode(word) if word else alone
        return array("i", ids).tobytes(), sp.decode(ids)

    return ChunkTable(compute)


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, with markers as spaces."""
    if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [w[1:].replace(MARK, " ") for w in _MARKED.findall((" " + text).replace(" ", MARK))]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    import numpy as np

    get = _table(path).__getitem__
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def batch(keys: list, ids: list[bytes], decoded: list[str]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends), flat)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, pa.array(decoded, pa.string())], schema=schema)

    for b in batches:
        keys, ids, decoded, chars = [], [], [], 0
        for key, text in zip(values(b.column(0)), values(b.column(1)), strict=True):
            parts = [get(w) for w in marked_words(text)] if text else []
            keys.append(key)
            ids.append(b"".join([p[0] for p in parts]))
            decoded.append(" ".join([p[1] for p in parts]))
            chars += len(text or "")
            if chars >= BATCH_CHARS:
                yield batch(keys, ids, decoded)
                keys, ids, decoded, chars = [], [], [], 0
        if keys:
            yield batch(keys, ids, decoded)


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (as the library's ``encode``) and decoded (as its ``decode(ids)``) of each text.

    ``model_path`` must be readable on every executor. A null text counts as empty: no ids, empty
    decoded text. Rows are independent: repeated rows repeat their result, a null id keeps it, a very long
    text is held whole with its ids, an empty table gives an empty result; columns are found by exact
    name, and others, whatever their names, are not looked at. Characters outside the vocabulary become
    bytes where the model has them. A model whose pieces cross markers, or that normalises text, is
    refused with a ValueError.
    """
    if not whole_words_only(model_path):
        raise ValueError("the model's pieces cross white-space markers, or it normalises text")
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(functools.partial(_encode, path=model_path), "doc_id long, ids array<int>, decoded string")
