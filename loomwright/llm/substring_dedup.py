"""Substring dedup: removes words of passages that an earlier document has too, by level-wise doubling.

The lengths of the levels double up to that of the full window (13, 25, 50 words). At each level only
anchors count: the anchor of a window of the next length is the gram of this length in it with the
least hash (the last, of equals), so that equal windows have equal anchors at the same place. Grams
that a single document has end there; only windows around repeated anchors, all of whose parts of this
length are such, are extended to the next length. The full windows that are left are compared over
all documents by 128-bit hashes. Longer levels cannot add words to be removed: every window of twice
the length consists of full windows that are repeated themselves, so there the doubling ends.

Documents whose words all equal an earlier one's need no windows: all their windows are in that one.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import pick, sized, stored, values
from loomwright.llm.words import BASES, window_hashes, word_hashes, words_of

BATCH_ROWS, BATCH_CHARS = 200_000, 4_000_000
#: The first level has at least so many words, if the window has.
SHORTEST = 12
_SURVEY = "id long, kid long, th long, n_words long, digest binary, h array<long>, lo array<int>, hi array<int>"
_RANGES = "array<struct<lo:int,hi:int>>"


def level_lengths(window: int) -> list[int]:
    """The lengths of the levels, each at most twice the one before, the last of which is the window."""
    out = [window]
    while (out[0] + 1) // 2 >= min(SHORTEST, window):
        if out[0] == 1:
            break
        out.insert(0, (out[0] + 1) // 2)
    return out


def anchors(x, window: int, gram: int | None = None, wanted=None):
    """(hash, first window, last window) of the anchors of a text's windows (all, or the ``wanted`` ones), by its word hashes.

    Anchors are grams of so many words, or of half the window.
    """
    import numpy as np

    gram = gram or (window + 1) // 2
    grams = window_hashes(x, gram, BASES[0])
    span = window - gram + 1
    if len(grams) < span:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty
    places = []
    for i in range(0, len(grams) - span + 1, 65_536):
        view = np.lib.stride_tricks.sliding_window_view(grams[i : i + 65_536 + span - 1], span)
        places.append(span - 1 - np.argmin(view[:, ::-1], axis=1) + np.arange(i, i + len(view)))
    place = np.concatenate(places)
    if wanted is not None:
        place = np.where(wanted[: len(place)], place, -1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    real = place[first] >= 0
    return grams[np.maximum(place[first], 0)][real], first[real], last[real]


def _marked(ranges, n: int):
    """Whether each of n places lies in one of the ranges."""
    import numpy as np

    edge = np.zeros(n + 1, dtype=np.int64)
    for r in ranges:
        edge[r["lo"]] += 1
        edge[r["hi"] + 1] -= 1
    return np.cumsum(edge)[:-1] > 0


def _lists(rows: list[tuple], first: int) -> list[pa.Array]:
    """Arrow lists of the anchors in the places from ``first`` on."""
    import numpy as np

    ends = pa.array(np.cumsum([0, *(len(r[first]) for r in rows)]).astype(np.int32))
    flat = [np.concatenate([r[first + k] for r in rows]) for k in range(3)]
    kinds = [flat[0].astype(np.uint64).view(np.int64), flat[1].astype(np.int32), flat[2].astype(np.int32)]
    return [pa.ListArray.from_arrays(ends, pa.array(x)) for x in kinds]


def _survey(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For each document its number of words, a digest of them, and its anchors of the first level."""
    for b in batches:
        rows, chars = [], 0

        def flush(rows=rows):
            plain = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 4 + [pa.binary()])]
            return pa.RecordBatch.from_arrays([*plain, *_lists(rows, 5)], names=["id", "kid", "th", "n_words", "digest", "h", "lo", "hi"])

        for id_, kid, th, text in zip(*map(values, b.columns), strict=True):
            words = words_of(text)
            rows.append((id_, kid, th, len(words), hashlib.md5(b" ".join(words)).digest(), *anchors(word_hashes(words), window, gram)))
            chars += len(text or "")
            if chars >= BATCH_CHARS:
                yield flush()
                rows.clear()
                chars = 0
        if rows:
            yield flush()


def _extend(batches: Iterator[pa.RecordBatch], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    """The anchors, of so many words, of the windows of the next length of which all grams are in the given ranges."""
    import numpy as np

    for b in batches:
        rows, chars = [], 0

        def flush(rows=rows):
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), *_lists(rows, 3)], names=["id", "kid", "th", "h", "lo", "hi"])

        for id_, kid, th, text, ranges in zip(*map(values, b.columns), strict=True):
            x = word_hashes(words_of(text))
            alive = np.concatenate([[0], np.cumsum(_marked(ranges, max(len(x) - gram + 1, 0)))])
            span = window - gram + 1
            whole = alive[span:] - alive[:-span] == span if len(alive) > span else np.zeros(0, dtype=bool)
            if whole.any():
                rows.append((id_, kid, th, *anchors(x, window, gram, whole)))
                chars += len(text or "")
            if chars >= BATCH_CHARS:
                yield flush()
                rows.clear()
                chars = 0
        if rows:
            yield flush()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the full windows that start in the given ranges."""
    import numpy as np

    names = ["h1", "h2", "id", "kid", "th", "p"]
    for b in batches:
        held: list[tuple] = []
        size = 0

        def flush(held=held):
            one, two, late, kid, th, p = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(kid, mask=late), pa.array(kid), pa.array(th), pa.array(p)], names=names)

        for id_, kid, th, text, ranges in zip(*map(values, b.columns), strict=True):
            x = word_hashes(words_of(text))
            p = np.flatnonzero(_marked(ranges, max(len(x) - window + 1, 0)))
            one, two = (window_hashes(x, window, base)[p].view(np.int64) for base in BASES)
            for i in range(0, len(p), BATCH_ROWS):
                part = slice(i, i + BATCH_ROWS)
                n = len(p[part])
                held.append((one[part], two[part], np.full(n, id_ is None), np.full(n, kid), np.full(n, th), p[part].astype(np.int32)))
                size += n
                if size >= BATCH_ROWS:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words left of each text; starts are those of windows to be removed (null: none)."""
    import numpy as np

    names = ["id", "n_words", "n_removed", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for b in batches:
        rows, chars = [], 0
        for id_, text, starts in zip(*map(values, b.columns), strict=True):
            words, removed = words_of(text), 0
            n = len(words)
            if starts:
                edge = np.zeros(n + 1, dtype=np.int64)
                p = np.unique(np.array(starts, dtype=np.int64))
                edge[p] += 1
                edge[p + window] -= 1
                left = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
                removed, words = n - len(left), [words[i] for i in left]
            rows.append((id_, n, removed, b" ".join(words).decode("utf-8")))
            chars += len(text or "")
            if chars >= BATCH_CHARS:
                yield table(rows)
                rows, chars = [], 0
        if rows:
            yield table(rows)


def _later(found: DataFrame, *by: str) -> DataFrame:
    """The values of columns that more than one document has, with the first such id; a null id is later than all others."""
    each = found.groupBy(*by).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("late"))
    return each.where("first < last or (late and first is not null)").select(*by, "first")


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of each document.

    A word goes if a window of ``window`` words that covers it has a word sequence that starts in a
    document with a smaller id, too; all windows are judged on the input. Documents with fewer words
    lose none, null and empty texts have none. Null ids come after all others; rows of one id are not
    earlier than each other. Time and memory of a very long text grow with its length. Repeated rows
    repeat their result, an empty table gives an empty result; columns are found by exact name, and
    others, whatever their names, are not looked at.
    """
    rows = pick(docs, id=id_col, text=text_col)
    # kid and th tell rows apart, also those without an id; rows that have both in common have equal results.
    rows = rows.select("id", F.coalesce("id", F.lit(0)).alias("kid"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("id").isNull()).alias("th"), "text")
    key, lengths = ["kid", "th"], level_lengths(window)
    start = lengths[1] if len(lengths) > 1 else window
    survey = stored(rows.mapInArrow(functools.partial(_survey, window=start, gram=lengths[0]), _SURVEY), "survey")
    after = F.col("id").isNull() | (F.col("id") > F.col("first"))
    # Whole copies of an earlier document.
    same = stored(_later(survey, "digest"), "copied")
    copies = stored(survey.select("id", *key, "n_words", "digest").join(same, "digest").where(after).select(*key, "n_words").distinct(), "copies")
    found = survey.join(sized(copies.select(*key)), key, "left_anti").select("id", *key, "h", "lo", "hi")
    # Anchors that several documents have, level by level.
    for gram, longer in zip(lengths[:-1], lengths[1:], strict=True):
        if gram > lengths[0]:
            texts = rows.join(sized(ranges.select(*key)), key, "left_semi")
            extended = texts.join(ranges, key).select("id", *key, "text", "ranges").mapInArrow(
                functools.partial(_extend, gram=gram, window=longer), "id long, kid long, th long, h array<long>, lo array<int>, hi array<int>"
            )
            found = stored(extended, "extended")
        each = found.select("id", *key, F.explode(F.arrays_zip("h", "lo", "hi")).alias("a")).select("id", *key, "a.h", "a.lo", "a.hi")
        shared = stored(_later(each, "h").select("h"), "anchors")
        ranges = each.join(shared, "h").groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
        ranges = stored(ranges, "ranges")
    if len(lengths) == 1:
        ranges = stored(found.where(F.size("h") > 0).select(*key, F.transform("lo", lambda x, i: F.struct(x.alias("lo"), F.get("hi", i).alias("hi"))).cast(_RANGES).alias("ranges")).dropDuplicates(key), "ranges")
    # The full windows around them.
    texts = rows.join(sized(ranges.select(*key)), key, "left_semi")
    wide = texts.join(ranges, key).select("id", *key, "text", "ranges").mapInArrow(functools.partial(_windows, window=window), "h1 long, h2 long, id long, kid long, th long, p int")
    wide = stored(wide, "windows")
    repeated = stored(_later(wide, "h1", "h2"), "repeated")
    starts = stored(wide.join(repeated, ["h1", "h2"]).where(after).groupBy(*key).agg(F.collect_set("p").alias("starts")), "starts")
    kept = "id long, n_words long, n_removed long, kept string"
    cut = functools.partial(_cut, window=window)
    changed = rows.join(sized(starts.select(*key)), key, "left_semi").join(starts, key).select("id", "text", "starts").mapInArrow(cut, kept)
    whole = copies.where(F.col("n_words") >= window)
    gone = rows.select("id", *key).join(whole, key).select("id", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"))
    done = stored(starts.select(*key).unionByName(whole.select(*key)), "changed")
    rest = rows.join(sized(done), key, "left_anti").select("id", "text", F.lit(None).cast("array<int>").alias("starts")).mapInArrow(cut, kept)
    return changed.unionByName(gone).unionByName(rest).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept")
