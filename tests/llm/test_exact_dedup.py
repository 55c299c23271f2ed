import hashlib
import random

import pytest

from loomwright.llm.exact_dedup import drop_exact_copies, exact_dedup


def plain(rows, largest):
    out = []
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        best = (max(known) if largest else min(known)) if known else None
        kept = False
        for key in keys:
            out.append((key, best, len(keys), key == best and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept |= key == best
    return sorted(out, key=str)


def corpus(hot):
    draw = random.Random(hot)
    rows = [(i, draw.choice(["a", "b", "é" * 40, "same start, then x", "same start, then y", str(i)])) for i in range(80)]
    rows += [(100 + i, "hot text") for i in range(hot)] + [(500 + i, draw.choice([None, ""])) for i in range(hot // 2)]
    rows += [(None, "a"), (None, "only null"), (None, "only null"), (3, "twice"), (3, "twice"), (99, "Z" * 30_000), (98, "Z" * 30_000), (97, "Z" * 30_000)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [0, 300])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_against_brute_force(spark, hot, keep):
    rows = corpus(hot)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, TEXT string, h int")
    got = exact_dedup(df, keep=keep).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, keep == "largest")
    left = drop_exact_copies(df, keep=keep)
    assert left.columns == df.columns
    left = left.toDF("doc_id", "text", "t2", "h").collect()
    want = [(r[0], r[4]) for r in plain(rows, keep == "largest") if r[3]]
    assert sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in left), key=str) == sorted(want, key=str)


def test_empty_table_and_bad_choice(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(empty, keep="any")
