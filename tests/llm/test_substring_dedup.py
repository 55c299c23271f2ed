import random
import re

import numpy as np
import pytest

from loomwright.llm import substring_dedup as sd


def plain(rows, window):
    out, texts = [], [(key, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for key, t in rows]
    least = {}
    for key, words in texts:
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            least[w] = min(least.get(w, float("inf")), float("inf") if key is None else key)
    for key, words in texts:
        gone = set()
        for p in range(len(words) - window + 1):
            if least[tuple(words[p : p + window])] < (float("inf") if key is None else key):
                gone |= set(range(p, p + window))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def run(spark, rows, window):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, Text string, h int")
    return sorted(map(tuple, sd.substring_dedup(df, window).collect()), key=str)


def corpus(seed, window, n=60):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "é", "d", "eee", "F", "g,", "\xa0h"])
    passages = [[word() for _ in range(draw.choice([window - 1, window, window + 3, 3 * window]))] for _ in range(5)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 4)):
            words += [word() for _ in range(draw.randint(0, 2 * window))] if draw.random() < 0.5 else draw.choice(passages)
        if rows and draw.random() < 0.2:
            words = (draw.choice(rows)[1] or "").split()
        rows.append((i, draw.choice([" ", "\t", "  ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("window", [7, 10, 24, 50])
def test_against_brute_force(spark, window):
    rows = corpus(window, window)
    rows += [(100, None), (101, ""), (3, rows[3][1]), (3, rows[5][1]), (None, rows[7][1]), (None, rows[8][1]), (102, "a " * 40), (103, "a " * 30), (-5, "a " * 12)]
    draw = random.Random(1)
    draw.shuffle(rows)
    assert run(spark, rows, window) == plain(rows, window)


def test_windows_of_one_word_and_no_repeats(spark):
    rows = [(1, "a b c"), (2, "c d"), (3, "e")]
    assert run(spark, rows, 1) == plain(rows, 1)
    assert run(spark, rows, 50) == plain(rows, 50)


def test_empty_table(spark):
    assert run(spark, [], 50) == []


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(0)
    x = draw.integers(0, 4, 400).astype(np.uint64)
    y = np.concatenate([draw.integers(0, 4, 37).astype(np.uint64), x[100:190], draw.integers(0, 4, 20).astype(np.uint64)])
    of = lambda z: {p: (int(h), p) for h, lo, hi in zip(*sd.anchors(z, 20), strict=True) for p in range(lo, hi + 1)}
    one, two = of(x), of(y)
    assert sorted(one) == list(range(400 - 19))
    for p in range(100, 190 - 19):
        assert one[p][0] == two[p - 100 + 37][0]
    assert (sd.window_hashes(x, 20, sd.BASES[1])[100:171] == sd.window_hashes(y, 20, sd.BASES[1])[37:108]).all()


@pytest.mark.parametrize("window,lengths", [(50, [13, 25, 50]), (1, [1]), (5, [5]), (20, [20]), (24, [12, 24]), (100, [13, 25, 50, 100])])
def test_lengths_double(window, lengths):
    assert sd.level_lengths(window) == lengths


def test_anchors_of_wanted_windows_alone():
    x = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    wanted = np.zeros(251, dtype=bool)
    wanted[[3, 4, 5, 100, 250]] = True
    every = {p: int(h) for h, lo, hi in zip(*sd.anchors(x, 50, 25), strict=True) for p in range(lo, hi + 1)}
    some = {p: int(h) for h, lo, hi in zip(*sd.anchors(x, 50, 25, wanted), strict=True) for p in range(lo, hi + 1)}
    assert some == {p: every[p] for p in (3, 4, 5, 100, 250)}


def test_greatest_id_is_an_id_like_any_other(spark):
    top = (1 << 63) - 1
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(top, "x " + text), (None, text + " y"), (0, "a b"), (None, text + " y")]
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()}
    assert got == {(top, 31, 0), (None, 31, 30), (0, 2, 0)}
    rows = [(None, text + " y"), (None, "z " + text)]
    assert all(r["n_removed"] == 0 for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect())


def test_a_very_long_text_and_a_frequent_passage(spark):
    line = " ".join(f"c{i}" for i in range(60))
    long = " ".join(f"u{i}" for i in range(150_000))
    rows = [(i, f"{i} {line} {i}") for i in range(300)] + [(1000, long), (1001, "start " + long)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got[0] == (62, 0) and all(got[i] == (62, 60) for i in range(1, 300))
    assert got[1000] == (150_000, 0) and got[1001] == (150_001, 150_000)
