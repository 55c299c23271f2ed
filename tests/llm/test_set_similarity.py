import random

import pytest

import corpus_pipeline as cp
from loomwright.llm import simhash
from loomwright.llm.set_similarity import drop_near_copies, near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_components(rows, similarity):
    sets = [set(simhash.shingle_hashes(t or "", 5)) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min([rows[i][0] for i, y in enumerate(label) if y == x and rows[i][0] is not None], default=None) for x in label}
    return sorted(((rows[i][0], least[x]) for i, x in enumerate(label) if label.count(x) > 1), key=str)


def edited_copies(seed):
    """Texts whose similarities lie on both sides of 0.8, in families, with a common line."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefgh") * draw.randint(1, 4) + str(draw.randint(0, 300))
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE two"), (None, "no id here"), (None, "no id here")]
    line = " ".join(f"common{i}" for i in range(12))
    for i in range(14):
        words = [word() for _ in range(draw.choice([4, 7, 30, 150, 600]))]
        rows.append((i, " ".join(words)))
        for k in range(draw.randint(1, 6)):
            copy = list(words)
            for at in draw.sample(range(len(copy)), draw.randint(0, max(1, len(copy) // 38))):
                copy[at] = word()
            rows.append((20 + 10 * i + k, " ".join(copy) + (" " + line if k == 3 else "")))
    rows += [(500 + i, f"{line} {word()}") for i in range(10)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,similarity", [(1, 0.8), (2, 0.8), (3, 0.55)])
def test_against_brute_force(spark, seed, similarity):
    rows = edited_copies(seed)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, similarity).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows, similarity)


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    return sorted(r["doc_id"] for r in cp.no_near_copies(spark, docs, "").collect())


def test_stage_finds_copies_of_distant_fingerprints(spark):
    rows, far = [], 0
    for i in range(20):
        words = [f"w{i}x{k}" for k in range(300)]
        copy = [f"n{i}" if k % 60 == 30 else w for k, w in enumerate(words)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        far += (simhash.fingerprint(rows[-1][1], 5) ^ simhash.fingerprint(rows[-2][1], 5)).bit_count() > 8
    assert far
    assert stage(spark, rows) == list(range(0, 40, 2))


def test_stage_keeps_different_texts_of_one_fingerprint(spark):
    filler = " ".join(["all rights reserved by us"] + ["spam"] * 200)
    rows = [(i, filler + " " + " ".join(f"{c}{k}" for k in range(60))) for i, c in enumerate("abc")]
    assert len({simhash.fingerprint(t, 5) for _, t in rows}) == 1
    assert stage(spark, rows) == [0, 1, 2]


def test_stage_decides_by_whole_sets(spark):
    """Pairs of sets of 1,980 shingles; from 1,760 common ones on, their similarity is 0.8 or more."""
    rows, want = [], []
    for i, (changed, kept) in enumerate([(216, 2), (219, 2), (220, 1), (230, 1)]):
        new = (1980 - 1760) + (220 - changed)
        words = [f"v{i}x{k}" for k in range(1984)]
        copy = words[: 1984 - new] + [f"z{i}x{k}" for k in range(new)]
        a, b = (set(simhash.shingle_hashes(" ".join(t), 5)) for t in (words, copy))
        assert (len(a & b) >= 0.8 * len(a | b)) == (kept == 1)
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(copy))]
        want += [10 * i, 10 * i + 1][:kept]
    assert stage(spark, rows) == want


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, TOKEN string").toDF("doc_id", "text", "row")
    assert drop_near_copies(df).columns == df.columns and drop_near_copies(df).count() == 0


def test_similar_sets_share_as_many_signatures_as_they_need():
    """Pairs of all sizes, at and above the similarity: the guarantee that the second step rests on."""
    import collections

    import numpy as np

    from loomwright.llm.set_similarity import signatures

    draw = np.random.default_rng(5)
    for similarity in (0.8, 0.7, 0.9, 0.6):
        for _ in range(150):
            n = int(draw.choice([1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 17, 25, 40, 99, 300, 1500]))
            x = draw.integers(0, 1 << 63, n).astype(np.uint64)
            gone = int(draw.integers(0, n))
            added = int(draw.integers(0, n))
            while n - gone < similarity * (n + added) - 1e-12:
                gone, added = (gone // 2, added // 2) if gone + added > 1 else (0, 0)
            y = np.unique(np.concatenate([x[gone:], draw.integers(0, 1 << 63, added).astype(np.uint64)]))
            x = np.unique(x)
            assert len(np.intersect1d(x, y)) >= similarity * len(np.union1d(x, y)) - 1e-9
            made = collections.defaultdict(dict)
            for i, scheme, need, s in signatures([x, y], similarity):
                assert scheme not in made[i] and len(set(s.tolist())) == len(s)
                made[i][scheme] = need, set(s.tolist())
            common = [(len(made[0][k][1] & made[1][k][1]), max(made[0][k][0], made[1][k][0])) for k in made[0] if k in made[1]]
            assert any(c >= max(need, 1) for c, need in common), (similarity, len(x), len(y), common)


def test_shingles_are_told_apart_like_those_of_texts():
    from loomwright.llm.words import rolled_shingles

    texts = ["a b c d e f", "A b\tc  d\x0be\n f ", "", None, " ", "one two", "one twO", "onetwo", "aa aaa", "aaa aa", "\x1ca\xa0b c", "é É e", "a b c d e", "x " * 5000 + "a b c d e f"]
    rolled = [set(x.tolist()) for x in rolled_shingles(texts, 5)]
    known = [set(simhash.shingle_hashes(t or "", 5)) for t in texts]
    for i in range(len(texts)):
        assert len(rolled[i]) == len(known[i]) and len(rolled_shingles([texts[i]], 5)[0]) == len(simhash.shingle_hashes(texts[i] or "", 5))
        for j in range(len(texts)):
            assert len(rolled[i] & rolled[j]) == len(known[i] & known[j]), (texts[i], texts[j])
    assert rolled_shingles([], 5) == []


def test_many_links_are_joined_in_rounds(spark, monkeypatch):
    monkeypatch.setattr("loomwright.llm.components.FEW_LINKS", 0)
    rows = edited_copies(4)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows, 0.8)


def joined_rows(spark, seen):
    """Rows that the joins of all queries but the first ``seen`` made, and the number of queries."""
    store = spark._jsparkSession.sharedState().statusStore()
    queries, out = store.executionsList(), 0
    for i in range(seen, queries.size()):
        at = queries.apply(i).executionId()
        nodes, counted = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in map(nodes.apply, range(nodes.size())):
            for metric in map(node.metrics().apply, range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and (value := counted.get(metric.accumulatorId())).isDefined():
                    out = max(out, int(value.get().replace(",", "")))
    return out, queries.size()


def test_texts_that_share_a_passage_are_not_paired(spark):
    """Each alone could have a similar text, as 36 of its 42 shingles are shared; no two are similar (36 of 48)."""
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{passage} " + " ".join(f"x{i}y{k}" for k in range(6))) for i in range(400)]
    rows.append((1000, rows[7][1].replace("y5", "z5")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = joined_rows(spark, 1 << 30)[1]
    assert sorted(map(tuple, near_copies(docs, 5, 0.8).collect())) == [(7, 7), (1000, 7)]
    assert joined_rows(spark, seen)[0] < 401 * 400 // 4


@pytest.mark.parametrize("similarity", [0.55, 0.8])
def test_similar_sets_of_other_groups_meet(spark, similarity):
    """Sets that are edits of a few, some in groups that are known already: each similar pair of two groups comes out."""
    from loomwright.llm.set_similarity import _meetable, _meetings, _postings

    draw, sets = random.Random(6), []
    for _ in range(12):
        first = draw.sample(range(400), draw.choice([1, 2, 5, 20, 60]))
        sets += [frozenset(first) - frozenset(draw.sample(first, draw.randint(0, len(first) // 6))) | frozenset(draw.sample(range(400), draw.randint(0, len(first) // 6))) for _ in range(12)]
    rows = [(i, i - i % draw.choice([1, 1, 3]), sorted(s)) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "a long, ga long, shingles array<long>")
    got = {tuple(r) for r in _meetings(_meetable(_postings(frame, similarity), similarity), similarity).collect()}
    want = {(a, b) for b, gb, y in rows for a, ga, x in rows[:b] if ga != gb and len({*x} & {*y}) >= similarity * len({*x} | {*y})}
    assert want and want <= got and all(rows[a][1] != rows[b][1] for a, b in got)
