import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import language_id as li
from loomwright.llm.common import held_out, table
from loomwright.llm.queries import op2_language_id

DIR = "/root/testdata/sf0.01"
TEXTS = {"en": "the thing and that other thing was with them", "de": "und der die das nicht auch schön für über", "fr": "les choses et une autre été où être à la"}


@pytest.fixture(scope="module")
def model():
    return li.fit([t[i:] for t in TEXTS.values() for i in range(6)], [lang for lang in TEXTS for _ in range(6)])


def test_held_out_accuracy(spark):
    docs = table(spark, DIR, "documents")
    rows = op2_language_id(spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 100
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 30])
def test_codewords_tell_languages_apart(n):
    codes = li.codewords(n)
    assert len(codes) == n and set(np.unique(codes)) <= {-1.0, 1.0}
    assert n == 1 or min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) >= (1 if n == 2 else 2 ** max(min(n, 6) - 2, 0))


def test_odd_texts(spark, model):
    texts = [None, "", "123 \n!", "½ ²", "the that", "ß" * 50_000, "Ω", "a"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(4, "the that", "x"), (None, "und die", "x")], "doc_id long, text string, Text string")
    got = li.predict_language(df, model).collect()
    assert len(got) == len(texts) + 2
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["ambiguous"] for i in range(4))
    assert by[4]["lang_pred"] == "en" and by[None]["lang_pred"] == "de" and all(by[i]["lang_pred"] in TEXTS for i in (5, 6, 7))
    left = li.drop_undetermined(df, model)
    assert left.columns == df.columns and left.count() == len(texts) + 2 - 4


def test_without_labels_or_rows(spark, model):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    nothing = li.learn(df, F.lit(True))
    assert nothing is None and li.predict_language(df, nothing).first()["lang_pred"] == "und" and li.drop_undetermined(df, nothing).count() == 1
    empty = df.limit(0)
    assert li.predict_language(empty, model).count() == 0 and li.drop_undetermined(empty, model).count() == 0


def test_learns_from_usable_rows_only(spark):
    rows = [(i, text, lang) for i, (lang, text) in enumerate([*TEXTS.items()] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = df.withColumn("lang", F.when(held_out(F.col("doc_id")), "wrong").otherwise(F.col("lang")))
    assert li.learn(wrong, ~held_out(F.col("doc_id"))).languages == sorted(TEXTS)


def test_margins_of_equal_length_are_ambiguous(model):
    best, score, unsure = model.decode(np.zeros((1, model.codes.shape[1])))
    assert unsure[0] and score[0] <= 1


def test_a_language_of_long_texts_alone_is_learned(spark):
    rows = [(i, TEXTS["en"], "en") for i in range(20)] + [(100 + i, (TEXTS["de"] + " ") * 700, "de") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(df, F.lit(True))
    assert model.languages == ["de", "en"]
    assert all(r["lang_pred"] == ("en" if r["doc_id"] < 100 else "de") for r in li.predict_language(df, model).collect())


def test_the_sample_is_bounded_and_loses_no_language(spark):
    rows = [(i, TEXTS["en"], "en") for i in range(300)] + [(1000, TEXTS["de"], "de")] * 300 + [(None, TEXTS["fr"], "fr"), (None, None, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert li.learn(df, F.lit(True), train_texts=5).languages == ["de", "en", "fr"]


def test_learning_on_executors_is_fitting(spark):
    rows = [(i, text[k:], lang) for i, (lang, text, k) in enumerate((x, t, k) for x, t in TEXTS.items() for k in range(6))]
    got = li.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True))
    want = li.fit([r[1] for r in rows], [r[2] for r in rows])
    assert got.languages == want.languages and (got.codes == want.codes).all()
    assert np.allclose(got.weights, want.weights, rtol=1e-4, atol=1e-5) and np.allclose(got.trust, want.trust)


def test_many_languages(spark):
    rows = [(10 * i + k, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + (i + j * k) % 26)}" for j in range(40)), f"l{i:03}") for i in range(200) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.learn(df, F.lit(True))
    assert len(model.languages) == 200 and model.weights.nbytes <= 64 * 4 << li.HASH_BITS
    right = [r["lang_pred"] == f"l{r['doc_id'] // 10:03}" for r in li.predict_language(df, model).collect()]
    assert sum(right) >= 0.9 * len(right)


def plain_decode(model, text):
    """The definition, written out: trigrams, mean weight for each bit, weighted loss for each codeword."""
    raw = b" " + bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()) + b"  "
    grams = [raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16 for i in range(len(raw) - 2)]
    hashed = [(g * 2654435761 % 2**32) >> (32 - li.HASH_BITS) for g in grams]
    means = [sum(float(w[h]) for h in hashed) / len(hashed) for w in model.weights]
    losses = [sum(t * np.logaddexp(0, -m * c) for m, c, t in zip(means, code, trust, strict=True)) for code, trust in zip(model.codes, model.trust, strict=True)]
    order = sorted(range(len(losses)), key=lambda k: losses[k])
    likely = [np.exp(-4 * (x - min(losses))) for x in losses]
    return model.languages[order[0]], max(likely) / sum(likely), losses[order[1]] - losses[order[0]] < li.MARGIN


def test_against_a_plain_decoder(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = li.learn(docs, ~held_out(F.col("doc_id")))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in li.predict_language(docs, model).collect():
        text = texts[r["doc_id"]]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
            continue
        lang, score, unsure = plain_decode(model, text)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6 and r["ambiguous"] == unsure
