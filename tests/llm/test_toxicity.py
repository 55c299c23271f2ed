from loomwright.llm import toxicity as tx
from loomwright.llm.common import table
from loomwright.llm.queries import op7_toxicity

DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = table(spark, DIR, "labels").select("doc_id", "toxic")
    rows = op7_toxicity(spark, DIR).join(labels, "doc_id").where("held_out").collect()
    right = {t: [r["predicted"] == t for r in rows if r["toxic"] == t] for t in (0, 1)}
    assert sum(right[0]) >= 0.98 * len(right[0]) and sum(right[1]) >= 0.8 * len(right[1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def small_model():
    clean = [f"a quiet walk by the river number {i} with a stupid fish" if i % 9 == 0 else f"a quiet walk by the river number {i}" for i in range(90)]
    bad = [f"a quiet walk by the {w} number {i}" for i in range(30) for w in ("blorg", "snarfing")]
    return tx.fit(clean + bad, [0] * len(clean) + [1] * len(bad), [1.0] * (len(clean) + len(bad)))


def test_folding_finds_disguised_words():
    assert tx.fold("Ｂl0rg, BLОRG!\tbl​org  naïve") == " blorg blorgi blorg naive "
    model = small_model()
    plain = model.score("a quiet blorg by the river")
    assert plain > 0.5 > model.score("a quiet walk by the river")
    for text in ("a quiet BL0RG by the river", "a quiet blоrg by the river", "a quiet b​lorg by the river", "a quiet ｂｌｏｒｇ by the river"):
        assert model.score(text) == plain, text


def test_stems_and_excuses():
    model = small_model()
    assert model.score("by the snarfing") > 0.5
    excused = tx.ToxicityModel({" stupid ": 5.0}, [" stupid fish "], (-3.0, 1.0, 1.0, 0.0))
    assert excused.score("a stupid fish") < 0.5 < excused.score("a stupid dog")


def test_odd_texts(spark):
    model = small_model()
    texts = [None, "", " ", "blorg " * 50_000, "🎉", "x"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "blorg", 1), (5, "x", 1)], "doc_id long, text string, TEXT int")
    got = {r["doc_id"]: r["score"] for r in tx.score_toxicity(df, model).collect()}
    assert got[0] == got[1] == got[2] < 0.5 and got[3] > 0.5 and got[None] > 0.5
    assert tx.score_toxicity(df.limit(0), model).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)], [(1, 1), (1, 0), (None, 1)]):
        df = spark.createDataFrame(labels, "doc_id long, toxic int")
        model = tx.learn(docs, df, df["doc_id"].isNotNull())
        assert all(0 <= r["score"] <= 1 for r in tx.score_toxicity(docs, model).collect())


def plain_features(model, text):
    """The definition, written out, without automaton and sweep."""
    folded = tx.fold(text)
    places = lambda t: [i for i in range(len(folded)) if folded.startswith(t, i)]
    excused = [(i, i + len(p) - 1) for p in model.excuses for i in places(p)]
    best = {}
    for term, weight in model.lexicon.items():
        for i in places(term):
            if not any(a <= i and i + len(term) - 2 <= z for a, z in excused):
                best[i] = max(best.get(i, 0.0), weight)
    words = len(folded.split()) or 1
    return [max(best.values(), default=0.0), sum(best.values()) / words**0.5, 100 * len(best) / words]


def test_against_a_plain_lexicon_scorer(spark):
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = tx.learn(docs, table(spark, "/root/testdata/sf0.01", "labels"), F.col("doc_id") % 5 != 0)
    some = tx.ToxicityModel({**model.lexicon, " bad ": 3.0, " badl": 2.0, " fish ": 1.0}, [*model.excuses, " bad fish ", " not bad "], model.curve)
    texts = ["", "bad", "a bad fish", "not bad fish", "badly not bad badly", "bad bad fish bad", *(r["text"] for r in docs.where("length(text) < 3000").limit(150).collect())]
    for text in texts:
        assert some.features(text or "") == plain_features(some, text or ""), text


def test_learning_on_executors_is_fitting(spark):
    from pyspark.sql import functions as F

    texts = [f"a quiet walk by the river number {i} with a stupid fish" if i % 9 == 0 else f"a quiet walk by the river number {i}" for i in range(90)]
    texts += [f"a quiet walk by the {w} number {i}" for i in range(30) for w in ("blorg", "snarfing")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, TOXIC int").repartition(3)
    labels = spark.createDataFrame([(i, int(i >= 90)) for i in range(150)], "doc_id long, toxic int")
    got, want = tx.learn(docs, labels, F.lit(True)), small_model()
    assert got.lexicon == want.lexicon and got.excuses == want.excuses
    assert all(abs(a - b) < 1e-9 for a, b in zip(got.curve, want.curve, strict=True))
    few = tx.learn(docs, labels, F.lit(True), train_texts=20)
    assert all(0 <= r["score"] <= 1 for r in tx.score_toxicity(docs, few).collect())


def test_a_label_of_long_texts_alone_is_learned(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"a quiet walk number {i} ") for i in range(30)] + [(100 + i, "a blorg walk " * 3000) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = tx.learn(docs, docs.select("doc_id", (F.col("doc_id") >= 100).cast("int").alias("toxic")), F.lit(True))
    assert model.score("a blorg walk") > 0.5 > model.score("a quiet walk")


def test_excused_terms_take_linear_time():
    import time

    model = tx.ToxicityModel({" stupid ": 5.0}, [" stupid fish ", " a stupid "], (-3.0, 1.0, 1.0, 0.0))
    spent = []
    for n in (20_000, 60_000):
        began = time.perf_counter()
        assert model.features("a stupid fish swims " * n)[0] == 0.0
        spent.append(time.perf_counter() - began)
    assert spent[1] < 8 * spent[0] + 0.5
