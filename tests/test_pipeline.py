"""Estimators, pipelines, persistence, streams and sources."""

import math
from fractions import Fraction

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

import loomwright.operators as op
from loomwright.plans.pipeline import FeaturePipeline, FeaturePipelineModel, Graph
from loomwright.plans.tuning import choices, grid
from loomwright.queries import QUERIES
from loomwright.sources.tables import read_table, write_table
from loomwright.streaming.transform import transform_stream, write_batches

ROWS = [(1.0, 2.0, 3.0, "a", "c", [1.0, 2.0, 3.0]), (4.0, 2.0, 6.0, "b", "c", [4.0, 2.0, 6.0]), (7.0, 8.0, 3.0, "a", "a", [7.0, 8.0, 3.0])]
SCHEMA = "col1 double, col2 double, col3 double, col4 string, col5 string, arr array<double>"


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_standard_scale(spark, df):
    model = op.StandardScaleEstimator(inputCol="arr", outputCol="x").fit(df)
    assert model.getMean() == [4.0, 4.0, 4.0]
    assert model.getStddev() == pytest.approx([2.449489742783178, 2.8284271247461903, 1.4142135623730951])
    assert model.transform(df).first()["x"] == pytest.approx([-3 / 2.449489742783178, -2 / 2.8284271247461903, -1 / 1.4142135623730951])
    masked = op.StandardScaleEstimator(inputCol="col2", outputCol="x", maskValue=8.0).fit(df)
    assert masked.getMean() == [2.0] and [r["x"] for r in masked.transform(df).collect()] == [0.0, 0.0, 8.0]
    nested = spark.createDataFrame([([[1.0, 10.0], [3.0, 30.0]],), ([[5.0, 50.0]],)], "a array<array<double>>")
    model = op.StandardScaleEstimator(inputCol="a", outputCol="x").fit(nested)
    assert model.getMean() == [3.0, 30.0] and model.transform(nested).collect()[1]["x"][0] == pytest.approx([2 / math.sqrt(8 / 3)] * 2)


def test_other_scalers(spark, df):
    one = op.SingleFeatureArrayStandardScaleEstimator(inputCol="arr", outputCol="x").fit(df)
    values = [x for r in ROWS for x in r[5]]
    mean = sum(values) / 9
    assert one.getMean() == pytest.approx([mean] * 3)
    assert one.getStddev() == pytest.approx([math.sqrt(sum((v - mean) ** 2 for v in values) / 9)] * 3)
    span = op.MinMaxScaleEstimator(inputCol="arr", outputCol="x").fit(df)
    assert (span.getMin(), span.getMax()) == ([1.0, 2.0, 3.0], [7.0, 8.0, 6.0])
    assert span.transform(df).first()["x"] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        op.MinMaxScaleEstimator(inputCol="a", outputCol="x").fit(spark.createDataFrame([(None,)], "a double"))


def test_conditional_scale(spark):
    rows = [(1.0, 1.0, 1.0), (1.0, 0.0, 1.0), (1.0, 2.0, 0.0), (-1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "m double, r double, x double")
    mask = {"maskCols": ["m"], "maskOperators": ["gt"], "maskValues": [0.0], "inputCol": "x", "outputCol": "y"}
    model = op.ConditionalStandardScaleEstimator(**mask).fit(df)
    assert model.getMean()[0] == pytest.approx(2 / 3) and model.getStddev()[0] == pytest.approx(math.sqrt(2 / 9))
    model = op.ConditionalStandardScaleEstimator(**mask, relevanceCol="r", skipZeros=True, epsilon=0.5).fit(df)
    assert (model.getMean(), model.getStddev()) == ([1.0], [0.0])
    assert [r["y"] for r in model.transform(df).collect()] == [0.0, 0.0, 0.0, 0.0]
    model = op.ConditionalStandardScaleEstimator(**mask, relevanceCol="r", scalingFunction="binary").fit(df)
    assert model.getMean() == [0.5] and model.getStddev() == pytest.approx([math.sqrt(0.5)])
    with pytest.raises(ValueError, match="no row"):
        op.ConditionalStandardScaleEstimator(**{**mask, "maskValues": [9.0]}).fit(df)
    with pytest.raises(ValueError, match="together"):
        op.ConditionalStandardScaleEstimator(inputCol="x", outputCol="y", maskCols=["m"]).fit(df)
    filled = op.ConditionalStandardScaleEstimator(inputCol="x", outputCol="y", skipZeros=True, epsilon=100, nanFillValue=0).fit(df)
    assert (filled.getMean(), filled.getStddev()) == ([0.0], [0.0])


def test_impute(spark, df):
    fit = lambda **p: op.ImputeEstimator(inputCol="col1", outputCol="x", **p).fit(df).getImputeValue()
    assert fit(imputeMethod="median", maskValue=7.0) == 2.5 and fit(imputeMethod="mean", maskValue=7.0) == 2.5 and fit(imputeMethod="mean") == 4.0
    model = op.ImputeEstimator(inputCol="a", outputCol="x", imputeMethod="mean").fit(spark.createDataFrame([([1.0, None, 3.0],), (None,)], "a array<double>"))
    assert model.transform(spark.createDataFrame([([None, 5.0],)], "a array<double>")).first()["x"] == [2.0, 5.0]
    with pytest.raises(ValueError):
        op.ImputeEstimator(inputCol="col1", outputCol="x", imputeMethod="mode")


@pytest.mark.parametrize("order,labels", [("frequencyDesc", ["a", "b"]), ("frequencyAsc", ["b", "a"]), ("alphabeticalAsc", ["a", "b"]), ("alphabeticalDesc", ["b", "a"])])
def test_vocabulary_orders(df, order, labels):
    assert op.StringIndexEstimator(inputCol="col4", outputCol="x", stringOrderType=order).fit(df).getLabelsArray() == labels


def test_vocabularies_leave_out_nulls_and_masks(spark, df):
    rows = spark.createDataFrame([(["b", None, "m"], "a"), (None, "b")], "a array<string>, b string")
    shared = op.SharedStringIndexEstimator(inputCols=["a", "b"], outputCols=["x", "y"], maskToken="m").fit(rows)
    assert shared.getLabelsArray() == ["b", "a"]
    assert op.OneHotEncodeEstimator(inputCol="b", outputCol="x", maxNumLabels=1).fit(rows).getLabelsArray() == ["a"]


def test_pipeline_fits_in_any_order_and_prunes(spark, df):
    stages = [
        op.StandardScaleEstimator(inputCol="both", outputCol="scaled"),
        op.ArrayConcatenateTransformer(inputCols=["l", "col2"], outputCol="both"),
        op.LogTransformer(inputCol="col1", outputCol="l"),
        op.ExpTransformer(inputCol="scaled_sum", outputCol="unused"),
        op.SumTransformer(inputCols=["col1", "col2"], outputCol="scaled_sum"),
        FeaturePipeline([op.StringIndexEstimator(inputCol="col4", outputCol="col4_index"), op.IdentityTransformer(inputCol="col4_index", outputCol="copy")]),
    ]
    pipeline = FeaturePipeline(stages)
    graph = pipeline.graph(df.columns)
    assert graph.ancestors([0, 5]) == {1, 2} and graph.levels()[0] == [2, 4, 5]
    model = pipeline.fit(df)
    out = model.transform(df)
    assert set(out.columns) == set(df.columns) | {"scaled", "both", "l", "unused", "scaled_sum", "col4_index", "copy"}
    assert [r["copy"] for r in out.collect()] == [1, 2, 1] and model.lineage()["scaled"]["reads"] == ["both"]


def test_columns_made_anew(df):
    stages = [op.SumTransformer(inputCol="col1", outputCol="col1", mathFloatConstant=1.0), op.MultiplyTransformer(inputCol="col1", outputCol="col1", mathFloatConstant=10.0), op.IdentityTransformer(inputCol="col1", outputCol="x")]
    assert [r["x"] for r in FeaturePipeline(stages).fit(df).transform(df).collect()] == [20.0, 50.0, 80.0]
    before = [op.IdentityTransformer(inputCol="col1", outputCol="old"), op.SumTransformer(inputCol="col1", outputCol="col1", mathFloatConstant=1.0)]
    row = FeaturePipeline(before).fit(df).transform(df).first()
    assert (row["old"], row["col1"]) == (1.0, 2.0)
    circle = [op.ExpTransformer(inputCol="p", outputCol="q"), op.ExpTransformer(inputCol="q", outputCol="p")]
    with pytest.raises(ValueError, match="circle"):
        Graph(circle, ["a"]).levels()


def test_saved_pipelines(spark, df, tmp_path):
    pipeline = FeaturePipeline([op.StandardScaleEstimator(inputCol="arr", outputCol="x"), op.StringIndexEstimator(inputCol="col4", outputCol="y")])
    model = pipeline.fit(df)
    model.save(f"file://{tmp_path}/model")
    again = FeaturePipelineModel.load(f"file://{tmp_path}/model")
    assert again.transform(df).collect() == model.transform(df).collect() and again.uid == model.uid
    pipeline.save(f"file://{tmp_path}/pipeline")
    assert FeaturePipeline.load(f"file://{tmp_path}/pipeline").fit(df).transform(df).collect() == model.transform(df).collect()
    with pytest.raises(ValueError):
        FeaturePipeline.load(f"file://{tmp_path}/model")
    with pytest.raises(ValueError, match="plain"):
        FeaturePipeline([op.StringArrayConstantTransformer(inputCol="col4", outputCol="x", constantStringArray=[object()])]).save(f"file://{tmp_path}/no")


def test_saved_functions(spark, df, tmp_path):
    times = 3
    pipeline = FeaturePipeline([op.LambdaFunctionTransformer(inputCol="col1", outputCol="x", function=lambda x: x * times, functionReturnTypes=["double"])])
    pipeline.save(f"file://{tmp_path}/function")
    times = 5
    again = FeaturePipeline.load(f"file://{tmp_path}/function").fit(df).transform(df)
    assert [r["x"] for r in again.collect()] == [3 * r[0] for r in ROWS]


def test_with_the_ml_pipeline_and_grids(df):
    stages = [op.LogTransformer(inputCol="col1", outputCol="l", layerName="log"), op.StandardScaleEstimator(inputCol="l", outputCol="x")]
    assert Pipeline(stages=stages).fit(df).transform(df).columns[-1] == "x"
    pipeline = FeaturePipeline(stages)
    maps = grid(pipeline, {"log": {"alpha": {"kind": "float", "min": 0.0, "max": 1.0, "steps": 3}}})
    assert [pipeline.copy(m).expand()[0].getAlpha() for m in maps] == [0.0, 0.5, 1.0]
    assert choices({"kind": "int", "min": 1, "max": 5, "step": 2}) == [1, 3, 5] and choices({"kind": "boolean"}) == [False, True]


def test_lists_of_one_column_share_exchange_and_sort(spark):
    from loomwright.queries import list_stages

    df = spark.range(10).selectExpr("id AS event_id", "id % 3 AS user_id", "CAST(id AS DOUBLE) AS value")
    plan = FeaturePipeline(list_stages()).fit(df).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan


def test_sample_is_repeatable(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS a").repartition(1)
    fit = lambda seed: op.StandardScaleEstimator(inputCol="a", outputCol="x", sampleFraction=0.3, sampleSeed=seed).fit(df).getMean()
    assert fit(1) == fit(1) != fit(2)
    with pytest.raises(ValueError):
        op.StandardScaleEstimator(sampleFraction=1.5)


def test_streams(spark, df, tmp_path):
    df.select("col1", "col4").write.parquet(f"file://{tmp_path}/in")
    model = FeaturePipeline([op.LogTransformer(inputCol="col1", outputCol="x"), op.StringIndexEstimator(inputCol="col4", outputCol="y")]).fit(df)
    stream = spark.readStream.schema("col1 double, col4 string").parquet(f"file://{tmp_path}/in")
    query = transform_stream(stream, model).writeStream.format("memory").queryName("made").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["y"] for r in spark.table("made").collect()) == [1, 1, 2]
    lists = FeaturePipelineModel([op.ListMaxTransformer(inputCol="col1", outputCol="x", queryIdCol="col4")])
    with pytest.raises(ValueError):
        transform_stream(stream, lists)
    got = []
    write_batches(stream, lists, lambda rows, batch: got.extend(rows.collect()), f"file://{tmp_path}/check").awaitTermination(60)
    assert sorted((r["col4"], r["x"]) for r in got) == [("a", 7.0), ("a", 7.0), ("b", 4.0)]


def test_sources(spark, df, tmp_path):
    for kind in ("parquet", "orc", "json"):
        write_table(df.drop("arr"), f"file://{tmp_path}/{kind}", kind, partition_by=["col4"])
        back = read_table(spark, f"file://{tmp_path}/{kind}", kind, schema="col1 double, col4 string" if kind == "json" else None, columns=["col1", "col4"])
        assert sorted(map(tuple, back.collect())) == [(1.0, "a"), (4.0, "b"), (7.0, "a")]
    write_table(df.select("col1", "col4"), f"file://{tmp_path}/csv", "csv")
    assert read_table(spark, f"file://{tmp_path}/csv", "csv", schema="col1 double, col4 string").count() == 3
    with pytest.raises(ValueError):
        read_table(spark, "x", "csv")


@pytest.mark.parametrize("scale", [1.0, 1e300, 5e-310])
def test_means_do_not_depend_on_how_rows_are_dealt(spark, scale):
    values = [scale * v for i in range(400) for v in (0.1 + i, -1e-7 * i, 1 / (3 + i), 0.9)]
    exact = float(sum(map(Fraction, values)) / len(values))
    rows = spark.createDataFrame([(v, [v] * 9, [[v, 1.0], [v, None]]) for v in values], "a double, b array<double>, c array<array<double>>")
    for df in (rows.coalesce(1), rows.repartitionByRange(3, "a")):
        stages = [op.StandardScaleEstimator(inputCol=n, outputCol=f"{n}x") for n in "abc"]
        a, b, c = FeaturePipeline(stages).fit(df).stages
        assert (a.getMean(), b.getMean(), c.getMean()) == ([exact], [exact] * 9, [exact, 1.0])


def test_means_of_what_has_no_exact_sum(spark):
    fit = lambda rows, kind="double", **more: op.StandardScaleEstimator(inputCol="a", outputCol="x", **more).fit(spark.createDataFrame([(r,) for r in rows], f"a {kind}"))
    assert math.isnan(fit([1.0, float("nan")]).getMean()[0]) and fit([1.0, float("inf")]).getMean() == [math.inf]
    assert fit([0.0, -0.0, None]).getMean() == [0.0] and fit([1.5, 2.5, -9.0], "float", maskValue=-9.0).getMean() == [2.0]
    assert fit([[1.0, 5.0], [3.0, None], None], "array<double>").getMean() == [2.0, 5.0]
    with pytest.raises(ValueError):
        fit([None])


@pytest.mark.parametrize("name", ["copied_pipeline", "feature_pipeline", "saved_pipeline"])
def test_scalers_of_queries_do_not_depend_on_how_rows_are_dealt(spark, name):
    query = QUERIES[name]
    rows = [(i, 1, float(i % 50), 1000.37 + 7.13 * (i * i % 2999), 0.01 * (i % 11), 0.02, "ANR"[i % 3], "O") for i in range(3000)]
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    df = spark.createDataFrame(rows, schema).selectExpr(*query.given)
    logs = [r[0] for r in df.select(F.log(F.col("l_extendedprice") + 1.0)).collect()]
    for dealt in (df.coalesce(1), df.repartitionByRange(3, "l_extendedprice")):
        pipeline = FeaturePipeline(query.stages())
        model = (query.before(pipeline) if query.before else pipeline).fit(dealt)
        model = query.after(model) if query.after else model
        assert model.stages[2].getMean() == [float(sum(map(Fraction, logs)) / len(logs)), 24.5]
