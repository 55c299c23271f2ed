"""Known values and edge cases of the operators."""

import math

import pytest

import loomwright.operators as op
from loomwright.functions.farmhash import fingerprint64
from loomwright.stage import REGISTRY, Operator, operators


def run(spark, stage, rows, schema):
    out = stage.transform(spark.createDataFrame(rows, schema))
    return [r[stage.outputs()[0]] for r in out.collect()]


def one(spark, cls, values, kind, **params):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, a {kind}")
    return [r["x"] for r in cls(inputCol="a", outputCol="x", **params).transform(df).orderBy("i").collect()]


def two(spark, cls, rows, schema, **params):
    names = [x.split()[0] for x in schema.split(", ")]
    return run(spark, cls(inputCols=names, outputCol="x", **params), rows, schema)


def test_every_stage_is_there():
    assert len(operators(kind=Operator)) == 71 and len(REGISTRY) == 80
    assert len(operators(row_wise=False, kind=Operator)) == 6 and "HashIndexTransformer" in operators(uses_udf=True)


def test_math(spark):
    assert one(spark, op.LogTransformer, [1.0, 4.0, 7.0, -3.0, None], "double", alpha=1.0) == [0.6931471805599453, 1.6094379124341003, 2.0794415416798357, None, None]
    assert one(spark, op.AbsoluteValueTransformer, [-1, 2, None], "int") == [1, 2, None]
    assert one(spark, op.ModuloTransformer, [5, -5, 7, 1], "int", divisor=-3.0) == [2.0, -5.0, 1.0, 1.0]
    assert two(spark, op.ModuloTransformer, [(5, 3), (-5, 3), (1, 0)], "a int, b int") == [2, 1, None]
    assert one(spark, op.RoundTransformer, [2.5, -2.5, 0.4], "double") == [3.0, -3.0, 0.0]
    assert one(spark, op.RoundTransformer, [2.5, -2.5], "double", roundType="ceil") == [3, -2]
    assert one(spark, op.RoundToDecimalTransformer, [1.255, 1.245], "double", decimals=1) == [1.3, 1.2]
    assert two(spark, op.DivideTransformer, [(1.0, 0.0, 2.0), (8.0, 2.0, 2.0), (None, 1.0, 1.0)], "a double, b double, c double") == [0.0, 2.0, 0.0]
    assert one(spark, op.MultiplyTransformer, [2, None], "int", mathFloatConstant=1.5) == [3.0, None]
    assert two(spark, op.SumTransformer, [(2**31 - 1, 1), (1, None), (1, 2)], "a int, b int") == [None, None, 3]
    assert two(spark, op.SubtractTransformer, [(7, 2, 1)], "a int, b int, c int") == [4]
    assert two(spark, op.MaxTransformer, [(1.0, None), (None, None)], "a double, b double") == [1.0, None]
    assert two(spark, op.MinTransformer, [(1.0, 3.0)], "a double, b double") == [1.0]
    assert two(spark, op.MeanTransformer, [(1, 2, 6), (1, None, 2)], "a int, b int, c int") == [3.0, None]
    assert one(spark, op.ExponentTransformer, [2.0], "double", exponent=3) == [8.0]
    assert one(spark, op.ExpTransformer, [0.0], "double") == [1.0]


def test_nested_and_mixed_inputs(spark):
    assert one(spark, op.LogTransformer, [[[1.0], [None, math.e]], [], None], "array<array<double>>") == [[[0.0], [None, 1.0]], [], None]
    assert two(spark, op.SumTransformer, [([[1, 2], [3]], 10)], "a array<array<int>>, b int") == [[[11, 12], [13]]]
    assert two(spark, op.SumTransformer, [([1, 2], [10, 20], [100, 200], 1000)], "a array<int>, b array<int>, c array<int>, d int") == [[1111, 1222]]
    with pytest.raises(ValueError, match="unequal nesting"):
        two(spark, op.SumTransformer, [([1], [[1]])], "a array<int>, b array<array<int>>")
    with pytest.raises(TypeError, match="not accepted"):
        one(spark, op.LogTransformer, ["a"], "string")


def test_dtypes(spark):
    assert one(spark, op.IdentityTransformer, [-0.0, 1.5, None], "double", outputDtype="string") == ["0.0", "1.5", None]
    assert one(spark, op.IdentityTransformer, ["1", "x", None], "string", inputDtype="double", outputDtype="int") == [1, None, None]
    assert one(spark, op.LogTransformer, [["1", "z"]], "array<string>", inputDtype="float") == [[0.0, None]]
    with pytest.raises(ValueError):
        op.LogTransformer(inputDtype="string")
    with pytest.raises(ValueError):
        op.IdentityTransformer(outputDtype="decimal")
    df = spark.createDataFrame([((1.0, 2),)], "s struct<a:double,b:int>")
    assert op.ExpTransformer(inputCol="s.a", outputCol="x").transform(df).first()["x"] == pytest.approx(math.e)


def test_logic_and_conditions(spark):
    rows = [(True, None), (False, None), (True, True)]
    assert two(spark, op.LogicalAndTransformer, rows, "a boolean, b boolean") == [None, False, True]
    assert two(spark, op.LogicalOrTransformer, rows, "a boolean, b boolean") == [True, None, True]
    assert one(spark, op.LogicalNotTransformer, [True, None], "boolean") == [False, None]
    assert one(spark, op.IfStatementTransformer, ["a", "b", None], "string", conditionOperator="eq", valueToCompare="a", resultIfTrue="y", resultIfFalse="n") == ["y", "n", "n"]
    assert two(spark, op.NumericalIfStatementTransformer, [(1.0, 5.0), (3.0, 5.0)], "a double, b double", conditionOperator="lt", valueToCompare=2, resultIfFalse=0) == [5.0, 0.0]
    assert two(spark, op.IfStatementTransformer, [(1, 1, "p", "q"), (1, 2, "p", "q")], "a int, b int, c string, d string", conditionOperator="neq") == ["q", "p"]
    with pytest.raises(ValueError):
        two(spark, op.IfStatementTransformer, [(1, 1)], "a int, b int", conditionOperator="eq")
    with pytest.raises(ValueError):
        op.IfStatementTransformer(conditionOperator="gt", valueToCompare="a")
    bins = {"conditionOperators": ["lt", "leq"], "binValues": [1, 2], "binLabels": ["a", "b"], "defaultLabel": "c"}
    assert one(spark, op.BinTransformer, [0.5, 2.0, 3.0, None], "double", **bins) == ["a", "b", "c", "c"]
    assert one(spark, op.BucketizeTransformer, [-1.0, 0.0, 5.0, float("nan"), None], "double", splits=[0.0, 5.0]) == [1, 2, 3, 3, None]
    with pytest.raises(ValueError):
        op.BucketizeTransformer(splits=[2, 1])


def test_strings(spark):
    assert one(spark, op.StringAffixTransformer, ["a", None], "string", prefix="<") == ["<a", None]
    assert one(spark, op.StringArrayConstantTransformer, [["a"], []], "array<string>", constantStringArray=["p", "q"]) == [[["p", "q"]], []]
    assert one(spark, op.StringCaseTransformer, ["aB"], "string", stringCaseType="upper") == ["AB"]
    assert two(spark, op.StringConcatenateTransformer, [("a", None, "c")], "a string, b string, c string") == ["a_c"]
    assert two(spark, op.StringContainsTransformer, [("abc", "b"), ("abc", ""), ("", ""), ("a.c", "a.")], "a string, b string") == [True, False, True, True]
    assert one(spark, op.StringContainsListTransformer, ["abc", "xyz"], "string", constantStringArray=["b", "q"], negation=True) == [False, True]
    assert one(spark, op.StringIsInListTransformer, ["a", "c", None], "string", constantStringArray=["a", "b"]) == [True, False, None]
    assert one(spark, op.StringListToStringTransformer, [["a", None, "b"], []], "array<string>", separator="+") == ["a+b", ""]
    with pytest.raises(TypeError):
        one(spark, op.StringListToStringTransformer, ["a"], "string")
    assert one(spark, op.StringMapTransformer, ["a", "b", "c"], "string", stringMatchValues=["a", "b"], stringReplaceValues=["b", "c"]) == ["b", "c", "c"]
    assert one(spark, op.StringReplaceTransformer, ["a.b.c"], "string", stringMatchConstant=".", stringReplaceConstant="-") == ["a-b-c"]
    assert one(spark, op.StringReplaceTransformer, ["abc", ""], "string", stringMatchConstant="", stringReplaceConstant="n", regex=True) == ["abc", "n"]
    assert two(spark, op.StringReplaceTransformer, [("a+b", "+", "*")], "a string, b string, c string") == ["a*b"]
    assert one(spark, op.StringToStringListTransformer, ["a,,c,d", "a", None], "string", listLength=3, defaultValue="-") == [["a", "-", "c"], ["a", "-", "-"], None]
    assert one(spark, op.SubStringDelimAtIndexTransformer, ["a_b", "a", None], "string", index=1, defaultValue="?") == ["b", "?", "?"]
    assert one(spark, op.SubStringDelimAtIndexTransformer, ["a_b"], "string", index=-1) == ["b"]


def test_embedding_strings(spark):
    got = one(spark, op.StringSequenceToEmbeddingTransformer, ["1|2,3|4,5|6", "1|x", "", None], "string", seqLen=2, embeddingDim=2, padValue="-1")
    assert got == [[[1.0, 2.0], [3.0, 4.0]], [[1.0, None], [-1.0, -1.0]], [[-1.0, -1.0], [-1.0, -1.0]], None]
    got = one(spark, op.StringSequenceToEmbeddingTransformer, ["1|2,3|4", "1|2"], "string", seqLen=3, embeddingDim=2, reverse=True)
    assert got == [[[3.0, 4.0], [1.0, 2.0], [0.0, 0.0]], [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, op.UnixTimestampToDateTimeTransformer, [1724410227.125, None], "double") == ["2024-08-23 10:50:27.125", None]
        assert one(spark, op.UnixTimestampToDateTimeTransformer, [1724410227000], "bigint", unit="ms", includeTime=False) == ["2024-08-23"]
        assert one(spark, op.DateTimeToUnixTimestampTransformer, ["2024-08-23 10:50:27.123", "2024-08-23", "nonsense"], "string") == [1724410227.123, 1724371200.0, None]
        assert one(spark, op.DateTimeToUnixTimestampTransformer, ["2024-08-23"], "string", unit="milliseconds") == [1724371200000.0]
        assert one(spark, op.DateAddTransformer, ["2024-02-28 23:00:00", "bad", None], "string", numDays=2) == ["2024-03-01", None, None]
        assert two(spark, op.DateDiffTransformer, [("2024-01-01", "2024-03-01"), ("", "2024-01-01"), ("bad", "2024-01-01")], "a string, b string", defaultValue=-9) == [60, -9, None]
        parts = {"Year": 2023, "DayOfYear": 365, "MonthOfYear": 12, "DayOfMonth": 31, "DayOfWeek": 7, "Hour": 13, "Minute": 14, "Second": 15, "Millisecond": 16}
        for part, value in parts.items():
            assert one(spark, op.DateParseTransformer, ["2023-12-31 13:14:15.016", "", None], "string", datePart=part, defaultValue=-1) == [value, -1, None]
        assert len(one(spark, op.CurrentDateTransformer, ["x"], "string")[0]) == 10
        assert len(one(spark, op.CurrentDateTimeTransformer, [["x", "y"]], "array<string>")[0]) == 2
        assert one(spark, op.CurrentUnixTimestampTransformer, [1], "int", unit="ms")[0] > 1.6e12
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_arrays(spark):
    assert two(spark, op.ArrayConcatenateTransformer, [(1, [2, 3], 4)], "a int, b array<int>, c int") == [[1, 2, 3, 4]]
    assert two(spark, op.ArrayConcatenateTransformer, [([[1], [2]], 9)], "a array<array<int>>, b int") == [[[1, 9], [2, 9]]]
    assert one(spark, op.ArrayCropTransformer, [["a", "b", "c"], [], None], "array<string>", arrayLength=2, padValue="-") == [["a", "b"], ["-", "-"], None]
    assert one(spark, op.ArrayReduceMaxTransformer, [[1.0, 3.0], [], None], "array<double>", defaultValue=-1) == [3.0, -1.0, -1.0]
    stage = op.ArraySplitTransformer(inputCol="a", outputCols=["p", "q"])
    assert tuple(stage.transform(spark.createDataFrame([([1],)], "a array<int>")).select("p", "q").first()) == (1, None)
    assert one(spark, op.ArraySubtractMinimumTransformer, [[3, 5, -1], [-1]], "array<int>", padValue=-1) == [[0, 2, -1], [-1]]
    assert one(spark, op.ArraySubtractMinimumTransformer, [[3, 5, 1], []], "array<int>") == [[2, 4, 0], []]
    assert one(spark, op.OrdinalArrayEncodeTransformer, [["a", "p", "b", "a", None], []], "array<string>", padValue="p") == [[0, -1, 1, 0, 2], []]
    assert one(spark, op.OrdinalArrayEncodeTransformer, [["a", None, "b"]], "array<string>") == [[0, -1, 1]]
    assert two(spark, op.CosineSimilarityTransformer, [([1.0, 0.0], [1.0, 0.0]), ([0.0], [1.0])], "a array<double>, b array<double>") == [1.0, 0.0]
    assert two(spark, op.PairwiseCosineSimilarityTransformer, [([1.0, 0.0], [1.0, 0.0, 0.0, 1.0, 7.0])], "a array<double>, b array<double>", embeddingDim=2) == [[1.0, 0.0]]


def test_places(spark):
    schema = "a double, b double, c double, d double"
    got = two(spark, op.HaversineDistanceTransformer, [(51.5, -0.1, 48.9, 2.4), (91.0, 0.0, 0.0, 0.0)], schema)
    assert got[0] == pytest.approx(339.43, abs=0.01) and got[1] is None
    miles = two(spark, op.HaversineDistanceTransformer, [(51.5, -0.1)], "a double, b double", latLonConstant=[48.9, 2.4], unit="miles")
    assert miles[0] == pytest.approx(got[0] * 3958.8 / 6371.0)
    assert two(spark, op.BearingAngleTransformer, [(0.0, 0.0, 0.0, 10.0), (0.0, 0.0, -5.0, 0.0)], schema) == pytest.approx([90.0, 180.0])


# What the published hash and the definition of these operators give for these strings.
def test_hashes(spark):
    assert one(spark, op.HashIndexTransformer, ["a", "b", None, "m"], "string", numBins=100, maskValue="m") == [31, 20, 0, 0]
    assert one(spark, op.HashIndexTransformer, [["c", "a"], None], "array<string>", numBins=5000) == [[4206, 3350], None]
    assert one(spark, op.BloomEncodeTransformer, ["a", "b"], "string", numBins=100) == [[26, 9, 79], [61, 41, 94]]
    assert one(spark, op.MinHashIndexTransformer, [["a", "c", "c"], ["a", "d", "c"]], "array<string>", numPermutations=10) == [[1, 0, 1, 1, 0, 1, 0, 0, 1, 0], [1, 1, 1, 1, 0, 0, 0, 0, 1, 0]]
    assert op.BloomEncodeTransformer(useHeuristicNumBins=True, featureCardinality=103).bins() == 21
    with pytest.raises(Exception, match="NUL"):
        one(spark, op.HashIndexTransformer, ["a\0"], "string", numBins=100)


def test_fingerprints_of_all_lengths_differ_and_repeat():
    found = {n: fingerprint64(bytes(range(256))[:n] * 1 if n <= 256 else bytes(n)) for n in [*range(257), 1000]}
    assert len(set(found.values())) == len(found) and all(0 <= v < 1 << 64 for v in found.values())


def test_vocabularies(spark):
    labels = {"labelsArray": ["b", "a"], "numOOVIndices": 1}
    assert one(spark, op.StringIndexTransformer, ["a", "b", "z", None], "string", **labels) == [2, 1, 0, 0]
    assert one(spark, op.StringIndexTransformer, ["a", "m", "z", None], "string", **labels, maskToken="m") == [3, 0, 1, 0]
    assert one(spark, op.StringIndexTransformer, [["a", None], None], "array<string>", **labels) == [[2, 0], None]
    assert one(spark, op.StringIndexTransformer, ["a", "c"], "string", labelsArray=["x"], numOOVIndices=99) == [30, fingerprint64(b"c") % 99]
    many = [f"l{i}" for i in range(300)]
    assert one(spark, op.StringIndexTransformer, ["l0", "l299", "zz", None], "string", labelsArray=many) == [1, 300, 0, 0]
    assert one(spark, op.StringIndexTransformer, [["l0", "zz"], [None]], "array<string>", labelsArray=many, maskToken="zz") == [[2, 0], [0]]
    assert one(spark, op.OneHotEncodeTransformer, ["a", None], "string", **labels) == [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0]]
    assert one(spark, op.OneHotEncodeTransformer, [7, 8], "int", labelsArray=["7"], dropUnseen=True) == [[1.0], [0.0]]
    both = op.SharedStringIndexTransformer(inputCols=["a", "b"], outputCols=["x", "y"], **labels)
    assert tuple(both.transform(spark.createDataFrame([("a", "b")], "a string, b string")).select("x", "y").first()) == (2, 1)
    with pytest.raises(ValueError):
        op.StringIndexTransformer(numOOVIndices=0)


def lists(spark, stage, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["x"] for r in stage.transform(df).orderBy("i").collect()]


def test_lists(spark):
    rows = [(1, 2, 1, "s"), (1, 8, 2, "s"), (1, None, 3, "t"), (2, -999, 1, "s")]
    schema = "q int, v int, o int, g string"
    stage = lambda cls, given="v", **p: cls(inputCols=given if isinstance(given, list) else [given], outputCol="x", queryIdCol="q", **p)
    assert lists(spark, stage(op.ListMaxTransformer), rows, schema) == [8, 8, 8, -999]
    assert lists(spark, stage(op.ListMinTransformer, minFilterValue=0), rows, schema) == [2, 2, 2, 0]
    assert lists(spark, stage(op.ListMeanTransformer), rows, schema) == [5.0, 5.0, 5.0, -999.0]
    assert lists(spark, stage(op.ListMaxTransformer, ["v", "o"], topN=1), rows, schema) == [2, 2, 2, -999]
    assert lists(spark, stage(op.ListMaxTransformer, ["v", "o"], topN=2, sortOrder="desc"), rows, schema) == [8, 8, 8, -999]
    assert lists(spark, stage(op.ListMeanTransformer, ["v", "g"], withSegment=True, nanFillValue=-1), rows, schema) == [5.0, 5.0, -1.0, -999.0]
    assert lists(spark, stage(op.ListMedianTransformer), rows, schema) == [5.0, 5.0, 5.0, -999.0]
    assert lists(spark, stage(op.ListStdDevTransformer, nanFillValue=7), rows, schema)[3] == 7.0
    assert lists(spark, op.ListRankTransformer(inputCol="v", outputCol="x", queryIdCol="q"), rows, schema) == [2, 1, 3, 1]
    assert lists(spark, stage(op.ListMaxTransformer, "g"), rows, schema) == ["t", "t", "t", "s"]
    assert lists(spark, stage(op.ListMeanTransformer, "g"), [(1, 1, 1, "4"), (1, 1, 1, "x"), (2, 1, 1, "y")], schema) == [4.0, 4.0, 0.0]
    rows.append((None, 5, 1, "s"))
    for cls in (op.ListMaxTransformer, op.ListMeanTransformer, op.ListMedianTransformer, op.ListStdDevTransformer):
        for more in ({}, {"minFilterValue": 0}, {"given": ["v", "g"], "withSegment": True}):
            assert lists(spark, stage(cls, **more, skewSafe=True), rows, schema) == lists(spark, stage(cls, **more), rows, schema)
    with pytest.raises(ValueError):
        lists(spark, stage(op.ListMaxTransformer, ["v", "o"], topN=1, skewSafe=True), rows, schema)
    with pytest.raises(ValueError):
        lists(spark, op.ListMaxTransformer(inputCol="v", outputCol="x"), rows, schema)
    with pytest.raises(ValueError):
        lists(spark, stage(op.ListMaxTransformer, ["v", "o"]), rows, schema)
    with pytest.raises(ValueError):
        op.ListMaxTransformer(sortOrder="up")


def test_functions(spark):
    assert one(spark, op.LambdaFunctionTransformer, [1, 2], "int", function=lambda x: x + 1, functionReturnTypes=["int"]) == [2, 3]
    stage = op.LambdaFunctionTransformer(inputCols=["a", "b"], outputCols=["x", "y"], function="loomwright.queries:twice_and_sum", functionReturnTypes=["double", "double"])
    assert tuple(stage.transform(spark.createDataFrame([(1.0, 2.0)], "a double, b double")).select("x", "y").first()) == (2.0, 3.0)


def test_clashing_outputs_and_parameters(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    out = op.ExpTransformer(inputCol="b", outputCol="a").transform(df)
    assert out.columns == ["a", "b"] and out.first()["a"] == pytest.approx(math.exp(2.0))
    stage = op.LogTransformer(inputCol="a", outputCol="x")
    assert stage.setAlpha(2).getAlpha() == 2.0 and stage.getLayerName() == stage.uid
    assert stage.copy({stage.alpha: 5.0}).getAlpha() == 5.0 and stage.getAlpha() == 2.0
    with pytest.raises(TypeError):
        op.LogTransformer(beta=1)
    with pytest.raises(ValueError, match="outputCol"):
        op.LogTransformer(inputCol="a").transform(df)


LIMITS = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


@pytest.mark.parametrize("kind", LIMITS)
def test_least_and_greatest_integers_give_null_and_no_error(spark, kind):
    least, most = -(1 << LIMITS[kind]), (1 << LIMITS[kind]) - 1
    values = [least, -1, 0, most, None]
    assert one(spark, op.AbsoluteValueTransformer, values, kind) == [None, 1, 0, most, None]
    schema = f"i int, a {kind}, b {kind}"
    names = {"inputCols": ["a", "b"], "outputCol": "x"}
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([(-5, least), (most, least), (least, -1), (5, 0), (-5, 3)])], schema)
    assert [r["x"] for r in op.ModuloTransformer(**names).transform(df).orderBy("i").collect()][2:] == [0, None, 1]
    for stage in (op.MultiplyTransformer, op.SubtractTransformer, op.SumTransformer, op.MaxTransformer, op.MinTransformer, op.MeanTransformer):
        assert len(stage(**names).transform(df).collect()) == 5
    got = one(spark, op.ArraySubtractMinimumTransformer, [[least, most], [most, most], [0, 5], None], f"array<{kind}>")
    assert got == [[0, None], [0, 0], [0, 5], None]


def test_days_and_seconds_beyond_the_calendar_give_null(spark):
    df = spark.createDataFrame([(i, "2020-02-28", n) for i, n in enumerate([1, 1 << 40, (1 << 31) - 1, -(1 << 63), (1 << 63) - 1, None, -3_000_000])], "i int, a string, n bigint")
    got = op.DateAddTransformer(inputCols=["a", "n"], outputCol="x").transform(df).orderBy("i").collect()
    assert [r["x"] for r in got] == ["2020-02-29", *[None] * 6]
    assert one(spark, op.DateAddTransformer, ["9999-12-31", "0001-01-01", "no date"], "string", numDays=1) == [None, "0001-01-02", None]
    for kind, values in (("bigint", [0, 1 << 62, -(1 << 63), 253402300799]), ("double", [0.0, 1e18, float("nan"), 253402300799.0, float("-inf")])):
        got = one(spark, op.UnixTimestampToDateTimeTransformer, values, kind, includeTime=False)
        assert [got[0], got[3]] == ["1970-01-01", "9999-12-31"] and [v for i, v in enumerate(got) if i not in (0, 3)] == [None] * (len(values) - 2)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_unix_times_beyond_four_digits_of_years_and_in_gaps_of_the_clock(spark, zone):
    import duckdb

    stage = op.UnixTimestampToDateTimeTransformer
    values = [0, -1, 1710037800, 253402300799, 253402300800, 777599913601, 3093527980800, 9223372036854, -62135596801, -62167219200, -62167219201, -93000000000, -9223372022400]
    want = [duckdb.execute("SELECT strftime(make_timestamp(?::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') || '.000'", [v]).fetchone()[0] for v in values]
    assert want[4] == "10000-01-01 00:00:00.000"
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, stage, values, "bigint") == want
        assert one(spark, stage, [float(v) for v in values], "double") == want
        assert one(spark, stage, [[v * 1000 for v in values]], "array<bigint>", unit="ms", includeTime=False) == [[w.split(" ")[0] for w in want]]
        assert one(spark, stage, [253402300800.5, -0.25], "double") == ["10000-01-01 00:00:00.500", "1969-12-31 23:59:59.750"]
        assert one(spark, stage, [9223372036855, -9223372036855, None], "bigint") == [None] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_texts_beside_numbers_neither_fail_nor_change_the_column(spark):
    values = ["abc", "2", "0.5", None]
    assert one(spark, op.IfStatementTransformer, values, "string", conditionOperator="gt", valueToCompare=1.0, resultIfTrue="y", resultIfFalse="n") == ["n", "y", "n", "n"]
    assert one(spark, op.IfStatementTransformer, [1, 2], "int", conditionOperator="eq", valueToCompare="abc", resultIfTrue="y", resultIfFalse="n") == ["n", "n"]
    df = spark.createDataFrame([(0, 1, "abc"), (1, 5, "z")], "i int, a int, b string")
    stage = op.IfStatementTransformer(inputCols=["a", "b"], outputCol="x", conditionOperator="gt", valueToCompare=3, resultIfTrue=7)
    assert [r["x"] for r in stage.transform(df).orderBy("i").collect()] == ["abc", "7"]
    assert one(spark, op.ImputeTransformer, values, "string", imputeValue=3, maskValue=2) == ["abc", "3", "0.5", "3"]
    assert one(spark, op.ImputeTransformer, [1.5, None, 0.0], "double", imputeValue="2.5", maskValue="0") == [1.5, 2.5, 2.5]
    with pytest.raises(ValueError, match="abc"):
        one(spark, op.ImputeTransformer, [1.5], "double", imputeValue="abc")


def test_replacements_are_taken_as_they_are(spark):
    cls = op.StringReplaceTransformer
    assert one(spark, cls, ["a.b.c", "", None], "string", stringMatchConstant=".", stringReplaceConstant=r"$5\x") == [r"a$5\xb$5\xc", "", None]
    assert one(spark, cls, ["ab", ""], "string", stringMatchConstant="", stringReplaceConstant="$") == ["$a$b$", "$"]
    df = spark.createDataFrame([(0, "abc", "(b)", r"$1$9\ "), (1, "abc", "", "x"), (2, "", "", "x")], "i int, a string, b string, c string")
    got = cls(inputCols=["a", "b", "c"], outputCol="x", regex=True).transform(df).orderBy("i").collect()
    assert [r["x"] for r in got] == [r"a$1$9\ c", "abc", "x"]
    assert one(spark, cls, ["abc"], "string", stringMatchConstant="(b)([c(])", stringReplaceConstant=r"$2$1\$", regex=True) == ["acb$"]
    for new in ("$", "$2", "a\\"):
        with pytest.raises(ValueError, match="group"):
            one(spark, cls, ["abc"], "string", stringMatchConstant=r"(b)\(", stringReplaceConstant=new, regex=True)


def test_columns_of_the_users_with_names_of_helpers(spark, monkeypatch):
    monkeypatch.setattr("loomwright.operators.encoding.LITERAL_LABELS", 1)
    df = spark.createDataFrame([("b", 1, "k"), ("z", 2, "k")], "a string, __lw_place int, __lw_label string")
    for most in (64_000_000, 0):
        monkeypatch.setattr("loomwright.operators.encoding.BROADCAST_BYTES", most)
        got = op.StringIndexTransformer(inputCol="a", outputCol="__lw_x", labelsArray=["a", "b"]).transform(df).orderBy("a")
        assert got.columns == ["a", "__lw_place", "__lw_label", "__lw_x"] and [r["__lw_x"] for r in got.collect()] == [2, 0]


def test_vocabularies_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr("loomwright.operators.estimators.MOST_LABELS", 2)
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "a string")
    with pytest.raises(ValueError, match="maxNumLabels"):
        op.StringIndexEstimator(inputCol="a", outputCol="x").fit(df)
    assert op.StringIndexEstimator(inputCol="a", outputCol="x", maxNumLabels=3).fit(df).getLabelsArray() == ["a", "b", "c"]


@pytest.mark.parametrize("values", [[1.0, 2.0], [3.0], [5.0, 5.0, 5.0, 1.0], [float(i * i % 997) for i in range(3000)], [0.0] * 1999 + [float(i) for i in range(2001)]])
def test_medians_are_exact_however_they_are_closed_in_on(spark, monkeypatch, values):
    import statistics

    monkeypatch.setattr("loomwright.operators.estimators.MOST_VALUES", 20)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (-1.0,)], "a double").repartition(5)
    model = op.ImputeEstimator(inputCol="a", outputCol="x", imputeMethod="median", maskValue=-1.0).fit(df)
    assert model.getImputeValue() == statistics.median(values)
    with pytest.raises(ValueError, match="no elements"):
        op.ImputeEstimator(inputCol="a", outputCol="x", imputeMethod="median").fit(df.where("a is null"))
