"""Table and model operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import reporting
from tessera.operators import models, tables


def test_reconcile_and_sets(spark):
    left = spark.createDataFrame([("a", 1.0, "x"), (None, 2.0, "y"), ("c", 3.0, None)], "k string, v double, t string")
    right = spark.createDataFrame([("a", 1.001, "x"), ("", 2.5, "y"), ("d", 1.0, "z")], "k string, v double, t string")
    got = {r["key"]: (r["v_ok"], r["t_ok"], r["all_ok"]) for r in tables.reconcile(left, right, "k", ["v"], ["t"]).collect()}
    assert got == {"a": (True, True, True), "": (False, True, False)}
    with pytest.raises(ValueError, match="'a' occurs more than once"):
        tables.reconcile(left.union(left.limit(1)), right, "k", ["v"])
    assert tables.column_differences(["A", "b"], ["a", "C"]) == {"common": ["a"], "left_only": ["b"], "right_only": ["c"]}


def test_null_keys_never_join(spark):
    a = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k int, v int")
    b = spark.createDataFrame([(None, "n"), (1, "x")], "j int, w string")
    assert sorted(r["v"] for r in tables.chain_join(a, (b, "k", "j")).collect()) == [2, 3]


@pytest.mark.parametrize(("n", "share"), [(0, 0.2), (1, 0.2), (7, 0.2), (1000, 0.2), (1000, 0.0), (1000, 1.0), (5000, 0.333)])
def test_split_is_exact(spark, n, share):
    got = tables.split(spark.range(n), "id", share, 3).collect()
    assert sum(r["is_test"] for r in got) == int(n * share) and len(got) == n
    assert got and {(r["id"], r["is_test"]) for r in tables.split(spark.range(n), "id", share, 3).collect()} == {(r["id"], r["is_test"]) for r in got} or n == 0


def test_single_first_average(spark):
    one = spark.createDataFrame([(1,)], "x int")
    assert tables.single(one)["x"] == 1
    for bad in (one.limit(0), one.union(one)):
        with pytest.raises(ValueError, match="element"):
            tables.single(bad)
    rows = spark.createDataFrame([("a", 1), ("a", 3), (None, 9), ("b", 2)], "k string, v int")
    assert [tuple(r) for r in tables.average_by(rows, "k", "v").collect()] == [(None, 9.0), ("a", 2.0), ("b", 2.0)]
    assert [tuple(r) for r in tables.first_by(rows, ["k"], ["v"]).orderBy("v").collect()] == [("a", 1), ("b", 2), (None, 9)]


def test_min_max_of_constant_and_null(spark):
    rows = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double")
    assert [tuple(r)[3:] for r in tables.min_max_scaled(rows, ["a", "b", "c"]).collect()] == [(0.0, 0.0, None), (1.0, 0.0, None)]


def test_least_squares_is_that_of_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) * [1, 100, 1e4] + [0, 5e3, 1e6]
    y = 3 + x @ [2.0, -0.5, 1e-3] + rng.normal(size=500)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    model = models.least_squares(rows, ["a", "b", "c"], "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(500), x]), y, rcond=None)[0]
    assert np.allclose([model.intercept, *model.coefficients], want, rtol=1e-6)
    found = models.evaluate(rows, model, "y").first()
    error = y - np.column_stack([np.ones(500), x]) @ want
    assert found["r2_score"] == pytest.approx(1 - (error**2).sum() / ((y - y.mean()) ** 2).sum())
    assert found["max_error"] == pytest.approx(abs(error).max(), rel=1e-4)
    with pytest.raises(ValueError, match="3 features, 1 given"):
        model.predict([F.col("a")])
    with pytest.raises(ValueError, match="no rows"):
        models.least_squares(rows.limit(0), ["a"], "y")


def test_folds_and_matrix(spark):
    rows = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 17 * 2 + F.col("id") % 3).cast("double").alias("y"))
    folds = models.cross_validate(rows, "id", ["x"], "y", 4, 1)
    summary = models.summarize_folds(folds, 0.5).first()
    assert summary["num_folds"] == 4 and len(summary["fold_metrics"]) == 4 and summary["min_r2_score"] > 0.9
    assert "num folds" in reporting.cross_validation_report(summary.asDict(recursive=True))
    with pytest.raises(ValueError, match="from 2 to 100"):
        models.cross_validate(rows, "id", ["x"], "y", 1, 1)
    pairs = spark.createDataFrame(list(zip([0, 1, 0, 0, 1], [1, 1, 0, 0, 0], strict=True)), "a int, p int")
    assert {tuple(r) for r in models.confusion_matrix(pairs, "a", "p").collect()} == {(0, 2, 1), (1, 1, 1)}


def test_charts(spark):
    bars = reporting.column_chart(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double"), "k", "v", "T")
    assert bars["data"][0]["y"] == [1.0, 3.0]
    grid = reporting.heat_map([[2, 3], [3, 2]], ["0", "1"], ["0", "1"])
    curve = reporting.curve_chart(models.normal_curve(spark, 0.5, 0.1, 21), [(0.4, 0.0)], [("mean", 0.5)])
    for chart in (bars, grid, curve):
        assert reporting.chart_png(chart).startswith(b"\x89PNG\r\n\x1a\n") and reporting.chart_json(chart)
    assert reporting.decode_data_uri("data:image/png;base64,YWI=") == b"ab"


def test_while_and_any_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "k int, v int")
    assert [r["k"] for r in tables.take_while(rows, F.col("v") < 9, ["k"]).collect()] == [1]
    assert sorted(r["k"] for r in tables.skip_while(rows, F.col("v") < 9, ["k"]).collect()) == [2, 3]
    assert tables.take_while(rows, F.col("k") < 9, ["k"]).count() == 3 and tables.skip_while(rows, F.col("k") < 9, ["k"]).count() == 0
    assert tuple(tables.any_all(rows, F.col("v") > 4).first()) == (True, False) and tuple(tables.any_all(rows.limit(0), F.col("v") > 4).first()) == (False, True)
    assert tuple(tables.extremes_by(rows.withColumn("g", F.lit(1)), "g", "k", ["v", "k"]).first()) == (1, 2, 3)


def _png_pixel(png, width, x, y):
    import struct
    import zlib

    at, body = 8, b""
    while at < len(png):
        size = struct.unpack(">I", png[at : at + 4])[0]
        if png[at + 4 : at + 8] == b"IDAT":
            body += png[at + 8 : at + 8 + size]
        at += 12 + size
    raw = zlib.decompress(body)
    start = y * (width * 3 + 1) + 1 + x * 3
    return tuple(raw[start : start + 3])


def test_pictures_have_text_and_negative_columns_below_zero(spark):
    rows = spark.createDataFrame([("up", 2.0), ("down", -2.0)], "k string, v double")
    png = reporting.chart_png(reporting.column_chart(rows, "k", "v", "Title"), 240, 240)
    blue = reporting.SERIES[0]
    # the columns' middles: above the zero line for the first, below for the second
    assert _png_pixel(png, 240, 70, 70) == blue != _png_pixel(png, 240, 70, 170)
    assert _png_pixel(png, 240, 170, 170) == blue != _png_pixel(png, 240, 170, 70)
    assert any(_png_pixel(png, 240, x, 9) == reporting.INK for x in range(60, 180))
    curve = spark.range(11).selectExpr("cast(id as double) x", "cast(id as double) density")
    with pytest.raises(ValueError, match="more than 10"):
        reporting.curve_chart(curve, [], [], limit=10)
    grid = reporting.heat_map([[1.0, 2.0], [3.0, 4.0]], ["a", "b"], ["c", "d"])
    assert reporting.chart_png(grid).startswith(b"\x89PNG") and reporting.chart_png(reporting.curve_chart(curve, [(1.0, 0.0)], [("m", 2.0)])).startswith(b"\x89PNG")


def test_fits_of_features_far_from_zero(spark):
    rows = spark.range(2000).select((F.lit(1.7e9) + F.rand(1)).alias("x"), F.randn(2).alias("z"), F.col("id")).withColumn("y", 3 * (F.col("x") - 1.7e9) + 0.5 * F.col("z") + 1)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    model = models.least_squares(rows, ["x", "z"], "y")
    assert abs(model.coefficients[0] - 3) < 1e-4 and abs(model.coefficients[1] - 0.5) < 1e-6
    folds = models.cross_validate(rows, "id", ["x", "z"], "y", 4, 42).collect()
    assert len(folds) == 4 and all(r["r2_score"] > 0.999999 for r in folds)
    near = models.gradient_descent(rows, ["x", "z"], "y", 200)
    assert abs(near.coefficients[0] - 3) < 1e-3 and abs(near.coefficients[1] - 0.5) < 1e-3
    with pytest.raises(ValueError, match="no rows"):
        models.gradient_descent(rows.limit(0), ["x"], "y")


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900])
def test_skip_is_spread(spark, n):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 3).alias("g")).repartition(6)
    got = tables.skip(rows, n, [F.col("g").desc(), "k"])
    want = sorted(((r["g"], r["k"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))[n:]
    assert [(r["g"], r["k"]) for r in got.collect()] == want
    assert "SinglePartition" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_split_of_repeated_keys_is_exact(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(100)], "k long, v long")
    for share in (0.0, 0.1, 0.37, 0.5, 1.0):
        marked = tables.split(rows, "k", share, 42)
        assert marked.where("is_test").count() == int(100 * share) and marked.count() == 100
        assert sorted(r["v"] for r in marked.collect()) == list(range(100))


def test_small_operators(spark):
    rows = spark.createDataFrame([(1, 2.5, ["a", "b"]), (2, None, []), (None, -1.0, None)], "k long, v double, xs array<string>")
    vectors = tables.feature_vector(rows, ["k", "v"], "f")
    assert [r["f"] for r in vectors.orderBy("k").collect()] == [[None, -1.0], [1.0, 2.5], [2.0, None]]
    assert tables.vector_columns(vectors.select("k", "f"), "f", ["a", "b", "c"]).where("k = 1").first() == (1, 1.0, 2.5, None)
    assert tables.summary(rows, "v").first()[:4] == (3, -1.0, 2.5, 0.75) and tables.summary(rows.limit(0), "v").first() == (0, None, None, None, None)
    assert sorted(map(tuple, tables.flatten(rows.select("k", "xs"), "xs", "x").collect())) == [(1, "a"), (1, "b")]
    joined = tables.group_join(rows.select("k"), rows.select("k", "v"), "k", n=F.count("v"))
    assert {tuple(r) for r in joined.collect()} == {(1, 1), (2, 0), (None, None)}
    assert [r["chunk"] for r in tables.chunked(spark.range(5).withColumn("g", F.lit(1)), 2, "g", ["id"]).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    assert tables.union_distinct(spark.range(3), spark.range(2), spark.range(4)).count() == 4 and tables.concatenated(spark.range(3), spark.range(2)).count() == 5


def test_first_rows_of_a_key(spark):
    rows = spark.createDataFrame([(1, None, 5, "a"), (1, 2, 1, "b"), (None, 3, 1, "c"), (None, 3, 0, "d"), (2, 1, 1, "e")], "k int, t int, n int, v string")
    by_names = tables.first_by(rows, ["k"], ["t", "n"])
    by_columns = tables.first_by(rows, ["k"], [F.col("t").asc(), F.col("n")])
    assert by_names.columns == rows.columns and sorted(r["v"] for r in by_names.collect()) == sorted(r["v"] for r in by_columns.collect()) == ["a", "d", "e"]
    assert "Window" not in by_names._jdf.queryExecution().optimizedPlan().toString()
    assert tables.first_by(rows, ["k"], [F.col("t").desc(), "n"]).where("k = 1").first()["v"] == "b"
    assert tables.first_by(rows.select("k"), ["k"], ["k"]).count() == 3 and tables.first_by(rows.limit(0), ["k"], ["t"]).collect() == []
