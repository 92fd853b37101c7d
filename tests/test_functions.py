"""Column functions on dirty values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.sources.objects import FileType, detect_file_type
from tessera.sources.tables import camel_case, pascal_case


def values(spark, texts, function):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in frame.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]


def test_percentages(spark):
    assert values(spark, ["100%", " 90 %", "", "abc", None, "1,5%"], fn.parse_percentage) == [Decimal(1), Decimal("0.9"), None, None, None, Decimal("0.15")]


def test_decimals(spark):
    texts = ["1,234.5", " 12 ", "5-", ".5", "5.", "+7", "1e3", "-5-", "NaN", "(5)", "$1", "1_0", "", None, "9" * 30]
    want = [Decimal("1234.5"), Decimal(12), Decimal(-5), Decimal("0.5"), Decimal(5), Decimal(7), *[None] * 9]
    assert values(spark, texts, fn.parse_decimal) == want


def test_ints_money_flags_blanks(spark):
    assert values(spark, ["3", " 3 ", "3.0", "99999999999", "-4", "", None], fn.parse_int) == [3, 3, None, None, -4, None, None]
    assert values(spark, ["$1,325.0", "", "n/a", None], fn.parse_money) == [Decimal(1325), Decimal(0), Decimal(0), Decimal(0)]
    assert values(spark, ["t", "T", "f", "", None], fn.is_true) == [True, False, False, False, False]
    assert values(spark, ["", " \t\n", None, "x "], fn.is_blank) == [True, True, True, False]


def test_values(spark):
    rows = spark.createDataFrame([(1.0, 1.005), (1.0, 1.02), (None, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(fn.approx_equal(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]
    assert values(spark, ["TrainModel", "A", "XTrain"], fn.spaced_label) == ["Train Model", "A", "X Train"]
    assert values(spark, ["data:image/png;base64,YWI=", "YWI="], fn.data_uri_bytes) == [b"ab", b"ab"]
    assert values(spark, ["0"], lambda c: fn.normal_pdf(c.cast("double"), 0.0, 1.0)) == [pytest.approx(0.3989422804)]


def test_file_types_are_the_same_on_both_sides(spark):
    starts = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"GIF89a", b"%PDF-1", b"PK\x03\x04", b"\x1f\x8b\x08", b"BM12", b"RIFF1234WEBP", b"0000ftypmp42", b"text", b""]
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(starts)], "i int, b binary")
    found = [r["t"] for r in frame.select("i", fn.file_type(F.col("b")).alias("t")).orderBy("i").collect()]
    assert found == [detect_file_type(b).value for b in starts] and set(found) == {t.value for t in FileType}


def test_names():
    assert camel_case("review_scores") == "reviewScores" and camel_case("ReviewScores") == "reviewScores" and pascal_case("shuttle_type") == "ShuttleType"
