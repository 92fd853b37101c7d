"""Value functions: tolerant equality, densities, labels, file signatures."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types by bytes (hex) at places in them, in the order in which they are looked for. Fixed values.
SIGNATURES = (
    ("Png", ((0, "89504E470D0A1A0A"),)), ("Jpeg", ((0, "FFD8FF"),)), ("Gif", ((0, "47494638"),)), ("Pdf", ((0, "25504446"),)),
    ("Zip", ((0, "504B03"),)), ("Zip", ((0, "504B05"),)), ("Gzip", ((0, "1F8B"),)), ("Bmp", ((0, "424D"),)),
    ("WebP", ((0, "52494646"), (8, "57454250"))), ("Mp4", ((4, "66747970"),)),
)


def approx_equal(left: Column, right: Column, tolerance: float = 0.01) -> Column:
    """Null-safe: two nulls are equal, one is not; numbers are equal if they differ by less than the tolerance."""
    near = F.abs(left.cast("double") - right.cast("double")) < tolerance
    return F.when(left.isNull() & right.isNull(), True).when(left.isNull() | right.isNull(), False).otherwise(near)


def normal_pdf(x: Column, mean: Column | float, deviation: Column | float) -> Column:
    """Density of the normal distribution."""
    mean, deviation = (F.lit(v) if isinstance(v, (int, float)) else v for v in (mean, deviation))
    z = (x - mean) / deviation
    return F.exp(-0.5 * z * z) / (deviation * F.lit(math.sqrt(2 * math.pi)))


def spaced_label(name: Column) -> Column:
    """A space before each inner capital: ``TrainModel`` becomes ``Train Model``."""
    return F.regexp_replace(name, r"\B([A-Z])", " $1")


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a base64 data URI, with or without its prefix."""
    return F.unbase64(F.regexp_replace(uri, "^data:[^,]*,", ""))


def file_type(content: Column) -> Column:
    """The type of a file by its first bytes, else ``Unknown``."""
    head = F.hex(F.substring(content, 1, 16))
    found = F
    for name, marks in SIGNATURES:
        fits = reduce(and_, (F.substring(head, 2 * at + 1, len(mark)) == mark for at, mark in marks))
        found = found.when(fits, name)
    return found.otherwise("Unknown")
