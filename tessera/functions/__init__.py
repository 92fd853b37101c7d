"""Column functions: parsing of dirty text, predicates, statistics, names."""

from tessera.functions.parsing import is_blank, is_true, parse_decimal, parse_int, parse_money, parse_percentage
from tessera.functions.values import approx_equal, data_uri_bytes, file_type, normal_pdf, spaced_label

__all__ = [
    "approx_equal", "data_uri_bytes", "file_type", "is_blank", "is_true", "normal_pdf", "parse_decimal", "parse_int",
    "parse_money", "parse_percentage", "spaced_label",
]
