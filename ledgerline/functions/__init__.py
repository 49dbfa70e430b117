"""Column-level helpers. All return Spark ``Column`` expressions (JVM-side, codegen'd)."""

from .labels import band, flag_list, label
from .aggs import any_if, max_if, min_if, sum_if, text_list
from .dates import local_date, shift_weekend, step_date, whole_units
from .jsonf import json_decimal, json_present, json_str
from .paths import path_part, prefix_before, trim_leading
from .money import split_cents

__all__ = [
    "band", "flag_list", "label", "any_if", "max_if", "min_if", "sum_if", "text_list",
    "local_date", "shift_weekend", "step_date", "whole_units", "json_decimal", "json_present",
    "json_str", "path_part", "prefix_before", "trim_leading", "split_cents",
]
