"""Column expressions with pandas-compatible null semantics.

All functions return ``Column`` objects and stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskfold.constants import NULL_TOKENS
from riskfold.functions.names import numeric_columns, string_columns


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_in(c, values) -> Column:
    """``isin`` where a null input is *not* a member (NaN comparisons are false)."""
    return F.coalesce(col_(c).isin(list(values)), F.lit(False))


def not_in(c, values) -> Column:
    """Negated membership where a null input counts as *not* in the set."""
    return ~is_in(c, values)


def indicator(cond: Column, dtype: str = "int") -> Column:
    """1 where ``cond`` holds, 0 elsewhere (null condition -> 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast(dtype)


def map_values(c, mapping: dict, default=None) -> Column:
    """Dictionary lookup; unmapped values (and null) give ``default``."""
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = lookup[col_(c)]
    return out if default is None else F.coalesce(out, F.lit(default))


def first_match(rules: list[tuple[Column, Column]], otherwise=None) -> Column:
    """Ordered masked assignment: the first rule whose condition holds wins."""
    expr = None
    for cond, value in rules:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr if otherwise is None else expr.otherwise(otherwise)


def inf_to_null(c) -> Column:
    """Replace NaN, +inf and -inf by null."""
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def null_token_to_null(c, tokens=NULL_TOKENS) -> Column:
    c = col_(c)
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


def normalise_nulls(df: DataFrame) -> DataFrame:
    """Source-side null normalisation: NaN/inf -> null in float columns,
    null tokens -> null in string columns.  Other columns pass through."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    strings = set(string_columns(df))
    out = []
    for c in df.columns:
        if c in floats:
            out.append(inf_to_null(c).alias(c))
        elif c in strings:
            out.append(null_token_to_null(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


__all__ = [
    "is_in", "not_in", "indicator", "map_values", "first_match", "inf_to_null",
    "null_token_to_null", "normalise_nulls",
    "numeric_columns", "string_columns",
]
