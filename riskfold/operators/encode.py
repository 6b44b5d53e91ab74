"""Categorical encoders with a fit / transform split.

The fitted state is a small category list per column (bounded and checked
by :func:`riskfold.operators.aggregate.fit_vocabulary`) and the set of columns
that have nulls; transforming is one projection and never shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfold.functions.names import string_columns
from riskfold.operators.aggregate import fit_vocabulary


@dataclass
class CategoryEncoding:
    """Columns with at most two distinct values, null being a value, get ordinal
    codes (sorted order, null last); the other string columns become 0/1 dummies
    named ``{column}_{value}``, all zero for null."""
    ordinal: dict[str, list[str | None]]
    onehot: dict[str, list[str]]

    @classmethod
    def from_vocabulary(cls, vocabulary: dict[str, list[str]], with_null: frozenset[str] = frozenset(),
                        max_ordinal: int = 2) -> "CategoryEncoding":
        values = {c: [*sorted(v), *([None] if c in with_null else [])] for c, v in vocabulary.items()}
        ordinal = {c: v for c, v in values.items() if len(v) <= max_ordinal}
        return cls(ordinal, {c: sorted(v) for c, v in vocabulary.items() if c not in ordinal})

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None, max_values: int = 1000) -> "CategoryEncoding":
        columns = columns if columns is not None else string_columns(df)
        if not columns:
            return cls({}, {})
        nulls = df.agg(*[F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias(c) for c in columns]).first()
        return cls.from_vocabulary(fit_vocabulary(df, columns, max_values), frozenset(c for c in columns if nulls[c]))

    def output_columns(self) -> list[str]:
        return list(self.ordinal) + [f"{c}_{v}" for c, vs in self.onehot.items() for v in vs]

    def transform(self, df: DataFrame, onehot_dtype: str = "double") -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.ordinal:
                codes = [F.when(F.col(c).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in enumerate(self.ordinal[c])]
                out.append((F.coalesce(*codes) if codes else F.lit(None)).cast("long").alias(c))
            elif c not in self.onehot:
                out.append(F.col(c))
        for c, values in self.onehot.items():
            for v in values:
                out.append(F.when(F.col(c) == v, F.lit(1)).otherwise(F.lit(0)).cast(onehot_dtype).alias(f"{c}_{v}"))
        return df.select(*out)
