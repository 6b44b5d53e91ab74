"""Column-name utilities: pure functions on names and schemas (no data read)."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskfold.constants import NAME_SPECIAL_CHARS

#: What separates the words of a name: special characters and underscores.
_BREAKS = re.compile(f"(?:{NAME_SPECIAL_CHARS}|_)+")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def sanitize_name(name) -> str:
    """Model-safe column name: the words of the name joined by single
    underscores.  A name without any word is called after its checksum, which
    is the same in every process; a name must not begin with a digit."""
    words = [w for w in _BREAKS.split(str(name)) if w]
    if not words:
        return f"col_{zlib.crc32(str(name).encode('utf-8')):08x}"
    lead = "_" if words[0][0].isdigit() else ""
    return lead + "_".join(words)


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename every column with :func:`sanitize_name`; fail on collisions."""
    new = [sanitize_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"sanitised names collide: {seen[n]!r} and {old!r} -> {n!r}")
        seen[n] = old
    return df.toDF(*new)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
