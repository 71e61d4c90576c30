"""Declarative casts of chosen columns, in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonewright.functions.columns import col, name_folding
from zonewright.plans.spec import CastRule, as_rules


def cast_columns(
    df: DataFrame, rules: Sequence[str | CastRule], on_error: str = "raise"
) -> DataFrame:
    """Apply the cast rules in order; a later rule on a column sees the earlier result.

    ``on_error="raise"`` is Spark's ANSI cast, which fails on overflow or bad text;
    ``"null"`` gives NULL for such values.
    """
    if on_error not in ("raise", "null"):
        raise ValueError(f"on_error must be 'raise' or 'null', not {on_error!r}")
    fold = name_folding(df)
    names = {fold(c): c for c in df.columns}
    result: dict[str, Column] = {}
    for rule in as_rules(rules):
        name = names.get(fold(rule.column), rule.column)
        value = result.get(name, col(name))
        if rule.kind == "array":
            # A NULL array becomes '', NULL elements are left out, commas are not escaped.
            result[name] = F.concat_ws(",", value)
        else:
            target = (
                T.DecimalType(rule.precision, rule.scale)
                if rule.kind == "decimal"
                else T.StringType()
            )
            result[name] = (
                value.cast(target) if on_error == "raise" else value.try_cast(target)
            )
    return df.withColumns(result)
