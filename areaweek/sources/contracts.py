"""Contract check: coerce rows to a schema and say why a row does not fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REASONS = "contract_reasons"


def _typed(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.DateType):
        return F.try_to_date(F.substring(value.cast("string"), 1, 10))
    if isinstance(data_type, T.StringType):
        return value.cast("string")
    return value.try_cast(data_type)


def check(rows: DataFrame, schema: T.StructType, defaults: dict | None = None, allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Typed columns plus the list of reasons; an empty list means the row is valid."""
    defaults, allowed = defaults or {}, allowed or {}
    typed, problems = [], []
    for field in schema.fields:
        raw = F.col(field.name) if field.name in rows.columns else F.lit(None)
        value = _typed(raw, field.dataType)
        problems.append(F.when(raw.isNotNull() & value.isNull(), F.lit(f"{field.name}: wrong type")))
        if field.name in defaults:
            value = F.when(raw.isNull(), F.lit(defaults[field.name]).cast(field.dataType)).otherwise(value)
        elif not field.nullable:
            problems.append(F.when(raw.isNull(), F.lit(f"{field.name}: missing")))
        typed.append(value.alias(field.name))
        if field.name in allowed:
            problems.append(F.when(value.isNotNull() & ~value.isin(*allowed[field.name]), F.lit(f"{field.name}: not an allowed value")))
    return rows.select(*typed, F.filter(F.array(*problems), lambda r: r.isNotNull()).alias(REASONS))


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.size(REASONS) == 0).drop(REASONS)


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.size(REASONS) > 0)


class ContractBroken(ValueError):
    """A batch holds rows that do not fit the contract."""


def require_valid(checked: DataFrame) -> DataFrame:
    """All rows, or an error that shows a few of the bad ones."""
    bad = quarantined(checked).select(REASONS).limit(5).collect()
    if bad:
        raise ContractBroken("; ".join(", ".join(r[0]) for r in bad))
    return valid(checked)
