"""Payloads as typed, multi-valued fields, and filters as Catalyst predicates over them.

A payload's fields are an array of (field, sval, ival) in its row, so a filter is a narrow predicate
without join or shuffle. A predicate holds if any value of its field satisfies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcavec.plans import filter_language as L


def fields(payload: Column) -> Column:
    """Tokens ``name=value`` of a payload; the value is an integer (ival) or a keyword (sval). Tokens without a name or an equals sign don't count."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(payload, F.lit("")), r"\s+", " ")), " "), lambda t: F.instr(t, "=") > 1)

    def field(t: Column) -> Column:
        at = F.instr(t, "=")
        raw = F.substring(t, at + 1, F.length(t))
        ival = F.when(raw.rlike(r"^[+-]?[0-9]+$"), raw.try_cast("long"))
        return F.struct(F.substring(t, F.lit(1), at - 1).alias("field"), F.when(ival.isNull(), raw).alias("sval"), ival.alias("ival"))

    return F.transform(tokens, field)


def explode_fields(payloads: DataFrame, key: str = "vec_id", payload: str = "payload") -> DataFrame:
    """(key, field, sval, ival), a row for each value."""
    return payloads.select(key, F.explode(fields(F.col(payload))).alias("f")).select(key, "f.field", "f.sval", "f.ival")


def _above(x: Column, v: L.Value, strict: bool) -> Column:
    if v.number is not None:
        return F.coalesce(x["ival"] > v.number if strict else x["ival"] >= v.number, F.lit(False))
    return x["ival"].isNotNull() | F.coalesce(x["sval"] > v.text if strict else x["sval"] >= v.text, F.lit(False))


def _below(x: Column, v: L.Value, strict: bool) -> Column:
    if v.number is not None:
        return x["ival"].isNull() | F.coalesce(x["ival"] < v.number if strict else x["ival"] <= v.number, F.lit(False))
    return x["ival"].isNull() & F.coalesce(x["sval"] < v.text if strict else x["sval"] <= v.text, F.lit(False))


def _holds(x: Column, tree) -> Column:
    if isinstance(tree, L.Exists):
        return F.lit(True)
    if isinstance(tree, L.Equal):
        numbers, texts = [v.number for v in tree.values if v.number is not None], [v.text for v in tree.values if v.number is None]
        return F.coalesce(x["ival"].isin(numbers) if numbers else F.lit(False), F.lit(False)) | F.coalesce(x["sval"].isin(texts) if texts else F.lit(False), F.lit(False))
    low = _above(x, tree.low, tree.strict) if tree.low else F.lit(True)
    return low & (_below(x, tree.high, tree.strict) if tree.high else F.lit(True))


def _compile(tree, values: Column) -> Column:
    if isinstance(tree, L.Both):
        return _compile(tree.left, values) & _compile(tree.right, values)
    if isinstance(tree, L.Either):
        return _compile(tree.left, values) | _compile(tree.right, values)
    if isinstance(tree, L.Negated):
        return ~_compile(tree.inner, values)
    return F.exists(values, lambda x: (x["field"] == tree.field) & _holds(x, tree))


def predicate(text: str, payload: Column) -> Column:
    """A filter as a predicate on a payload column. A row without any field matches no filter, not even a negated one."""
    values = fields(payload)
    return (F.size(values) > 0) & _compile(L.parse(text), values)
