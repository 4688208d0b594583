"""Aggregates over a dimension left-joined to several facts, without the product.

Joining three facts to one dimension multiplies their rows per entity: sums and counts
grow by the row counts of the other facts, and averages weigh entities by them. The
same numbers follow from one aggregate per fact: with R rows of a fact for an entity
(one where it has none, as in a left join), a value of that fact appears once per
combination of the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import partials, rounded


def _product(facts: Iterable[str]) -> str:
    """SQL for the rows of a left join to these facts. Three facts of up to a trillion
    rows per entity fit the type."""
    out = "CAST(1 AS DECIMAL(38,0))"
    for name in facts:
        out = f"CAST({out} * CAST(coalesce({name}_rows, 1) AS DECIMAL(19,0)) AS DECIMAL(38,0))"
    return out


def fanout_partials(
    entities: DataFrame, key: str, facts: Mapping[str, tuple[DataFrame, Mapping[str, str]]]
) -> DataFrame:
    """Entities with the sums and counts of every fact's values and the row multipliers.

    For a fact ``f`` the column ``f_others`` is the product of the other facts' rows,
    and ``all_rows`` the product of all.
    """
    return with_multipliers(entities, key, {n: fact.groupBy(key).agg(*partials(values)) for n, (fact, values) in facts.items()})


def with_multipliers(entities: DataFrame, key: str, sums: Mapping[str, DataFrame]) -> DataFrame:
    """As ``fanout_partials``, of facts that are aggregated already: one row per key at most."""
    out = entities
    for name, per in sums.items():
        out = out.join(per.withColumnRenamed("rows", f"{name}_rows"), key, "left")
    return out.selectExpr(
        "*",
        *[f"{_product(m for m in sums if m != n)} AS {n}_others" for n in sums],
        f"{_product(sums)} AS all_rows",
    )


def _repeated(amount: str, others: str) -> str:
    """Exact sum of an amount times a row product, up to 34 digits before the point.

    A product or sum beyond that raises, whatever the session does about overflows.
    """
    product = f"CAST(try_multiply({amount}, {others}) AS DECIMAL(38,4))"
    whole = f"try_sum({product})"
    lost = f"count({product}) < count({amount}) OR (count({amount}) > 0 AND {whole} IS NULL)"
    return f"CASE WHEN {lost} THEN raise_error('{amount} times {others} is too large') ELSE {whole} END"


def repeated_sum(value: str, others: str) -> Column:
    """Sum over the product, of a whole number."""
    return F.expr(f"CAST({_repeated(f'{value}_sum', others)} AS DECIMAL(38,0))")


def repeated_mean(value: str, others: str, scale: int) -> Column:
    """Average over the product; only the quotient is formed in doubles."""
    top, bottom = (f"CAST({_repeated(f'{value}_{part}', others)} AS DOUBLE)" for part in ("sum", "cnt"))
    return F.expr(rounded(f"{top} / nullif({bottom}, 0D)", scale))


def repeated_count(condition: str, others: str = "all_rows") -> Column:
    """How often a condition on the entity holds over the product; 0 when never."""
    return F.expr(f"sum(CASE WHEN {condition} THEN {others} ELSE 0 END)")
