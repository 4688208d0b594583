"""Two-level aggregation.

Facts are first reduced to (entity, other keys), which combines on the map side and
spreads a hot region or measure over its entities; attributes of the entity are joined
to that reduced frame, and the second level adds the partial results up. Because the
first level is unique per entity, counting its rows counts distinct entities.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "count(1)"


def partials(
    values: Mapping[str, str],
    flags: Mapping[str, str] | None = None,
    squares: Iterable[str] = (),
) -> list[Column]:
    """Partial aggregates of each value, and counts of each flag (SQL expressions).

    Unused ones cost nothing: column pruning removes them from the plan.
    """
    out = [f"{ROWS} AS rows"]
    for name, c in values.items():
        out += [f"{f}({c}) AS {name}_{part}" for f, part in
                (("sum", "sum"), ("count", "cnt"), ("min", "min"), ("max", "max"))]
        if name in squares:
            out.append(f"sum({c} * {c}) AS {name}_sq")
    out += [f"count_if({condition}) AS {name}" for name, condition in (flags or {}).items()]
    return [F.expr(x) for x in out]


def merged(values: Mapping[str, tuple[str, str | None]]) -> list[Column]:
    """``partials`` of partials: under each name the sum and count of a value, over the rows that
    meet a condition, if one is given."""
    out = ["sum(rows) AS rows"]
    for name, (value, where) in values.items():
        for part in ("sum", "cnt"):
            c = f"{value}_{part}"
            out.append(f"sum({c if where is None else f'CASE WHEN {where} THEN {c} END'}) AS {name}_{part}")
    return [F.expr(x) for x in out]


def rows() -> Column:
    return F.expr(ROWS)


def total(name: str) -> Column:
    return F.expr(f"sum({name}_sum)")


def mean(name: str, scale: int) -> Column:
    """Average over the original rows, rounded half away from zero."""
    return F.expr(_quotient(f"sum({name}_sum)", f"sum({name}_cnt)", scale))


def deviation(name: str, scale: int) -> Column:
    """Sample standard deviation from moments; NULL below two values.

    Exact in whole ten-thousandths, as far as 38 digits hold the sum of squares: with n
    values, sum s = q * n + r and sum of squares Q, the squared distances from the mean are
    (Q - q * q * n - 2 * q * r) - r * r / n, where nothing large cancels in doubles.
    """
    n = f"CAST(sum({name}_cnt) AS DECIMAL(38,0))"
    s = f"CAST(sum({name}_sum) * 10000 AS DECIMAL(38,0))"
    squares = f"CAST(sum({name}_sq) * 100000000 AS DECIMAL(38,0))"
    some = f"nullif({n}, 0)"
    q, r = f"CAST({s} div {some} AS DECIMAL(38,0))", f"({s} % {some})"
    near = f"CAST({squares} - {q} * {q} * {n} - 2 * {q} * {r} AS DOUBLE)"
    rest = f"CAST({r} AS DOUBLE) * CAST({r} AS DOUBLE) / CAST({some} AS DOUBLE)"
    below = f"nullif(CAST({n} - 1 AS DOUBLE), 0D)"
    return F.expr(rounded(f"sqrt(greatest({near} - {rest}, 0D) / {below}) / 10000D", scale))


def _quotient(top: str, bottom: str, scale: int) -> str:
    """Rounded once, from more places than ``avg`` keeps; narrow, so that an average of
    averages is just as exact."""
    return f"CAST(round({top} / nullif({bottom}, 0), {scale}) AS DECIMAL(18,{scale}))"


def rounded(c: str, scale: int) -> str:
    """SQL to round a double half away from zero, free of binary noise around ties."""
    return f"round(CAST({c} AS DECIMAL(24,12)), {scale})"


def average(value: str, scale: int, where: str | None = None) -> Column:
    """Rounded average of a value, over the rows that meet a condition."""
    c = value if where is None else f"CASE WHEN {where} THEN {value} END"
    return F.expr(_quotient(f"sum({c})", f"count({c})", scale))


def value_of(id_column: str, wanted: str, value: str) -> Column:
    """One cell of a pivot: the largest value among the rows of one id."""
    return F.expr(f"max(CASE WHEN upper({id_column}) = '{wanted.upper()}' THEN {value} END)")


def one_of(id_column: str, wanted: Iterable[str]) -> str:
    """SQL condition: the id is among the wanted ones, case ignored."""
    return f"upper({id_column}) IN ({', '.join(repr(w.upper()) for w in wanted)})"


def ordered_list(text: str, count: str, separator: str = ", ") -> Column:
    """Sorted, separated list of texts, each repeated as often as it was counted.

    Takes rows already counted per (group, text), so that a group collects one entry
    per distinct text however many rows stood behind it. The text itself grows with the
    counts; where they are large, ``counted_list`` is the one to use. NULL when nothing
    counts; a count that no text can hold raises.
    """
    entries = f"array_sort(collect_list(CASE WHEN {count} > 0 THEN struct({text} AS t, {count} AS n) END))"
    most = "2147483647"
    times = f"CASE WHEN e.n > {most} THEN raise_error('a text cannot hold so many entries') ELSE int(least(e.n, {most})) END"
    repeated = f"flatten(transform({entries}, e -> array_repeat(e.t, {times})))"
    return F.expr(f"nullif(array_join({repeated}, '{separator}'), '')")


def counted_list(text: str, count: str, separator: str = ", ") -> Column:
    """Sorted, separated list of texts, each once, with its count where that is over one.

    Grows with the number of different texts alone. NULL when nothing counts.
    """
    entries = f"array_sort(collect_list(CASE WHEN {count} > 0 THEN struct({text} AS t, {count} AS n) END))"
    shown = f"transform({entries}, e -> concat(e.t, CASE WHEN e.n > 1 THEN concat(' x', e.n) ELSE '' END))"
    return F.expr(f"nullif(array_join({shown}, '{separator}'), '')")


def spread_pivot(df: DataFrame, by: str, columns: str, labels, value: str, scale: int) -> DataFrame:
    """Matrix of averages with a fixed list of columns (so no extra pass to find them)."""
    return df.groupBy(by).pivot(columns, list(labels)).agg(average(value, scale))


def count_by(df: DataFrame, label: str, out: str = "hospital_count") -> DataFrame:
    return df.groupBy(label).agg(rows().alias(out))
