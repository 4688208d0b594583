"""Labels: keyword rules, tiers, flags and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _cases(pairs, rest: str | None) -> Column:
    whens = " ".join(f"WHEN {condition} THEN '{label}'" for condition, label in pairs)
    return F.expr(f"CASE {whens} ELSE {'NULL' if rest is None else repr(rest)} END")


def keyword_label(text: str, rules, rest: str | None = "Other", lowered: bool = False) -> Column:
    """Label of the first rule with a keyword contained in the text, case ignored.

    ``lowered`` says that the text is in lower case already.
    """
    t = text if lowered else f"lower({text})"
    return _cases(
        [
            (" OR ".join(f"contains({t}, '{w.lower()}')" for w in words), label)
            for words, label in rules
        ],
        rest,
    )


def volume_tier(volume: str) -> Column:
    return _cases([(f"{volume} >= {least}", label) for least, label in K.VOLUME_TIERS], K.VOLUME_REST)


def performance_tier(rating: str, rate: str, stars: str) -> Column:
    """Tier from overall rating, readmission rate and survey stars; order matters.

    A missing rate counts as 99 for the two upper tiers and as 0 for the lowest;
    missing stars count as 0. The rate band of "Average" is tested before the low
    rating, so a low-rated provider with a rate of 15 to 20 is "Average".
    """
    return _cases(
        [
            (f"{rating} >= 4 AND coalesce({rate}, 99) < 15 AND coalesce({stars}, 0) >= 4", K.TOP),
            (f"{rating} >= 3 AND coalesce({rate}, 99) < 18", K.ABOVE),
            (f"{rating} = 3 OR {rate} BETWEEN 15 AND 20", K.AVERAGE),
            (f"{rating} <= 2 OR coalesce({rate}, 0) > 20", K.BELOW),
        ],
        K.NO_DATA,
    )


def ratio_flag(ratio: str) -> Column:
    return _cases(
        [
            (f"{ratio} > 1", "Above Expected"),
            (f"{ratio} < 1", "Below Expected"),
            (f"{ratio} = 1", "At Expected"),
        ],
        None,
    )


def rating_band(rating: str) -> Column:
    return _cases(
        [(f"{rating} IN (4, 5)", "green"), (f"{rating} = 3", "yellow"), (f"{rating} IN (1, 2)", "red")],
        None,
    )


def same_text(column: str, text: str) -> str:
    """SQL condition: the column holds this text, case ignored."""
    return f"upper({column}) = '{text.upper()}'"


def compared(label: str, column: str = "compared_to_national") -> str:
    """SQL condition: the comparison label, case ignored."""
    return f"lower({column}) = '{label.lower()}'"
