"""Column expressions shared by the operators; all stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierscope import schemas as S


def as_column(value) -> Column:
    """A literal, unless the caller already passes a column (such as a scalar subquery)."""
    return value if isinstance(value, Column) else F.lit(value)


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value, so 0.285 gives 0.29 whatever the engine."""
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def rounded_even(value: Column, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(value.cast("double"), digits)


def mean(value: Column | str) -> Column:
    """Average of a decimal column as DOUBLE, NULL for no values.

    The sum is exact, so the result does not depend on how rows were partitioned.
    """
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def mean2(value: Column | str) -> Column:
    return rounded(mean(value), 2)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part * 100 / whole, NULL when whole is 0."""
    return rounded(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits)


def percent_or_zero(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.coalesce(percent(part, whole, digits), F.lit(0.0))


def count_if(condition: Column) -> Column:
    """Number of rows meeting a condition; NULL over no rows at all, as SUM is."""
    return F.sum(F.when(condition, 1).otherwise(0))


def yes(column: str) -> Column:
    return F.col(column) == "Y"


def label(column: Column, names: Mapping, default: Column | str) -> Column:
    """CASE over a small code table."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, text in names.items():
        chain = chain.when(column == F.lit(code), F.lit(text))
    return chain.otherwise(as_column(default))


def tier_name(column: Column, names: Mapping[int, str] = S.TIER_NAMES) -> Column:
    return label(column, names, "Other")


def cost_type_name(column: Column) -> Column:
    return label(column, S.COST_TYPES, "No Charge")


def restriction_label() -> Column:
    """`Qty Limit, Prior Auth, Step Therapy` for the flags set, or `None`."""
    return _joined_flags(
        ", ",
        "None",
        ("quantity_limit_yn", "Qty Limit"),
        ("prior_authorization_yn", "Prior Auth"),
        ("step_therapy_yn", "Step Therapy"),
    )


def restriction_codes() -> Column:
    """`PA ST QL` for the flags set, or `-`."""
    return _joined_flags(
        " ",
        "-",
        ("prior_authorization_yn", "PA"),
        ("step_therapy_yn", "ST"),
        ("quantity_limit_yn", "QL"),
    )


def _joined_flags(separator: str, empty: str, *flags: tuple[str, str]) -> Column:
    text = F.concat_ws(separator, *[F.when(yes(name), F.lit(word)) for name, word in flags])
    return F.when(text == "", F.lit(empty)).otherwise(text)


def dollars(value: Column) -> Column:
    """`$1.50`; NULL stays NULL. format_string needs DOUBLE, not DECIMAL."""
    return F.when(value.isNotNull(), F.format_string("$%.2f", value.cast("double")))


def number_text(value: Column) -> Column:
    """A number without a trailing `.0`."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def price_text(value: Column, positive_only: bool = False) -> Column:
    """`$1.50` or `N/A`; with positive_only, zero also reads `N/A`."""
    shown = F.when(value > 0, dollars(value)) if positive_only else dollars(value)
    return F.coalesce(shown, F.lit("N/A"))


def plan_key(parts=S.PLAN_KEY_PARTS) -> Column:
    """`contract|plan|segment`, NULL when any part is NULL."""
    first, *rest = parts
    pieces = [F.col(first)]
    for part in rest:
        pieces += [F.lit("|"), F.col(part)]
    return F.concat(*pieces)
