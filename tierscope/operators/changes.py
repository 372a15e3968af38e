"""What changed between two states of a table, such as two years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.operators import normalize
from tierscope.operators.normalize import Tables

ADDED, REMOVED, CHANGED = "added", "removed", "changed"


def changes(
    before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Keys whose rows differ: the keys, change, rows_before, rows_after, changed_columns.

    Rows are compared as they are, NULL equal to NULL, over `keys` and `columns` (all others if
    not given). A key is added or removed if it has rows on one side only; otherwise it is
    changed. The counts are of the key's rows that the other side lacks; where both are 1,
    changed_columns names what differs, in the order of the columns, otherwise it is NULL.

    Equal rows cancel out by count before any key is looked at, so repeated rows and keys with
    very many rows are no burden: what meets by key is only what differs.
    """
    columns = list(columns) if columns is not None else [c for c in before.columns if c not in keys]
    sides = [
        df.select(*keys, *columns, F.lit(sign).alias("n_")) for df, sign in ((before, -1), (after, 1))
    ]
    rows = sides[0].union(sides[1]).groupBy(*keys, *columns).agg(F.sum("n_").alias("n_"))
    differ = rows.where(F.col("n_") != 0)
    gone, come = F.col("n_") < 0, F.col("n_") > 0
    values = F.struct(*[F.col(c) for c in columns])
    by_key = differ.groupBy(*keys).agg(
        F.sum(F.when(gone, -F.col("n_")).otherwise(0)).alias("rows_before"),
        F.sum(F.when(come, F.col("n_")).otherwise(0)).alias("rows_after"),
        F.first(F.when(gone, values), True).alias("old_"),
        F.first(F.when(come, values), True).alias("new_"),
    )
    # A key that both sides have may still differ by rows of one side only.
    shared = by_key.where("rows_before = 0 OR rows_after = 0").select(*keys)
    kept = _held_by_both(before, after, keys, shared)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    found = by_key.join(kept.toDF(*[f"{k}_" for k in keys], "both_"), same, "left")
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"old_.{c}").eqNullSafe(F.col(f"new_.{c}")), F.lit(c)) for c in columns
    ]))
    return found.select(
        *keys,
        F.when((F.col("rows_before") > 0) & (F.col("rows_after") > 0), CHANGED)
        .when(F.col("both_"), CHANGED)
        .when(F.col("rows_after") > 0, ADDED).otherwise(REMOVED).alias("change"),
        "rows_before", "rows_after",
        F.when((F.col("rows_before") == 1) & (F.col("rows_after") == 1), F.array_join(differing, ","))
        .alias("changed_columns"),
    )


def _held_by_both(before: DataFrame, after: DataFrame, keys: Sequence[str], few: DataFrame) -> DataFrame:
    """Of some keys those that rows of both tables have, with TRUE."""
    def held(df: DataFrame) -> DataFrame:
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        return df.select(*keys).distinct().alias("l").join(few.alias("r"), same, "left_semi")

    return held(before).intersect(held(after)).withColumn("both_", F.lit(True))


def plan_changes(before: Tables, after: Tables) -> DataFrame:
    """Plans added, removed or changed, by plan key."""
    return changes(normalize.plans(before), normalize.plans(after), ["plan_key"])


def drug_list_changes(before: Tables, after: Tables) -> DataFrame:
    """Entries of drug lists added, removed or changed, by list and drug."""
    compared = ["rxcui", "tier_level_value", "quantity_limit_yn", "quantity_limit_amount",
                "quantity_limit_days", "prior_authorization_yn", "step_therapy_yn"]
    return changes(
        before["drug_list_drugs"], after["drug_list_drugs"], ["drug_list_id", "ndc"], compared
    )
