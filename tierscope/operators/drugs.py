"""Single drugs, drug names, dosages and drug groups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.functions.aggregates import count_items
from tierscope.functions.expr import as_column, count_if, dollars, tier_name, yes
from tierscope.functions.params import keep_values, parameter_frame
from tierscope.operators.normalize import Tables

# Drug concepts shown first on a tier page.
PRIORITY_RXCUIS = (
    1551291, 1992590, 1547545, 2058316, 274783, 204928,
    854905, 2361259, 1926072, 2360764, 1856278, 1657223,
    1791852, 1547469, 2589459, 627121, 1551291, 1551393,
    1660014, 1791841, 1944007, 2608253, 629466, 1602689,
    1792778, 1873988, 1306460, 2360756, 2360763, 904420,
    1792776, 2117292, 1657223, 1234571, 2055348, 332122,
)

# Strength patterns in a drug description.
STRENGTH_NUMBER = r"(?i)(\d+(?:\.\d+)?)\s*(?:MG/ML|MG)"
STRENGTH_UNIT = r"(?i)\d+(?:\.\d+)?\s*(MG/ML|MG)"
ANY_NUMBER = r"(\d+(?:\.\d+)?)"


def _entries(t: Tables, ndc: str | Column) -> DataFrame:
    return t["drug_list_drugs"].where(F.col("ndc") == as_column(ndc))


def drug_overview(t: Tables, ndc: str | Column) -> DataFrame:
    """Drug lists listing a drug, and its entries."""
    return _entries(t, ndc).groupBy("ndc", "rxcui").agg(
        F.countDistinct("drug_list_id").alias("drug_lists_covering"),
        F.count("*").alias("total_entries"),
    )


def drug_tiers(
    t: Tables, ndc: str | Column, names: Mapping[int, str] = S.TIER_NAMES_SHORT
) -> DataFrame:
    """Tiers in which drug lists place a drug."""
    return _entries(t, ndc).groupBy(F.col("tier_level_value").alias("tier")).agg(
        F.countDistinct("drug_list_id").alias("drug_lists"),
        F.count("*").alias("entries"),
    ).withColumn("tier_name", tier_name(F.col("tier"), names)).orderBy(
        F.desc("drug_lists"), F.asc_nulls_last("tier")
    )


def drug_restrictions(t: Tables, ndc: str | Column) -> DataFrame:
    """Restricted entries of a drug."""
    return _entries(t, ndc).agg(
        count_if(yes("prior_authorization_yn")).alias("with_prior_auth"),
        count_if(yes("quantity_limit_yn")).alias("with_qty_limits"),
        count_if(yes("step_therapy_yn")).alias("with_step_therapy"),
        F.count("*").alias("total_entries"),
    )


def drug_plans(t: Tables, ndc: str | Column, limit: int | None = None) -> DataFrame:
    """Plans covering a drug, cheapest first."""
    offered = t["plan_information"].select(
        "contract_id", "plan_id", "plan_name", "drug_list_id", "premium"
    ).distinct()
    listed = _entries(t, ndc).select(
        "drug_list_id",
        F.col("tier_level_value").alias("tier"),
        F.col("prior_authorization_yn").alias("pa"),
        F.col("quantity_limit_yn").alias("qty_limit"),
    ).distinct()
    found = offered.join(listed, "drug_list_id").select(
        "contract_id", "plan_id", "plan_name", "tier", "drug_list_id", "premium", "pa",
        "qty_limit",
    ).orderBy(
        F.asc_nulls_last("premium"), "contract_id", "plan_id", "plan_name", "tier",
        "drug_list_id", "pa", "qty_limit",
    )
    return found if limit is None else found.limit(limit)


def drug_cost_samples(t: Tables, ndc: str | Column, plans: int | None = None) -> DataFrame:
    """What a member pays for a drug in the plans covering it, in words; in the first few
    plans if their number is given.

    Plans without a cost rule for the drug's tier are left out; one rule per plan.
    """
    offered = t["plan_information"].select(
        "plan_key", "contract_id", "plan_id", "drug_list_id"
    ).distinct()
    listed = _entries(t, ndc).select(
        "drug_list_id", F.col("tier_level_value").alias("tier")
    ).distinct()
    sample = offered.join(listed, "drug_list_id").select(
        "plan_key", "contract_id", "plan_id", "tier"
    ).distinct()
    if plans is not None:
        sample = sample.orderBy("plan_key", "tier", "contract_id", "plan_id").limit(plans)
    rules = t["beneficiary_costs"].where(
        (F.col("coverage_level") == 1) & (F.col("days_supply") == 1)
    )
    rule = F.struct(
        F.col("cost_type_pref").alias("kind"),
        F.col("cost_amt_pref").alias("amount"),
        F.col("cost_max_amt_pref").alias("cap"),
    )
    first = rules.join(sample, ["plan_key", "tier"]).groupBy(
        "plan_key", "contract_id", "plan_id", "tier"
    ).agg(F.min(rule).alias("rule"))
    kind, amount, cap = (F.col(f"rule.{part}") for part in ("kind", "amount", "cap"))
    share = F.concat(
        F.format_string("%.0f%% coinsurance", F.bround((amount * 100).cast("double"))),
        F.coalesce(F.concat(F.lit(" (max "), dollars(cap), F.lit(")")), F.lit("")),
    )
    return first.select(
        "contract_id", "plan_id", "tier",
        F.when(kind == S.COPAY, F.concat(dollars(amount), F.lit(" copay")))
        .when(kind == S.COINSURANCE, share)
        .otherwise(F.lit("No charge")).alias("cost_text"),
    )


def specialty_coverage_rows(t: Tables, limit: int | None = None) -> DataFrame:
    """Specialty drugs by the drug lists listing them; authorizations counted by row."""
    counted = t["drug_list_drugs"].where(
        F.col("tier_level_value") == S.SPECIALTY_TIER
    ).groupBy("ndc", "rxcui").agg(
        F.countDistinct("drug_list_id").alias("drug_list_count"),
        count_if(yes("prior_authorization_yn")).alias("pa_required_count"),
    ).orderBy(F.desc("drug_list_count"), F.asc_nulls_last("ndc"), F.asc_nulls_last("rxcui"))
    return counted if limit is None else counted.limit(limit)


def specialty_coverage(t: Tables, limit: int | None = None) -> DataFrame:
    """Specialty drugs by the drug lists listing them; restrictions by drug list."""
    counted = count_items(
        t["drug_list_drugs"].where(F.col("tier_level_value") == S.SPECIALTY_TIER),
        ["ndc"], "drug_list_id", "drug_list_count",
        {
            "pa_required_count": yes("prior_authorization_yn"),
            "qty_limit_count": yes("quantity_limit_yn"),
        },
    ).orderBy(F.desc("drug_list_count"), F.asc_nulls_last("ndc"))
    return counted if limit is None else counted.limit(limit)


def drug_dosages(names: DataFrame) -> DataFrame:
    """Strength of each drug, read from its description.

    The largest number of at least 1 followed by MG/ML or MG, the first of equals;
    else the last such number; else the first number and `mg`; else `N/A`.
    """
    text = F.col("description")
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(STRENGTH_NUMBER), F.lit(1)).alias("num"),
        F.regexp_extract_all(text, F.lit(STRENGTH_UNIT), F.lit(1)).alias("unit"),
    )
    size = lambda m: m["num"].cast("double")
    whole = F.filter("found", lambda m: size(m) >= 1)
    largest = F.array_max(F.transform(whole, size))
    best = F.try_element_at(F.filter(whole, lambda m: size(m) == largest), F.lit(1))
    last = F.try_element_at(F.col("found"), F.lit(-1))
    number = F.regexp_extract(text, ANY_NUMBER, 1)
    strength = lambda m: F.concat(m["num"], F.lit(" "), m["unit"])
    return names.withColumn("found", found).select(
        "rxcui",
        F.coalesce(
            strength(best),
            strength(last),
            F.when(number != "", F.concat(number, F.lit("mg"))),
            F.lit("N/A"),
        ).alias("dosage"),
    )


def group_entries(t: Tables, groups: Mapping[str, Sequence[int]]) -> DataFrame:
    """Drug list entries of named groups of drug concepts, with `drug_name`."""
    rows = [(name, rxcui) for name, listed in groups.items() for rxcui in dict.fromkeys(listed)]
    members = parameter_frame(t["drug_list_drugs"].sparkSession, rows, "drug_name string, rxcui long")
    coded = t["drug_list_drugs"].where(F.col("ndc").isNotNull() & (F.col("ndc") != ""))
    return keep_values(coded, "rxcui", [rxcui for _, rxcui in rows]).join(members, "rxcui")


def group_ndcs(t: Tables, groups: Mapping[str, Sequence[int]]) -> DataFrame:
    """Drug codes listed for each named group of drug concepts."""
    return group_entries(t, groups).select("drug_name", "rxcui", "ndc").distinct()


def priority_sort(
    df: DataFrame, rxcuis: Iterable[int] = PRIORITY_RXCUIS, cost: str = "negotiated_cost"
) -> DataFrame:
    """Listed drug concepts first, then by cost, highest first."""
    return df.orderBy(
        F.col("rxcui").isin(sorted(set(rxcuis))).desc(), F.desc(cost), "ndc", "rxcui"
    )


def with_drug_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `drug_name`, or `RxCUI n` for concepts without a description."""
    described = names.select("rxcui", F.col("description").alias("drug_name"))
    return df.join(described, "rxcui", "left").withColumn(
        "drug_name",
        F.coalesce("drug_name", F.concat(F.lit("RxCUI "), F.col("rxcui").cast("string"))),
    )
