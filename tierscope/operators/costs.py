"""Negotiated prices, member cost shares and plan net costs.

Four net-cost rules exist and are kept apart, one per operator: they differ in the
coinsurance cap, in the treatment of NULL amounts and in what "no charge" means.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.functions.expr import (
    as_column,
    cost_type_name,
    dollars,
    mean,
    mean2,
    number_text,
    price_text,
    rounded,
)
from tierscope.functions.params import keep_matching, keep_values
from tierscope.operators.drug_list import SPECIALTY_TIERS, specialty_drug_groups
from tierscope.operators.normalize import Tables, plan_columns



def _unit() -> Column:
    return F.col("unit_cost")


def _kind() -> Column:
    return F.col("cost_type_pref")


def _amount() -> Column:
    return F.col("cost_amt_pref")


def _cap() -> Column:
    return F.col("cost_max_amt_pref")


# ---------------------------------------------------------------- shared joins

def _prices(t: Tables, days: int | None = 30) -> DataFrame:
    rows = t["drug_pricing"].select("plan_key", "ndc", "days_supply", "unit_cost")
    return rows if days is None else rows.where(F.col("days_supply") == days)


def _rules(t: Tables, *columns: str, coverage_level: int = 1, supply_code: int = 1) -> DataFrame:
    """Cost rules at one coverage level and supply code, by plan and tier."""
    return t["beneficiary_costs"].where(
        (F.col("coverage_level") == coverage_level) & (F.col("days_supply") == supply_code)
    ).select("plan_key", "tier", *columns)


def _listed(t: Tables, tier: int | None = None) -> DataFrame:
    rows = t["drug_list_drugs"].select(
        "drug_list_id", "ndc", F.col("tier_level_value").alias("tier")
    )
    return rows if tier is None else rows.where(F.col("tier") == tier)


def _priced_listings(prices: DataFrame, plans: DataFrame, listed: DataFrame) -> DataFrame:
    """Prices of plans for the drugs on their own drug list.

    Prices meet plans first (one row per plan), then the drug lists on drug list AND
    drug. Joining plans to drug lists by drug list alone would multiply the two.
    """
    return prices.join(plans, "plan_key").join(listed, ["drug_list_id", "ndc"])


# ---------------------------------------------------------------- net cost of specialty drugs

def capped_share() -> Column:
    """Coinsurance of a price, at most the cap; a NULL cap or amount is ignored."""
    return F.least(_unit() * _amount(), _cap())


def county_drug_costs(
    t: Tables, county_code: str, ndc: str | Column, tier: int = S.SPECIALTY_TIER, days: int = 30
) -> DataFrame:
    """One drug's price, cost share and plan net cost over the plans of a county.

    Net cost takes off the copay or the uncapped coinsurance. One row per plan x
    county row and listing.
    """
    offered = t["plan_information"].where(F.col("county_code") == county_code).select(
        "plan_key", "contract_id", "plan_id", "contract_name", "premium", "deductible",
        "drug_list_id",
    )
    drug = F.col("ndc") == as_column(ndc)
    priced = _priced_listings(_prices(t, days).where(drug), offered, _listed(t, tier).where(drug))
    rules = _rules(t, "cost_type_pref", "cost_amt_pref", "cost_max_amt_pref")
    net = (
        F.when(_kind() == S.COPAY, _unit() - F.coalesce(_amount(), F.lit(0)))
        .when(_kind() == S.COINSURANCE, _unit() - _unit() * _amount())
        .otherwise(_unit())
    )
    return priced.join(rules, ["plan_key", "tier"], "left").orderBy(
        F.asc_nulls_last("unit_cost"), "plan_key"
    ).select(
        "ndc", "contract_id", "plan_id", "contract_name", "premium", "deductible",
        F.round(_unit(), 2).alias("negotiated_cost"),
        "cost_type_pref",
        F.round(_amount(), 2).alias("member_cost_amt"),
        F.round(_cap(), 2).alias("member_cost_max"),
        net.alias("plan_net_cost"),
    )


def county_drug_costs_basic(
    t: Tables, county_code: str, ndc: str | Column, days: int = 30
) -> DataFrame:
    """Price minus cost amount for every cost rule of the plans of a county."""
    offered = t["plan_information"].where(F.col("county_code") == county_code).select(
        "plan_key", "contract_id", "plan_name"
    )
    rules = t["beneficiary_costs"].select("plan_key", "cost_amt_pref")
    return (
        _prices(t, days).where(F.col("ndc") == as_column(ndc))
        .join(offered, "plan_key").join(rules, "plan_key")
        .select(
            "contract_id", "plan_name",
            _unit().alias("negotiated_cost"),
            _amount().alias("member_copay"),
            (_unit() - _amount()).alias("plan_net_cost"),
        )
    )


def specialty_costs(t: Tables, days: int = 30) -> DataFrame:
    """Member payment and plan net cost of every priced specialty drug of every plan.

    The member pays the copay, the capped coinsurance or nothing; the plan the rest.
    """
    rules = _rules(t, "cost_type_pref", "cost_amt_pref", "cost_max_amt_pref").where(
        F.col("tier") == S.SPECIALTY_TIER
    ).drop("tier")
    # Both plan-grain tables meet first, so prices are shuffled by plan only once.
    plans = plan_columns(t, "contract_id", "drug_list_id").join(rules, "plan_key")
    priced = _priced_listings(_prices(t, days), plans, _listed(t, S.SPECIALTY_TIER))
    nothing = F.lit(0)
    pays = (
        F.when(_kind() == S.COPAY, _amount()).when(_kind() == S.COINSURANCE, capped_share())
        .otherwise(nothing)
    )
    return priced.select(
        "contract_id", "plan_key", "ndc",
        _unit().alias("negotiated_cost"),
        pays.alias("member_pays"),
        (_unit() - pays).alias("plan_net_cost"),
    )


def specialty_margin(t: Tables) -> DataFrame:
    """Average specialty price, member payment and plan net cost per contract."""
    return specialty_costs(t).groupBy("contract_id").agg(
        F.countDistinct("ndc").alias("specialty_drugs_priced"),
        mean2("negotiated_cost").alias("avg_negotiated_cost"),
        mean2("member_pays").alias("avg_member_pays"),
        mean2("plan_net_cost").alias("avg_plan_net_cost"),
    ).orderBy("avg_plan_net_cost", "contract_id")


def county_specialty_costs(t: Tables, county_code: str, days: int = 30) -> DataFrame:
    """Specialty drugs of a county's plans; net cost is price minus price x amount.

    A missing amount takes nothing off.
    """
    offered = t["plan_information"].where(F.col("county_code") == county_code).select(
        "plan_key", "contract_id", "plan_id", "premium", "deductible", "drug_list_id"
    )
    prices = keep_matching(_prices(t, days), "plan_key", offered)
    priced = _priced_listings(prices, offered, _listed(t, S.SPECIALTY_TIER))
    rules = _rules(t, "cost_amt_pref").where(F.col("tier") == S.SPECIALTY_TIER).drop("tier")
    return priced.join(rules, "plan_key").orderBy("ndc", "plan_key").select(
        "ndc", "contract_id", "plan_id", "premium", "deductible",
        _unit().alias("negotiated_cost"),
        _amount().alias("member_cost"),
        (_unit() - F.coalesce(_amount() * _unit(), _amount(), F.lit(0))).alias("plan_net_cost"),
    )


# ---------------------------------------------------------------- tier page

def tier_drugs_priced(
    t: Tables, drug_list_id: str, tier: int, limit: int | None = None
) -> DataFrame:
    """Drugs of a drug list tier with average price, member payment and plan net cost.

    Prices average over the plan x county rows of the drug list and all supplies. One
    cost rule stands for the tier: the lowest amount. Code 2 counts as coinsurance, an
    amount below 1 is a fraction, the cap is not applied. No rule, no rows.
    """
    drugs = t["drug_list_drugs"].where(
        (F.col("drug_list_id") == drug_list_id) & (F.col("tier_level_value") == tier)
    ).select(
        "rxcui", "ndc", F.col("tier_level_value").alias("tier"),
        F.col("prior_authorization_yn").alias("prior_auth"),
        F.col("step_therapy_yn").alias("step_therapy"),
        F.col("quantity_limit_yn").alias("quantity_limit"),
    ).distinct()
    # A plan's county rows become a weight, so prices are not repeated per county.
    weighted = t["plan_information"].where(F.col("drug_list_id") == drug_list_id).groupBy(
        "plan_key"
    ).agg(F.count("*").alias("counties"))
    prices = (
        keep_matching(_prices(t, None), "ndc", drugs).where(F.col("unit_cost").isNotNull())
        .join(weighted, "plan_key")
        .groupBy("ndc")
        .agg(
            F.try_divide(
                F.sum(_unit() * F.col("counties")).cast("double"), F.sum("counties")
            ).alias("avg_price")
        )
    )
    ruled = drugs.withColumn("rule", _lowest_rule(t, weighted, tier))
    kind, amount = F.col("rule.kind"), F.col("rule.amount").cast("double")
    price = F.col("avg_price")
    coinsured = kind.isin(S.COINSURANCE, S.NO_CHARGE)
    pays = (
        F.when(kind == S.COPAY, amount)
        .when(coinsured & (amount >= 1), price * (amount / 100.0))
        .when(coinsured & (amount < 1), price * amount)
        .otherwise(F.lit(0.0))
    )
    priced = ruled.where(F.col("rule").isNotNull()).join(prices, "ndc", "left").select(
        "rxcui", "ndc", "tier", "prior_auth", "step_therapy", "quantity_limit",
        F.coalesce(price, F.lit(0.0)).alias("negotiated_cost"),
        F.when(coinsured & (amount > 0), "COINSURANCE").otherwise("COPAY").alias("cost_type"),
        F.when(coinsured & (amount < 1), amount * 100).otherwise(amount).alias("cost_amt"),
        F.col("rule.specialty").alias("is_specialty"),
        pays.alias("member_pays"),
        (F.coalesce(price, F.lit(0.0)) - pays).alias("plan_net_cost"),
    ).orderBy(
        F.desc("negotiated_cost"), F.asc_nulls_last("ndc"), F.asc_nulls_last("rxcui"),
        "prior_auth", "step_therapy", "quantity_limit",
    )
    return priced if limit is None else priced.limit(limit)


def _lowest_rule(t: Tables, plans: DataFrame, tier: int) -> Column:
    """The cost rule with the lowest amount among the plans, as a struct or NULL."""
    rules = t["beneficiary_costs"].where(
        (F.col("coverage_level") == 1) & (F.col("tier") == tier)
    ).join(plans.select("plan_key"), "plan_key", "left_semi")
    lowest = F.min(
        F.struct(
            _amount().isNull().alias("missing"),
            _amount().alias("amount"),
            _kind().alias("kind"),
            F.col("tier_specialty_yn").alias("specialty"),
        )
    )
    return rules.agg(lowest.alias("rule")).scalar()


def tier_page_summary(t: Tables, drug_list_id: str, tier: int) -> DataFrame:
    """Averages over tier_drugs_priced(), missing payments counted as 0, and its rule."""
    drugs = tier_drugs_priced(t, drug_list_id, tier)
    averaged = drugs.agg(
        F.count("*").alias("total_drugs"),
        rounded(F.try_divide(F.sum("negotiated_cost"), F.count("*")), 2).alias("avg_negotiated"),
        rounded(F.try_divide(F.sum("member_pays"), F.count("*")), 2).alias("avg_member_pays"),
        F.min("cost_type").alias("cost_type"),  # the one rule, equal in every row
        F.min("cost_amt").alias("cost_amt"),
    )
    structure = F.when(
        F.col("cost_type") == "COPAY", F.concat(dollars(F.col("cost_amt")), F.lit(" copay"))
    ).when(
        F.col("cost_type") == "COINSURANCE",
        F.concat(number_text(F.col("cost_amt")), F.lit("% coinsurance")),
    ).otherwise(F.lit("N/A"))
    return averaged.select(
        "total_drugs", "avg_negotiated", "avg_member_pays", structure.alias("cost_structure")
    )


# ---------------------------------------------------------------- contracts

def contract_drug_costs(t: Tables, ndc: str | Column, days: int = 30) -> DataFrame:
    """Price of a drug per contract: plans, range, average and spread in percent."""
    priced = _prices(t, days).where(F.col("ndc") == as_column(ndc)).join(
        plan_columns(t, "contract_id", "contract_name"), "plan_key"
    )
    low, high = F.min("unit_cost"), F.max("unit_cost")
    spread = F.try_divide(
        high.cast("double") - low.cast("double"), low.cast("double")
    ) * 100
    return priced.groupBy("contract_name", "contract_id").agg(
        F.countDistinct("plan_key").alias("plan_count"),
        rounded(low, 2).alias("min_cost"),
        mean2("unit_cost").alias("avg_cost"),
        rounded(high, 2).alias("max_cost"),
        rounded(spread, 1).alias("cost_variation_pct"),
    ).where(F.col("plan_count") > 0).orderBy("avg_cost", "contract_id")


def contract_specialty_cost(t: Tables, days: int = 30) -> DataFrame:
    """Average specialty price per contract."""
    return _priced_listings(
        _prices(t, days),
        plan_columns(t, "contract_id", "drug_list_id"),
        _listed(t, S.SPECIALTY_TIER),
    ).groupBy("contract_id").agg(mean("unit_cost").alias("avg_cost")).orderBy(
        "avg_cost", "contract_id"
    )


def member_annual_cost(
    t: Tables,
    ndcs: Iterable[str] | Mapping[str, int],
    fills: int = 12,
    contract: str | None = None,
    days: int = 30,
) -> DataFrame:
    """Yearly cost of a drug list in each plan that covers and prices some of it.

    Twelve premiums, the deductible and the cost shares of all fills. `ndcs` may give
    the fills of each drug; a drug named twice is filled twice as often.
    """
    yearly = (
        dict(ndcs) if isinstance(ndcs, Mapping)
        else {ndc: n * fills for ndc, n in Counter(ndcs).items()}
    )
    times = F.create_map(*[F.lit(x) for pair in sorted(yearly.items()) for x in pair])
    offered = t["plan_information"]
    if contract is not None:
        offered = offered.where(F.col("contract_id") == contract)
    plans = offered.where(F.col("plan_key").isNotNull()).select(
        "plan_key", "plan_name", "premium", "deductible", "drug_list_id"
    ).distinct()
    priced = _priced_listings(
        keep_values(_prices(t, days), "ndc", yearly), plans,
        keep_values(_listed(t), "ndc", yearly),
    )
    rules = _rules(t, "cost_type_pref", "cost_amt_pref", "cost_max_amt_pref")
    share = (
        F.when(_kind() == S.COPAY, _amount()).when(_kind() == S.COINSURANCE, capped_share())
        .otherwise(F.lit(0))
    )
    spent = F.sum(share * F.element_at(times, F.col("ndc"))).alias("spent")
    return priced.join(rules, ["plan_key", "tier"]).groupBy(
        "plan_key", "plan_name", "premium", "deductible"
    ).agg(spent).select(
        "plan_key", "plan_name",
        F.round("premium", 2).alias("monthly_premium"),
        F.round("deductible", 2).alias("annual_deductible"),
        F.round("spent", 2).alias("annual_drug_costs"),
        F.round(F.col("premium") * 12 + F.col("deductible") + F.col("spent"), 2)
        .alias("total_annual_cost"),
    ).orderBy(F.asc_nulls_last("total_annual_cost"), "plan_key")


# ---------------------------------------------------------------- cost rules of one plan

def plan_cost_structure(t: Tables, plan_key: str | Column) -> DataFrame:
    """Cost rule of each tier of a plan, for one fill at initial coverage."""
    return _rules(
        t, "cost_type_pref", "cost_amt_pref", "cost_max_amt_pref", "tier_specialty_yn"
    ).where(F.col("plan_key") == as_column(plan_key)).select(
        "tier",
        cost_type_name(_kind()).alias("cost_type"),
        _amount().alias("amount"),
        _cap().alias("max_cap"),
        F.col("tier_specialty_yn").alias("specialty_flag"),
    ).orderBy("tier")


def sample_plan(t: Tables, drug_list_id: str) -> Column:
    """First plan key of a drug list, as a scalar subquery."""
    return t["plan_information"].where(F.col("drug_list_id") == drug_list_id).agg(
        F.min("plan_key")
    ).scalar()


def plan_cost_display(
    t: Tables, plan_key: str | Column, tiers: Iterable[int] | None = SPECIALTY_TIERS
) -> DataFrame:
    """First cost rule of each tier of a plan as text: `$x`, `x%` or `No Charge`."""
    rows = t["beneficiary_costs"].where(
        (F.col("plan_key") == as_column(plan_key)) & (F.col("coverage_level") == 1)
    )
    if tiers is not None:
        rows = rows.where(F.col("tier").isin(*tiers))
    first = rows.groupBy("tier").agg(
        F.min(F.struct("days_supply", "cost_type_pref", "cost_amt_pref")).alias("rule")
    )
    kind = F.col("rule.cost_type_pref")
    amount = F.format_string("%.2f", F.col("rule.cost_amt_pref").cast("double"))
    return first.select(
        "tier",
        cost_type_name(kind).alias("cost_type_label"),
        F.when(kind == S.COPAY, F.concat(F.lit("$"), amount))
        .when(kind == S.COINSURANCE, F.concat(amount, F.lit("%")))
        .otherwise(F.lit("No Charge")).alias("cost_display"),
    ).orderBy("tier")


def specialty_pricing(
    t: Tables, drug_list_id: str, plans: int | None = None, limit: int | None = None
) -> DataFrame:
    """Specialty drugs of a drug list with their price range over its plans.

    If a number of plans is given: over those of the first plan x county rows by
    organization and plan name.
    """
    priced_in = t["plan_information"].where(F.col("drug_list_id") == drug_list_id)
    if plans is not None:
        priced_in = priced_in.orderBy(
            "contract_name", "plan_name", "plan_key", "county_code"
        ).limit(plans)
    drugs = specialty_drug_groups(t, drug_list_id).select("rxcui", "ndc", "tier", "restrictions")
    # The few drugs cut the prices first, then the plans.
    prices = keep_matching(_prices(t, None), "ndc", drugs).join(
        priced_in.select("plan_key").distinct(), "plan_key", "left_semi"
    )
    priced = drugs.join(prices, "ndc").groupBy("rxcui", "ndc", "tier", "restrictions").agg(
        mean("unit_cost").alias("avg_unit_cost"),
        F.min("unit_cost").alias("min_unit_cost"),
        F.max("unit_cost").alias("max_unit_cost"),
        F.countDistinct("plan_key").alias("plan_count"),
    ).orderBy(F.desc("avg_unit_cost"), "ndc", "rxcui", "tier")
    return priced if limit is None else priced.limit(limit)


def format_money(df: DataFrame, columns: Iterable[str], positive_only: bool = False) -> DataFrame:
    """Money columns as `$0.00` text, `N/A` when missing (or not above 0)."""
    return df.withColumns({c: price_text(F.col(c), positive_only) for c in columns})
