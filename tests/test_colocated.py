"""Tables stored by plan: no exchange of prices, same rows, hot buckets read by files."""

import pytest
from conftest import as_dicts

from tierscope import schemas as S
from tierscope.operators import costs, landscape
from tierscope.sources import colocated
from tierscope.sources.star import derive_tables
from tierscope.sources.text import conform

BUCKETS = 8


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    t = derive_tables(spark, "/root/testdata/sf0.001")
    t = {name: conform(t[name], S.SCHEMAS[name]) for name in t}
    path = str(tmp_path_factory.mktemp("lists") / "drug_list_drugs")
    t["drug_list_drugs"].write.parquet(path)
    return {**t, "drug_list_drugs": spark.read.parquet(path)}


@pytest.fixture(scope="module")
def root(spark, plain, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("by-plan"))
    colocated.write_colocated(plain, path, 2025, BUCKETS)
    return path


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def above(df, scan, stop):
    """Operators on the way up from a scan to the first one that has `stop`."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    lines = [line for line in text.splitlines() if line.strip()]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and scan in line)
    found, level = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < level:
            level = depth[i]
            found.append(lines[i].lstrip(" :+-"))
            if stop in lines[i]:
                return found
    raise AssertionError(f"no {stop} above {scan}")


@pytest.mark.parametrize("build", [costs.specialty_margin, costs.contract_specialty_cost])
def test_prices_meet_plans_without_an_exchange(spark, plain, root, no_broadcast, build):
    t = colocated.load_colocated(spark, plain, root, 2025, BUCKETS)
    way = above(build(t), "unit_cost#", "SortMergeJoin [plan_key")
    assert not [step for step in way if step.startswith("Exchange")]
    stored = {**t, "drug_pricing": spark.read.parquet(
        colocated._path(root, "drug_pricing", 2025, BUCKETS)
    )}
    way = above(build(stored), "unit_cost#", "SortMergeJoin [plan_key")
    assert [step for step in way if step.startswith("Exchange")]


def test_prices_are_never_exchanged_where_drug_lists_are_small(spark, plain, root):
    """Drug lists are broadcast by their size; only aggregated prices are exchanged."""
    t = colocated.load_colocated(spark, plain, root, 2025, BUCKETS)
    way = above(costs.specialty_margin(t), "unit_cost#", "HashAggregate")
    assert not [step for step in way if step.startswith("Exchange")]


@pytest.mark.parametrize("build", [
    costs.specialty_margin, costs.contract_specialty_cost,
    lambda t: landscape.pricing_table(t, {"x": [1, 2, 3]}), lambda t: t["beneficiary_costs"],
    lambda t: t["plan_information"], lambda t: t["drug_pricing"],
])
def test_same_rows(spark, plain, root, no_broadcast, build):
    t = colocated.load_colocated(spark, plain, root, 2025, BUCKETS)
    got, want = build(t), build(plain)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, as_dicts(got))) == sorted(map(repr, as_dicts(want)))


def test_another_session_loads_what_was_written(spark, plain, root):
    other = spark.newSession()
    spark.sql(f"DROP TABLE IF EXISTS {colocated._catalog_name(colocated._path(root, 'drug_pricing', 2025, BUCKETS))}")
    t = colocated.load_colocated(other, plain, root, 2025, BUCKETS)
    assert t["drug_pricing"].count() == plain["drug_pricing"].count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        colocated.load_colocated(spark, plain, root, 2025, 2 * BUCKETS)


def test_a_hot_bucket_is_read_by_files(spark, tables, tmp_path, monkeypatch):
    t = tables(drug_pricing=[
        {"plan_key": "P0" if i % 3 else f"P{i}", "ndc": f"{i:05d}", "days_supply": 30, "unit_cost": i}
        for i in range(3000)
    ], plan_information=[{"plan_key": None}])
    colocated.write_colocated(t, str(tmp_path), 2025, BUCKETS)
    path = colocated._path(str(tmp_path), "drug_pricing", 2025, BUCKETS)
    sizes = {r["bucket"]: r["bytes"] for r in colocated.bucket_sizes(spark, path).collect()}
    assert len(sizes) == BUCKETS and max(sizes.values()) > 3 * min(sizes.values())
    for hot, bucketed in ((1 << 30, True), (1000, False)):
        monkeypatch.setattr(colocated, "HOT_BYTES", hot)
        monkeypatch.setattr(colocated, "HOT_TIMES", 1.5)
        u = colocated.load_colocated(spark, t, str(tmp_path), 2025, BUCKETS)
        plan = u["drug_pricing"]._jdf.queryExecution().executedPlan().toString()
        assert ("tierscope_" in plan) is bucketed
        assert u["drug_pricing"].count() == 3000 and u["plan_information"].count() == 1
