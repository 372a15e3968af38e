"""Summaries refreshed part by part against a full rebuild."""

import re

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from tierscope.operators import incremental, summaries
from tierscope.sources import sinks
from tierscope.sources.manifest import Manifest
from tierscope.sources.star import derive_tables
from test_sources import write

PLACES = [{"county_code": f"C{i}", "state_name": "S", "county_name": f"N{i}"} for i in range(3)]


def same(got, want):
    for name, df in want.items():
        assert got[name].dtypes == df.dtypes
        assert sorted(map(repr, as_dicts(got[name]))) == sorted(map(repr, as_dicts(df)))


def rebuilt(t):
    return {name: build(t) for name, build in summaries.SUMMARIES.items()}


@pytest.fixture
def parts(tables):
    def plan(i, **more):
        return {"plan_key": f"P{i}", "drug_list_id": f"F{i % 2}", "county_code": f"C{i % 4}",
                "premium": i, **more}

    def drug(i, **more):
        return {"drug_list_id": f"F{i % 2}", "ndc": f"{i:03d}", "tier_level_value": i % 6, **more}

    return {
        "2024": tables(geographic_locator=PLACES, plan_information=[
            *[plan(i) for i in range(200)], plan(3), plan(5, plan_key=None, drug_list_id="F9"),
            plan(7, premium=None), plan(1, drug_list_id=None), plan(2, county_code=None),
        ], drug_list_drugs=[*[drug(i) for i in range(300)], drug(1), drug(2, ndc=None)]),
        "2025": tables(geographic_locator=PLACES, plan_information=[
            plan(i, premium=3 * i, drug_list_id="F1") for i in range(150, 260)
        ], drug_list_drugs=[drug(i, tier_level_value=5) for i in range(100, 400)]),
        "empty": tables(geographic_locator=PLACES),
    }


def together(parts, *names):
    first = parts[names[0]]
    out = dict(first)
    for name in names[1:]:
        for table in ("plan_information", "drug_list_drugs"):
            out[table] = out[table].union(parts[name][table])
    return out


def test_refresh_after_an_append_equals_a_rebuild(spark, tmp_path, parts):
    places = parts["2024"]["geographic_locator"]
    got = incremental.refresh_parts(spark, {"2024": parts["2024"]}, places, str(tmp_path))
    same(got, rebuilt(parts["2024"]))
    got = incremental.refresh_parts(spark, {"2025": parts["2025"]}, places, str(tmp_path))
    same(got, rebuilt(together(parts, "2024", "2025")))
    got = incremental.refresh_parts(spark, {"empty": parts["empty"]}, places, str(tmp_path))
    same(got, rebuilt(together(parts, "2024", "2025")))
    assert incremental.State(spark, str(tmp_path)).parts() == {"2024", "2025", "empty"}
    # a part given again takes the place of what it was
    got = incremental.refresh_parts(spark, {"2024": parts["empty"]}, places, str(tmp_path))
    same(got, rebuilt(parts["2025"]))
    got = incremental.refresh_parts(spark, {}, places, str(tmp_path))
    same(got, rebuilt(parts["2025"]))


def test_codes_are_given_once(spark, tmp_path, parts):
    places = parts["2024"]["geographic_locator"]
    for name in ("2024", "2025", "2024"):
        incremental.refresh_parts(spark, {name: parts[name]}, places, str(tmp_path))
    codes = incremental.State(spark, str(tmp_path)).read("codes_drugs", incremental.CODE_SCHEMA)
    rows = [tuple(r) for r in codes.collect()]
    assert len({r[0] for r in rows}) == len(rows) == 400
    assert len({r[1:] for r in rows}) == 400
    for bucket in {r[1] for r in rows}:
        assert sorted(r[2] for r in rows if r[1] == bucket) == list(
            range(sum(r[1] == bucket for r in rows))
        )


def test_words_of_more_than_64_items(spark, tmp_path, parts, monkeypatch):
    monkeypatch.setattr(incremental, "BUCKETS", 2)
    got = incremental.refresh_parts(
        spark, {n: parts[n] for n in ("2024", "2025")}, parts["2024"]["geographic_locator"], str(tmp_path)
    )
    same(got, rebuilt(together(parts, "2024", "2025")))
    words = incremental.State(spark, str(tmp_path)).read("drugs", incremental.STATES["drugs"])
    assert words.agg(F.max("word")).first()[0] >= 2


def test_a_refresh_that_is_overtaken_changes_nothing(spark, tmp_path, parts, monkeypatch):
    places = parts["2024"]["geographic_locator"]
    commit = Manifest.commit

    def overtaken(self, change):
        monkeypatch.undo()
        incremental.refresh_parts(spark, {"2025": parts["2025"]}, places, str(tmp_path))
        return commit(self, change)

    monkeypatch.setattr(Manifest, "commit", overtaken)
    with pytest.raises(RuntimeError, match="another refresh"):
        incremental.refresh_parts(spark, {"2024": parts["2024"]}, places, str(tmp_path))
    got = incremental.refresh_parts(spark, {}, places, str(tmp_path))
    same(got, rebuilt(parts["2025"]))


def deliver(tmp_path, spark, year, plans):
    files = {
        "plan_information": ("CONTRACT_ID|PLAN_ID|SEGMENT_ID|DRUG_LIST_ID|PREMIUM|COUNTY_CODE", *plans),
        "geographic_locator": ("COUNTY_CODE|STATENAME|COUNTY", "29189|Missouri|St. Louis"),
        "drug_list_drugs": ("DRUG_LIST_ID|RXCUI|NDC|TIER_LEVEL_VALUE", f"F{year}|5|01|5", "F|6|02|1"),
        "beneficiary_costs": ("CONTRACT_ID|PLAN_ID|SEGMENT_ID|TIER", "H1|1|0|5"),
    }
    sources = {n: write(tmp_path / f"in{year}" / f"{n}.txt", *lines) for n, lines in files.items()}
    sinks.ingest(spark, sources, str(tmp_path / "tables"), year)


def test_only_new_years_are_read(spark, tmp_path, monkeypatch):
    root, directory = str(tmp_path / "tables"), str(tmp_path / "summaries")
    deliver(tmp_path, spark, 2024, ["H1|1|0|F|1.5|29189", "H1|2|0|F2024|2.5|29189"])
    scans = []
    add = incremental._add_part

    def watched(state, part, t):
        for table in ("plan_information", "drug_list_drugs"):
            plan = t[table]._jdf.queryExecution().executedPlan().toString()
            scans.append(re.search(r"PartitionFilters: \[(.*?)\]", plan).group(1))
        add(state, part, t)

    monkeypatch.setattr(incremental, "_add_part", watched)
    incremental.refresh_years(spark, root, directory)
    assert scans and all("= 2024" in f for f in scans)
    scans.clear()
    deliver(tmp_path, spark, 2025, ["H1|1|0|F|4.5|29189", "H1|3|0|F2025|2.5|29189"])
    got = incremental.refresh_years(spark, root, directory)
    assert scans and all("= 2025" in f for f in scans)
    (county,) = as_dicts(got["county_plan_summary"])
    assert county["plan_count"] == 3 and county["avg_premium"] == pytest.approx(2.75)
    lists = {r["drug_list_id"]: r for r in as_dicts(got["drug_list_summary"])}
    assert (lists["F"]["plans_using"], lists["F"]["total_drugs"]) == (1, 1)
    assert lists["F2025"]["specialty_drugs"] == 1
    scans.clear()
    same(incremental.refresh_years(spark, root, directory), got)
    assert not scans
    incremental.refresh_years(spark, root, directory, again=[2024])
    assert scans and all("= 2024" in f for f in scans)


def test_test_tables(spark, tmp_path):
    t = derive_tables(spark, "/root/testdata/sf0.001")
    parts = {
        str(i): {name: t[name].where(F.pmod(F.xxhash64(key), F.lit(2)) == i) for name, key in (
            ("plan_information", "county_code"), ("drug_list_drugs", "ndc"))} for i in range(2)
    }
    for name, part in parts.items():
        got = incremental.refresh_parts(spark, {name: part}, t["geographic_locator"], str(tmp_path))
    same(got, rebuilt(t))
