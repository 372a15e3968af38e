"""Reading, cleaning, writing and appending deliveries."""

import json
import zipfile
from decimal import Decimal

import pytest
from conftest import as_dicts

from tierscope import schemas as S
from tierscope.sources import sinks, tables, text
from tierscope.streaming.append import append_pricing

PLAN_HEADER = (
    "CONTRACT_ID|PLAN_ID|SEGMENT_ID|CONTRACT_NAME|PLAN_NAME|DRUG_LIST_ID|PREMIUM|DEDUCTIBLE|SNP|"
    "PLAN_SUPPRESSED_YN|STATE|COUNTY_CODE|MA_REGION_CODE|PDP_REGION_CODE"
)
PLAN_ROWS = [
    "H0001|001|000|Org A|Plan A|00000001|12.50|100|0|N|MO|29189|01|11",
    "H0001|002||Org A|Plan B|NA|abc|N/A|2.5|N|MO|29189|01|11",
    "S0002|003|000|Org B|Plan C|00000002|1e1|0|1.0|N|IL|17001|02|12",
]
PRICE_HEADER = "CONTRACT_ID|PLAN_ID|SEGMENT_ID|NDC|DAYS_SUPPLY|UNIT_COST"


def write(path, *lines, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding=encoding)
    return str(path)


def test_plan_file_becomes_a_typed_table(spark, tmp_path):
    path = write(tmp_path / "plans.txt", PLAN_HEADER, *PLAN_ROWS)
    df = text.prepare(text.read_pipe(spark, path), "plan_information")
    assert df.schema == S.PLAN_INFORMATION
    a, b, c = sorted(as_dicts(df), key=lambda r: r["plan_id"])
    assert a["plan_key"] == "H0001|001|000" and a["premium"] == Decimal("12.50")
    assert b["plan_key"] is None  # a key part is missing
    assert b["premium"] is None and b["deductible"] is None and b["drug_list_id"] is None
    assert b["snp"] is None  # 2.5 is no integer
    assert c["premium"] == Decimal("10.00") and c["snp"] == 1


def test_columns_given_up_front_are_read_by_position(spark, tmp_path):
    path = write(tmp_path / "p.txt", PRICE_HEADER, "H1|1|0|00000000001|30|2.5")
    df = text.read_pipe(spark, path, S.POSITIONAL["drug_pricing"])
    assert as_dicts(df)[0]["unit_cost"] == "2.5"


def test_latin1_text(spark, tmp_path):
    path = write(tmp_path / "l.txt", "NAME", "Clínica", encoding="latin-1")
    assert text.read_pipe(spark, path, encoding=text.LATIN1).first()[0] == "Clínica"


def test_zip_members(spark, tmp_path):
    for name, header, row in (
        ("one.zip", "NDC|Unit Cost|OTHER", "1|2.5|x"), ("two.zip", "UNIT COST|NDC", "NA|2"),
    ):
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            archive.writestr("member.txt", f"{header}\n{row}\n".encode("latin-1"))
    df = text.read_pipe_zip(spark, str(tmp_path), ["ndc", "unit_cost", "absent"], text.LATIN1)
    rows = sorted(tuple(r) for r in text.null_tokens(df).collect())
    assert rows == [("1", "2.5", None), ("2", None, None)]


def test_large_zip_member_is_read_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "ZIP_BLOCK_BYTES", 1 << 16)
    lines = [f"{i}|é{i}" for i in range(50_000)]
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("m.txt", "\n".join(["A|B", *lines]).encode("latin-1"))
    df = text.read_pipe_zip(spark, str(tmp_path), ["a", "b"], text.LATIN1, partitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in df.collect()} == {tuple(line.split("|")) for line in lines}


def test_zip_columns_are_found_when_not_given(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.mkdir("folder")
        archive.writestr("folder/m.txt", "Contract ID|NDC\nH1|01\n")
    df = text.read_pipe_zip(spark, str(tmp_path / "a.zip"))
    assert as_dicts(df) == [{"contract_id": "H1", "ndc": "01"}]


def test_headers_with_other_names_are_taken_by_position(spark, tmp_path):
    header = "COUNTY_CODE|STATENAME|COUNTY|MA_REGION_CODE|MA_REGION|PDP_REGION_CODE|PDP_REGION"
    path = write(tmp_path / "g.txt", header, "29189|Missouri|St. Louis|01|MA x|11|PDP x")
    (row,) = as_dicts(text.prepare(text.read_pipe(spark, path), "geographic_locator"))
    assert (row["state_name"], row["county_name"], row["pdp_region_name"]) == (
        "Missouri", "St. Louis", "PDP x",
    )


def test_ingest_reads_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "in" / "prices.zip")
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("p.txt", f"{PRICE_HEADER}\nH1|1|0|01|30|2.5\n")
    written = sinks.ingest(spark, {"drug_pricing": path}, str(tmp_path / "out"), 2025)
    (row,) = as_dicts(written["drug_pricing"])
    assert row["plan_key"] == "H1|1|0" and row["unit_cost"] == Decimal("2.5")


def test_rename_positional_checks_the_count(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert text.rename_positional(df, ["p", "q"]).columns == ["p", "q"]
    with pytest.raises(ValueError):
        text.rename_positional(df, ["p"])


def test_plan_key_needs_all_parts(spark):
    df = spark.createDataFrame([("a", "b")], "contract_id string, plan_id string")
    assert "plan_key" not in text.with_plan_key(df).columns


def test_drug_name_dictionary(spark, tmp_path):
    names = {"1": "a 5 MG", "22": "b", "x": "no number"}
    (tmp_path / "names.json").write_text(json.dumps(names, indent=1))
    rows = {(r["rxcui"], r["description"]) for r in text.read_drug_names(spark, str(tmp_path)).collect()}
    assert rows == {(1, "a 5 MG"), (22, "b"), (None, "no number")}


def test_append_adds_each_file_once_to_what_was_ingested(spark, tmp_path):
    source, root, state = (str(tmp_path / x) for x in ("in", "tables", "state"))
    first = write(tmp_path / "first.txt", PRICE_HEADER, "H1|1|0|01|30|2.5", "H1|1|0|02|30|1234567.5")
    sinks.ingest(spark, {"drug_pricing": first}, root, 2025)
    args = (spark, source, root, 2025, state)
    write(tmp_path / "in" / "a.txt", PRICE_HEADER, "H1|1|0|03|30|2.5", "H1|1|0|01|60|bad")
    assert append_pricing(*args).count() == 4
    assert append_pricing(*args).count() == 4
    write(tmp_path / "in" / "b.txt", PRICE_HEADER, "H1|1||02|90|7")
    rows = sorted(
        (r["ndc"], r["days_supply"], r["unit_cost"], r["plan_key"])
        for r in append_pricing(*args).collect()
    )
    assert rows == [
        ("01", 30, Decimal("2.5000"), "H1|1|0"),
        ("01", 60, None, "H1|1|0"),
        ("02", 30, Decimal("1234567.5000"), "H1|1|0"),
        ("02", 90, Decimal("7.0000"), None),
        ("03", 30, Decimal("2.5000"), "H1|1|0"),
    ]
    table = tables.load_table(spark, root, "drug_pricing")
    assert table.count() == 5 and "batch" not in table.columns
    wanted = table.where("year = 2025 AND days_supply = 60")
    shown = wanted._jdf.queryExecution().toString()
    assert "days_supply#" in shown.split("PartitionFilters: [")[1].split("]")[0]
    sinks.ingest(spark, {"drug_pricing": first}, root, 2025)  # the year anew
    assert tables.load_table(spark, root, "drug_pricing").count() == 2


def test_a_batch_may_be_written_again(spark, tmp_path, make):
    path = str(tmp_path / "year=2025")
    rows = make("drug_pricing", {"plan_key": "P", "ndc": "1", "days_supply": 30, "unit_cost": 1})
    sinks.write_pricing(rows, path)
    for _ in range(2):
        assert sinks.write_pricing(rows, path, "b-0").count() == 2


def test_exchanged_columns_are_refused(spark, tmp_path):
    write(tmp_path / "in" / "a.txt", "A|B", "1|2")
    write(tmp_path / "in" / "b.txt", "B|A", "3|4")
    for columns in (None, ["a", "b"]):
        with pytest.raises(Exception, match="header"):
            text.read_pipe(spark, str(tmp_path / "in"), columns).collect()


def test_folders_of_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        with zipfile.ZipFile(tmp_path / "in" / f"{i}.ZIP", "w") as archive:
            archive.writestr("p.txt", f"{PRICE_HEADER}\nH1|1|0|0{i}|30|2.5\n")
    written = sinks.ingest(spark, {"drug_pricing": str(tmp_path / "in")}, str(tmp_path / "out"), 2025)
    assert sorted(r["ndc"] for r in written["drug_pricing"].collect()) == ["00", "01"]
    write(tmp_path / "in" / "c.txt", PRICE_HEADER)
    with pytest.raises(ValueError, match="other files"):
        sinks.ingest(spark, {"drug_pricing": str(tmp_path / "in")}, str(tmp_path / "out"), 2025)


def test_ingest_two_years_and_load_one(spark, tmp_path):
    def deliver(year, plans):
        files = {
            "plan_information": (PLAN_HEADER, *plans),
            "geographic_locator": ("COUNTY_CODE|STATENAME|COUNTY", "29189|Missouri|St. Louis"),
            "drug_list_drugs": ("DRUG_LIST_ID|RXCUI|NDC|TIER_LEVEL_VALUE", "00000001|5|01|5"),
            "beneficiary_costs": ("CONTRACT_ID|PLAN_ID|SEGMENT_ID|TIER", "H0001|001|000|5"),
            "excluded_drugs": ("RXCUI|TIER", "7|1", "8|2"),
        }
        sources = {
            name: write(tmp_path / f"in{year}" / f"{name}.txt", *lines)
            for name, lines in files.items()
        }
        sinks.ingest(spark, sources, str(tmp_path / "tables"), year)

    deliver(2025, PLAN_ROWS)
    deliver(2026, PLAN_ROWS[:1])
    t = tables.load_tables(spark, str(tmp_path / "tables"), 2026, register=True)
    assert t["plan_information"].count() == 1
    assert t["drug_pricing"].count() == 0  # optional, not delivered
    assert t["excluded_drugs"].columns == ["rxcui", "tier"]
    assert "insulin_costs" not in t
    assert spark.sql("SELECT count(*) FROM plans").first()[0] == 1
    both = tables.load_tables(spark, str(tmp_path / "tables"))
    plan = both["plan_information"].where("year = 2025")
    assert plan.count() == 3
    shown = plan._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in shown


def test_missing_required_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_tables(spark, str(tmp_path))


def test_records_keep_nulls_and_fill_the_named(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, nan, None, nan)], "a int, b double, c string, d double")
    record = sinks.to_records(df, {"a": 0, "b": 0}).first()[0]
    assert json.loads(record) == {"a": 0, "b": 0.0, "c": None, "d": None}


def test_pricing_layout_prunes_days_and_drugs(spark, tmp_path, make):
    rows = [
        {"plan_key": f"P{i % 50}", "ndc": f"{i:05d}", "days_supply": 30 * (i % 3 + 1), "unit_cost": i}
        for i in range(600)
    ]
    path = str(tmp_path / "prices")
    df = sinks.write_pricing(make("drug_pricing", *rows), path)
    assert df.count() == 600
    wanted = df.where("days_supply = 30 AND ndc = '00003'")
    shown = wanted._jdf.queryExecution().toString()
    assert "EqualTo(ndc,00003)" in shown and "PartitionFilters: [isnotnull(days_supply" in shown
    assert wanted.count() == 1
