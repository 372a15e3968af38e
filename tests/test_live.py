"""The log of live directories, compaction, counts and rejected values of an ingest."""

import threading

import pytest
from conftest import as_dicts
from pyspark.sql import functions as F
from test_sources import PLAN_HEADER, PRICE_HEADER, write

from tierscope import schemas as S
from tierscope.sources import sinks, tables
from tierscope.sources.manifest import Manifest
from tierscope.streaming.append import append_pricing


def prices(n, ndc="01", days=30):
    return [f"H1|{i}|0|{ndc}|{days}|{i}.5" for i in range(n)]


def files(path):
    return sorted(p for p in path.rglob("part-*") if "_staged" not in str(p))


def test_log_versions(spark, tmp_path):
    log = Manifest(spark, str(tmp_path))
    assert log.read() == (0, set()) and log.versions() == {}
    assert log.commit(lambda live: {"a", "b"}) == {"a", "b"}
    assert log.commit(lambda live: live - {"a"} | {"c"}) == {"b", "c"}
    assert log.commit(lambda live: live) == {"b", "c"}
    assert log.read() == (2, {"b", "c"}) and log.read(1) == (1, {"a", "b"})
    assert not log._put(2, {"x"}) and log.read() == (2, {"b", "c"})
    assert not [p for p in (tmp_path / "_live").iterdir() if not p.name.endswith((".json", ".crc"))]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    def add(name):
        for i in range(4):
            Manifest(spark, str(tmp_path)).commit(lambda live: live | {f"{name}{i}"})

    threads = [threading.Thread(target=add, args=(name,)) for name in "ab"]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert Manifest(spark, str(tmp_path)).read() == (8, {f"{n}{i}" for n in "ab" for i in range(4)})


def test_a_reader_sees_all_of_a_batch_or_nothing(spark, tmp_path, make, monkeypatch):
    root, before = str(tmp_path), make("drug_pricing", {"plan_key": "P", "ndc": "1", "days_supply": 30})
    sinks.replace_prices(spark, before, root, 2025)
    reader = tables.load_table(spark, root, "drug_pricing")
    batch = make("drug_pricing", *[
        {"plan_key": f"P{i}", "ndc": "2", "days_supply": 30 * (i % 3 + 1)} for i in range(90)
    ])
    seen, commit = [], Manifest.commit

    def watched(self, change):  # all files are written, nothing is committed
        seen.append(tables.load_table(spark, root, "drug_pricing").count())
        return commit(self, change)

    monkeypatch.setattr(Manifest, "commit", watched)
    sinks.add_prices(spark, batch, root, 2025, "x-1")
    assert seen == [1] and tables.load_table(spark, root, "drug_pricing").count() == 91
    sinks.add_prices(spark, batch, root, 2025, "x-1")  # live already
    assert len(seen) == 1 and reader.count() == 1  # goes on with what it has taken
    sinks.replace_prices(spark, batch, root, 2025)
    assert seen == [1, 91] and tables.load_table(spark, root, "drug_pricing").count() == 90
    assert reader.count() == 1


def test_what_a_broken_run_left_is_never_read(spark, tmp_path, make, monkeypatch):
    root, rows = str(tmp_path), make("drug_pricing", {"plan_key": "P", "ndc": "1", "days_supply": 30})
    sinks.replace_prices(spark, rows, root, 2025)

    def fail(self, change):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", fail)
        with pytest.raises(OSError):
            sinks.add_prices(spark, rows.union(rows), root, 2025, "x-1")
    assert tables.load_table(spark, root, "drug_pricing").count() == 1
    sinks.add_prices(spark, rows.union(rows), root, 2025, "x-1")  # written anew
    assert tables.load_table(spark, root, "drug_pricing").count() == 3


def test_files_stay_bounded_over_many_batches(spark, tmp_path):
    root, source = str(tmp_path / "tables"), tmp_path / "in"
    first = write(tmp_path / "first.txt", PRICE_HEADER, *prices(5))
    sinks.ingest(spark, {"drug_pricing": first}, root, 2025)
    counts = []
    for i in range(6):
        write(source / f"{i}.txt", PRICE_HEADER, *prices(3, f"1{i}", 60))
        df = append_pricing(spark, str(source), root, 2025, str(tmp_path / "state"), most_batches=3)
        assert df.count() == 5 + 3 * (i + 1)
        counts.append(len(sinks.live_batches(spark, root, 2025)))
    assert counts == [2, 3, 1, 2, 3, 1]
    live = Manifest(spark, f"{root}/drug_pricing").read()[1]
    on_disk = {str(p.parent.relative_to(tmp_path / "tables" / "drug_pricing")) for p in files(
        tmp_path / "tables" / "drug_pricing"
    )}
    assert live < on_disk
    gone = Manifest(spark, f"{root}/drug_pricing").vacuum(kept_seconds=-60)
    assert set(gone) == on_disk - live
    assert tables.load_table(spark, root, "drug_pricing").count() == 23
    assert Manifest(spark, f"{root}/drug_pricing").vacuum() == []


def test_compaction_leaves_large_batches_and_other_years(spark, tmp_path, make):
    root = str(tmp_path)
    many = make("drug_pricing", *[
        {"plan_key": f"P{i}", "ndc": f"{i}", "days_supply": 30} for i in range(2000)
    ])
    few = make("drug_pricing", {"plan_key": "P", "ndc": "1", "days_supply": 30})
    sinks.replace_prices(spark, few, root, 2024)
    sinks.replace_prices(spark, many, root, 2025)
    for i in range(3):
        sinks.add_prices(spark, few, root, 2025, f"x-{i}")
    assert sinks.compact_prices(spark, root, 2025, large=8000) == 3
    names = sinks.live_batches(spark, root, 2025)
    assert {n.split("-")[0] for n in names} == {"delivered", "compact"} and len(names) == 2
    assert sinks.compact_prices(spark, root, 2025, large=8000) == 0
    by_year = tables.load_table(spark, root, "drug_pricing").groupBy("year").count().collect()
    assert {r["year"]: r["count"] for r in by_year} == {2024: 1, 2025: 2003}


def test_prices_from_before_the_log_are_taken_over(spark, tmp_path, make):
    rows = make("drug_pricing", {"plan_key": "P", "ndc": "1", "days_supply": 30})
    for year in (2024, 2025):
        sinks.write_pricing(rows, f"{tmp_path}/drug_pricing/year={year}")
    assert tables.load_table(spark, str(tmp_path), "drug_pricing").count() == 2
    sinks.add_prices(spark, rows, str(tmp_path), 2025, "x-1")
    assert tables.load_table(spark, str(tmp_path), "drug_pricing").count() == 3


def test_counts_come_with_the_write(spark, tmp_path):
    plans = write(tmp_path / "p.txt", "CONTRACT_ID|PLAN_ID|SEGMENT_ID|PREMIUM|SNP", "H1|1|0|2.5|x", "H1|2|0|y|z")
    price = write(tmp_path / "d.txt", PRICE_HEADER, *prices(7), "H1|1|0|02|30|dear")
    tracker = spark.sparkContext.statusTracker()
    got = sinks.ingest(spark, {"plan_information": plans, "drug_pricing": price}, str(tmp_path / "t"), 2025)
    assert got.counts == {"plan_information": (2, 3), "drug_pricing": (8, 1)}
    before = set(tracker.getJobIdsForGroup(None))
    report = as_dicts(got.report(spark))
    assert {r["table_name"]: r["rows"] for r in report} == {"plan_information": 2, "drug_pricing": 8}
    assert len(set(tracker.getJobIdsForGroup(None)) - before) <= 1  # collect itself
    assert got["drug_pricing"].count() == 8 and "rejected_" not in got["plan_information"].columns


def test_rejected_values_name_file_row_and_reason(spark, tmp_path):
    header = "CONTRACT_ID|PLAN_ID|SEGMENT_ID|PREMIUM|DEDUCTIBLE|SNP"
    lines = ["H1|1|0|2.5|N/A|1.0", "H1|2||abc|1e3|2.5", "H1|3|0|123456789|x|99999999999"]
    path = write(tmp_path / "in" / "p.txt", header, *lines)
    sinks.ingest(spark, {"plan_information": path}, str(tmp_path / "t"), 2025)
    rows = as_dicts(sinks.rejected_values(spark, str(tmp_path / "t")))
    assert {r["file"].rsplit("/", 1)[1] for r in rows} == {"p.txt"}
    assert {(r["row"], r["column"], r["text"], r["reason"]) for r in rows} == {
        (lines[1], "premium", "abc", "not a number"), (lines[1], "snp", "2.5", "not a whole number"),
        (lines[2], "premium", "123456789", "out of range"), (lines[2], "deductible", "x", "not a number"),
        (lines[2], "snp", "99999999999", "out of range"),
    }
    plans = tables.load_table(spark, str(tmp_path / "t"), "plan_information")
    assert plans.columns == [*S.SCHEMAS["plan_information"].names, "year"] and plans.count() == 3
    # the year again replaces its rejected values
    sinks.ingest(spark, {"plan_information": write(tmp_path / "q.txt", header, lines[0])}, str(tmp_path / "t"), 2025)
    assert sinks.rejected_values(spark, str(tmp_path / "t")).count() == 0
    assert sinks.rejected_values(spark, str(tmp_path / "none")).count() == 0


def test_rejected_values_of_archives_name_the_member(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("d/p.txt", f"{PRICE_HEADER}\nH1|1|0|01|30|x\nH1|1|0|02|30|1\n")
        archive.writestr("d/q.txt", f"{PRICE_HEADER}\nH1|1|0|03|y|2\n")
    got = sinks.ingest(spark, {"drug_pricing": str(tmp_path / "a.zip")}, str(tmp_path / "t"), 2025)
    assert got.counts == {"drug_pricing": (3, 2)} and got["drug_pricing"].count() == 3
    rows = as_dicts(sinks.rejected_values(spark, str(tmp_path / "t")))
    assert {(r["file"].rsplit("/", 1)[1], r["column"], r["text"]) for r in rows} == {
        ("p.txt", "unit_cost", "x"), ("q.txt", "days_supply", "y"),
    }
    assert "a.zip!d/p.txt" in {r["file"] for r in rows if r["text"] == "x"}.pop()


def test_prices_are_parsed_once(spark, tmp_path):
    """Only the staging job reads text; the layout, which samples, reads Parquet."""
    path = write(tmp_path / "in" / "p.txt", PRICE_HEADER, *prices(100))
    seen, original = [], sinks.write_pricing

    def watched(df, *args, **kwargs):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df, *args, **kwargs)

    sinks.write_pricing = watched
    try:
        sinks.ingest(spark, {"drug_pricing": path}, str(tmp_path / "t"), 2025)
    finally:
        sinks.write_pricing = original
    assert len(seen) == 1 and "FileScan parquet" in seen[0] and "csv" not in seen[0]
    assert not list((tmp_path / "t" / "drug_pricing").rglob("*_staged*"))
