"""What changed between two states, and references checked by key."""

import random

import pytest
from pyspark.sql import functions as F

from tierscope.operators import changes, normalize

SCHEMA = "k string, l int, a string, b int"


def brute(before, after):
    keys = {r[:2] for r in before + after}
    out = []
    for key in keys:
        left = sorted((r[2:] for r in before if r[:2] == key), key=repr)
        right = sorted((r[2:] for r in after if r[:2] == key), key=repr)
        gone, come = list(left), list(right)
        for row in left:
            if row in come:
                come.remove(row)
                gone.remove(row)
        if gone or come:
            kind = "changed" if left and right else "added" if right else "removed"
            columns = None
            if len(gone) == len(come) == 1:
                columns = ",".join(c for c, x, y in zip("ab", gone[0], come[0]) if x != y)
            out.append((*key, kind, len(gone), len(come), columns))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_changes_equal_brute_force(spark, seed):
    rng = random.Random(seed)

    def rows(n):
        return [(rng.choice(["x", "y", None]), rng.randint(1, 12 if seed else 3), rng.choice(["p", "q", None]),
                 rng.choice([1, 2, None])) for _ in range(n)]

    before, after = rows(60 * (seed > 0) + 10), rows(50)
    after += before[: len(before) // 2]
    got = changes.changes(*(spark.createDataFrame(r, SCHEMA) for r in (before, after)), ["k", "l"])
    assert got.columns == ["k", "l", "change", "rows_before", "rows_after", "changed_columns"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(before, after)
    some = changes.changes(*(spark.createDataFrame(r, SCHEMA) for r in (before, before)), ["k"], ["a"])
    assert some.count() == 0


def test_empty_sides(spark):
    rows, none = spark.createDataFrame([("x", 1, "p", 2)], SCHEMA), spark.createDataFrame([], SCHEMA)
    assert [r["change"] for r in changes.changes(none, rows, ["k"]).collect()] == ["added"]
    assert [r["change"] for r in changes.changes(rows, none, ["k"]).collect()] == ["removed"]
    assert changes.changes(none, none, ["k"]).count() == 0


def test_orphans_equal_an_anti_join(spark):
    child = spark.range(20_000).select(
        F.when(F.col("id") % 50 != 0, (F.col("id") % 700).cast("string")).alias("key"),
        (F.col("id") % 3).cast("int").alias("part"), "id",
    )
    parent = spark.range(690).where("id % 97 <> 5").select(F.col("id").cast("string").alias("p"))
    got = normalize.orphans(child, parent, {"key": "p"})
    want = child.where("key IS NOT NULL").join(parent, F.col("key") == F.col("p"), "left_anti")
    assert got.columns == child.columns and got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    numbers = spark.range(3).select(F.col("id").alias("p"), F.lit(0).alias("q"))  # another type
    two = normalize.orphans(child, numbers, {"key": "p", "part": "q"})
    assert two.count() == child.where("key IS NOT NULL AND NOT (key IN ('0', '1', '2') AND part = 0)").count()
    assert normalize.orphans(child, parent.limit(0), {"key": "p"}).count() == want.count() + (
        child.where("key IS NOT NULL").count() - want.count()
    )


def test_what_is_shuffled_follows_the_orphans(spark, tmp_path):
    """Rows of a large child are not shuffled unless they may be orphans."""
    path = str(tmp_path / "child")
    spark.range(400_000, numPartitions=4).select(
        F.concat(F.lit("P"), (F.col("id") % 500).cast("string")).alias("key"), "id"
    ).write.parquet(path)
    child = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for lost in (0, 5):
            parent = spark.range(500 - lost).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("p"))
            df = normalize.orphans(child, parent, {"key": "p"})
            assert df.count() == 800 * lost
            sent = _shuffled(spark, df)
            assert sent < 4 * 500 * 2 + 500 + 64 * 8 + 1000 * lost + 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _shuffled(spark, df):
    """Records that the exchanges of a run have written."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if metrics.contains("shuffleRecordsWritten") and "Exchange" in node.nodeName():
            total += metrics.apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName() in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"):
            todo.append(node.plan())
    return total
