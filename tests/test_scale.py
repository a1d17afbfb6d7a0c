"""Hot keys and long orders give the same results as plain joins and windows."""

import random

import pytest
from pyspark.sql import functions as F

from filecensus.operators import scale
from filecensus.queries import QUERIES


@pytest.mark.parametrize("hot_rows", [5, 1_000_000])
def test_lookup(spark, hot_rows):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 40}") for i in range(300)], "ordinal bigint, k string")
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    facts = facts.filter("k <> 'k7'")
    joined = scale.lookup(rows, facts, ["k"], "n", F.col("ordinal"), hot_rows)
    plain = rows.join(facts, "k", "left").select(*joined.columns)
    assert sorted(map(tuple, joined.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    unweighted = scale.lookup_unweighted(rows, facts.drop("n"), ["k"], F.col("ordinal"), hot_rows)
    assert sorted(map(tuple, unweighted.collect()), key=repr) == sorted(
        map(tuple, plain.drop("n").collect()), key=repr)


def test_hot_rows_pass_the_shuffle_scattered(spark):
    rows = spark.range(3000).select(F.col("id").alias("ordinal"), F.concat(F.lit("h"), F.floor(F.col("id") / 10_000)).alias("k"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = scale.lookup(rows, facts, ["k"], "n", F.col("ordinal"), 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = joined.groupBy(F.spark_partition_id()).agg(F.count("ordinal").alias("rows"), F.sum("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(r["rows"] for r in sizes) < 1000


def test_running_totals_and_ranks(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("aaab"), rng.randint(-3, 9)) for i in rng.sample(range(1000), 400)]
    rows = spark.createDataFrame(data, "ordinal bigint, k string, v bigint")
    got = scale.running_totals(rows, ["k"], ["ordinal"], scale.ordinal_chunk("ordinal", 50), {"total": F.col("v")})
    totals, ranks, expected = {}, {}, {}
    for ordinal, k, v in sorted(data):
        totals[k] = totals.get(k, 0) + v
        expected[ordinal] = (totals[k], ranks.get(k, 0))
        ranks[k] = ranks.get(k, 0) + 1
    assert {r["ordinal"]: r["total"] for r in got.collect()} == {o: e[0] for o, e in expected.items()}
    placed = scale.ranked(rows, ["k"], ["ordinal"], scale.ordinal_chunk("ordinal", 50), "place")
    assert {r["ordinal"]: r["place"] for r in placed.collect()} == {o: e[1] for o, e in expected.items()}


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 37 % 500,) for i in range(500)], "v bigint").repartition(7)
    got = scale.numbered(rows, ["v"], "n").collect()
    assert {r["v"]: r["n"] for r in got} == {v: v for v in range(500)}


def test_context_blocks(spark):
    rows = spark.range(100).select(F.col("id").alias("place"))
    got = scale.with_context(rows, "place", 3, 10).collect()
    own = {r["place"]: r["block"] for r in got if not r["context"]}
    assert own == {i: i // 10 for i in range(100)}
    assert sorted((r["place"], r["block"]) for r in got if r["context"]) == sorted(
        (i, i // 10 + 1) for i in range(100) if i % 10 >= 7)


def test_tables_go_to_the_shared_folder():
    class Found:
        def __init__(self, folder):
            self.folder = folder

        def isDefined(self):
            return self.folder is not None

        def get(self):
            return self.folder

    class Session:
        settings = {"spark.sql.warehouse.dir": "hdfs://shared/warehouse"}
        called = None

        class sparkContext:
            applicationId = "app-1"
            master = "yarn"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():
                            return Found(Session.called)
                    return Context

        class conf:
            @staticmethod
            def get(name, default=None):
                return Session.settings.get(name, default)

    assert scale.run_folder(Session) == "hdfs://shared/warehouse/checkpoints/filecensus-app-1"
    Session.called = "hdfs://shared/set-by-call"
    assert scale.checkpoint_folder(Session) == "hdfs://shared/set-by-call"
    Session.settings["spark.checkpoint.dir"] = "hdfs://shared/checkpoints"
    assert scale.checkpoint_folder(Session) == "hdfs://shared/checkpoints"
    Session.settings = {"spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}
    Session.called = None
    with pytest.raises(ValueError):  # a machine's own disk
        scale.run_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert scale.run_folder(Session) == "file:/home/me/spark-warehouse/checkpoints/filecensus-app-1"


def test_very_many_hot_keys_are_all_split(spark):
    """No key's rows meet in one place, however many keys are hot."""
    rows = spark.range(50_000).select((F.col("id") % 5000).alias("k"), F.col("id").alias("ordinal"))
    facts = spark.range(5000).select(F.col("id").alias("k"), F.lit(10).cast("bigint").alias("n"), (F.col("id") * 2).alias("v"))
    joined = scale.lookup(rows, facts, ["k"], "n", F.col("ordinal"), 2)
    assert joined.filter("v <> 2 * k OR v IS NULL").isEmpty() and joined.count() == 50_000
    salted = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salted


def test_newest_rows(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, *range(9)]), i) for i in range(200)]
    rows = spark.createDataFrame(data, "k string, m int, ordinal bigint, v int")
    tops = {}
    for k, m, ordinal, _ in data:
        if ordinal is not None:
            tops[k, m] = max(tops.get((k, m), -1), ordinal)
    counts = {key: sum((k, m) == key and o is not None for k, m, o, _ in data) for key in tops}
    expected = [(*row, counts[row[:2]]) for row in data if row[2] is not None and row[2] == tops[row[:2]]]
    found = scale.newest(rows, ["k", "m"], "ordinal", n=F.count(F.lit(1)))
    assert found.columns == [*rows.columns, "n"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def nodes(plan):
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.initialPlan()
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


@pytest.mark.parametrize("name", ["exact_duplicates", "duplicate_members", "upsert_entries", "progress_snapshot", "apply_plan"])
def test_elections_hash(spark, name):
    """Whole rows are never sorted for an election; what is still sorted was first joined with its group's best."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    names = [node.nodeName() for node in nodes(plan)]
    if name not in ("exact_duplicates", "duplicate_members"):  # whose counts are a table by then
        assert "HashAggregate" in names
    for node in nodes(plan):
        if node.nodeName() == "SortAggregate":
            assert any("Join" in below.nodeName() for below in nodes(node)), node.treeString()
    if name in ("upsert_entries", "apply_plan"):
        assert "SortAggregate" not in names
