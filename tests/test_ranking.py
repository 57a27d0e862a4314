import pytest
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from flowlens.operators.ranking import (
    assign_intervals, histogram_bits, ordered_rows, rank_in_order, stable_rank, with_row_key,
)
from flowlens.operators.split import (
    bernoulli_cap, cap_per_group, cap_total, last_rank, split_plan, stratified_sample, stratified_split,
)

FEW = settings(max_examples=4, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture])


def classes(spark, n, hot=0.34):
    """Rows of four classes, class 0 holding a third of them."""
    cls = F.when(F.col("id") < int(n * hot), 0).otherwise(1 + F.col("id") % 3)
    return spark.range(n).select("id", cls.cast("int").alias("cls"))


@FEW
@given(n=s.integers(1, 3000), parts=s.integers(1, 7), seed=s.integers(0, 10))
def test_rank_is_a_permutation(spark, n, parts, seed):
    df = classes(spark, n).repartition(parts)
    ranks = stable_rank(df, "cls", ["id"], seed).groupBy("cls").agg(
        F.count("*").alias("n"), F.countDistinct("rank").alias("d"),
        F.min("rank").alias("lo"), F.max("rank").alias("hi")).collect()
    for r in ranks:
        assert (r["lo"], r["hi"], r["d"]) == (1, r["n"], r["n"])


def test_rank_ignores_partitioning_and_depends_on_seed(spark):
    df = classes(spark, 2000)
    first = {r["id"]: r["rank"] for r in stable_rank(df.repartition(3), "cls", ["id"]).collect()}
    again = {r["id"]: r["rank"] for r in stable_rank(df.repartition(7), "cls", ["id"]).collect()}
    other = {r["id"]: r["rank"] for r in stable_rank(df, "cls", ["id"], 7).collect()}
    assert first == again
    assert first != other


@FEW
@given(n=s.integers(10, 2000), bits=s.integers(1, 8))
def test_intervals_agree_with_ranks(spark, n, bits):
    df = classes(spark, n)
    sizes = {r["cls"]: r["n"] for r in df.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    plan = []
    for cls, size in sizes.items():
        cuts = [0, size // 4, size // 3, size]
        plan += [(cls, lo, hi, f"{i}") for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
    got = {r["id"]: r["part"] for r in assign_intervals(
        df, plan, "cls", "string", "part", ["id"], bits=bits).collect()}
    assert len(got) == n
    for r in stable_rank(df, "cls", ["id"]).collect():
        part = next(v for c, lo, hi, v in plan if c == r["cls"] and lo < r["rank"] <= hi)
        assert got[r["id"]] == part


def test_rest_is_dropped_or_kept(spark):
    df = classes(spark, 300)
    plan = [(0, 0, 10, 1)]
    assert assign_intervals(df, plan, "cls", "int", "x", ["id"]).count() == 10
    kept = assign_intervals(df, plan, "cls", "int", "x", ["id"], keep_rest=True)
    assert kept.count() == 300
    assert kept.filter("x = 1").count() == 10


def test_null_class_is_a_class(spark):
    df = spark.range(100).select(
        "id", F.when(F.col("id") % 2 == 0, "a").alias("cls"))
    assert cap_per_group(df, 20, "cls", ["id"]).groupBy("cls").count().count() == 2


@FEW
@given(n=s.integers(2, 400), kinds=s.integers(1, 3), parts=s.integers(1, 6))
def test_copies_are_divided_exactly(spark, n, kinds, parts):
    df = spark.range(n).select(
        F.lit("a").alias("cls"), (F.col("id") % kinds).alias("k")).repartition(parts)
    plan = [("a", 0, n // 3, "x"), ("a", n // 3, n // 2, "y"), ("a", n // 2, n, "z")]
    got = Counter(r["p"] for r in assign_intervals(df, plan, "cls", "string", "p", ["k"]).collect())
    assert got == Counter({v: hi - lo for _, lo, hi, v in plan if hi > lo})
    both = assign_intervals(df, plan, "cls", "string", "p", ["k"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in both} == Counter(i % kinds for i in range(n))


def test_split_with_one_row_copied_into_a_third(spark):
    df = spark.range(3000).select(
        F.lit("a").alias("label_8"),
        F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("f"))
    got = Counter(r["split"] for r in stratified_split(df).collect())
    assert got == {"stream": 90, "train": 2328, "val": 291, "test": 291}


def test_last_rank_follows_double_division():
    for size in (1, 3, 7, 10, 100, 999, 12345):
        for fraction in (0.0, 0.03, 0.3, 0.806, 0.903, 1.0):
            expected = sum(1 for r in range(1, size + 1) if r / size <= fraction)
            assert last_rank(size, fraction) == expected


def test_split_is_exact_and_complete(spark):
    df = classes(spark, 5000)
    parts = stratified_split(df, "cls", ["id"])
    assert parts.select("id").distinct().count() == 5000
    got = {(r["cls"], r["split"]): r["count"] for r in parts.groupBy("cls", "split").count().collect()}
    for cls, size in Counter(r["cls"] for r in df.collect()).items():
        ends = [last_rank(size, f) for f in (0.03, 0.03 + 0.97 * 0.8, 0.03 + 0.97 * 0.8 + 0.97 * 0.1)]
        expected = dict(zip(("stream", "train", "val", "test"),
                            [b - a for a, b in zip([0, *ends], [*ends, size])]))
        assert {k: got[(cls, k)] for k in expected} == expected


def test_split_caps(spark):
    df = classes(spark, 5000)
    parts = stratified_split(df, "cls", ["id"], train_cap=100, val_test_cap=60)
    got = Counter((r["cls"], r["split"]) for r in parts.collect())
    assert all(got[(c, "train")] == 100 for c in range(4))
    for name in ("val", "test"):
        assert 56 <= sum(got[(c, name)] for c in range(4)) <= 60
    plan = split_plan({"a": 1000}, train_cap=10, val_test_cap=10)
    assert [hi - lo for _, lo, hi, _ in plan] == [30, 10, 10, 10]


def test_samples(spark):
    df = classes(spark, 4000)
    assert cap_total(df, 400, "cls", ["id"]).count() in range(396, 401)
    assert cap_total(df, 9999, "cls", ["id"]).count() == 4000
    sample = stratified_sample(df, 400, "cls", ["id"]).groupBy("cls").count().collect()
    assert {r["cls"]: r["count"] for r in sample} == {0: 136, 1: 88, 2: 88, 3: 88}
    assert stratified_sample(df, 5000, "cls", ["id"]).count() == 4000


def test_many_groups_still_join_on_the_map_side(spark):
    df = spark.range(4000).select("id", (F.col("id") % 700).cast("int").alias("cls"))
    kept = cap_per_group(df, 2, "cls", ["id"])
    assert kept.groupBy("cls").count().filter("count != 2").count() == 0
    assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()


def test_row_key_replaces_all_columns(spark):
    df = with_row_key(classes(spark, 1000))
    assert df.select("row_key").distinct().count() == 1000
    assert cap_total(df, 100, "cls", ["row_key"]).count() in range(97, 101)


def test_groups_must_be_a_dictionary(spark, monkeypatch):
    from flowlens.operators import ranking
    monkeypatch.setattr(ranking, "MAX_GROUPS", 3)
    df = spark.range(20).selectExpr("id", "id % 4 AS g", "id % 3 AS h")
    assert len(ranking.group_sizes(df, "h")) == 3
    with pytest.raises(ValueError, match="more than 3"):
        ranking.group_sizes(df, "g")


def test_a_row_copied_into_a_third_is_ranked_by_many_tasks(spark):
    df = spark.range(60_000).select(
        F.lit("a").alias("cls"), F.when(F.col("id") < 20_000, -1).otherwise(F.col("id")).alias("f"))
    # Small ranges would be read by one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in ordered_rows(df, "cls", [F.xxhash64("f")]).groupBy(
            F.shiftright("_at", 33)).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    ranks = stable_rank(df, "cls", ["f"]).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 60_001))
    hot = sorted(r["rank"] for r in ranks if r["f"] == -1)
    assert hot == list(range(hot[0], hot[0] + 20_000))


def test_rank_in_a_given_order(spark):
    rows = [(None, 3), (None, 1), ("a", 2), ("a", None), ("b", 5), ("a", 2)]
    df = spark.createDataFrame(rows, "cls string, v int").repartition(3)
    whole = {(r["cls"], r["v"], r["place"]) for r in rank_in_order(df, "cls", [-F.col("v")], "place").collect()}
    assert whole == {(None, 3, 1), (None, 1, 2), ("a", None, 1), ("a", 2, 2), ("a", 2, 3), ("b", 5, 1)}
    every = rank_in_order(df.filter("v IS NOT NULL"), None, [F.col("v")]).collect()
    assert sorted((r["rank"], r["v"]) for r in every) == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 5)]
    assert rank_in_order(df.limit(0), "cls", [F.col("v")]).count() == 0


def test_histogram_follows_the_counted_size():
    assert [histogram_bits(n) for n in (0, 10**7, 10**12)] == [6, 7, 24]


def test_bernoulli_draws_do_not_depend_on_partitions(spark):
    df = classes(spark, 4000)
    first, again = ({r["id"] for r in bernoulli_cap(df.repartition(p), 400, "cls", ["id"]).collect()}
                    for p in (4, 7))
    assert first == again and 330 < len(first) < 470
    assert bernoulli_cap(df, 4000, "cls").count() == 4000
