import random

from pyspark.sql import functions as F

from figmill.llm import mix

QUOTAS = "quota_no long, draw_name string, size_permille int, subject string, subtype string, complexity_level string, target_permille int, min_rows int"


def test_draw(spark):
    rng = random.Random(8)
    rows = [(f"p{i:04d}", rng.choice(["bio", "phy", None]), rng.choice(["bar", "box"]), rng.choice(["low", "high", None])) for i in range(2000)]
    rows += [(f"q{i}", "rare", "bar", "low") for i in range(9)]
    df = spark.createDataFrame(rows, "panel_id string, subject string, subtype string, complexity_level string")
    quotas = [
        (1, "x", 500, "bio", None, None, 600, 10),
        (2, "x", 500, "rare", None, None, 1, 8),
        (3, "x", 500, None, "bar", None, 300, 0),
        (4, "x", 500, None, None, "high", 990, 0),
        (5, "y", 100, "rare", None, None, 1000, 0),
        (6, "y", 100, "none", None, None, 0, 3),
    ]
    sample, report = mix.draw(df, spark.createDataFrame(quotas, QUOTAS))
    drawn = [tuple(r) for r in sample.collect()]
    assert len(drawn) == len(set(drawn)) and {tuple(r) for r in sample.collect()} == set(drawn)
    by = {r[0]: r[1:] for r in rows}
    got = {r["quota_no"]: r for r in report.collect()}
    for no, draw, size, *labels, permille, least in quotas:
        d = size * len(rows) // 1000
        match = lambda p: all(q is None or q == v for q, v in zip(labels, by[p], strict=True))  # noqa: E731, B023
        assert got[no]["needed"] == max(least, permille * d // 1000)
        assert got[no]["available"] == sum(match(p) for p in by)
        assert got[no]["drawn"] == sum(match(p) for n, p in drawn if n == draw) >= min(got[no]["needed"], got[no]["available"])
        assert got[no]["gap"] == max(0, got[no]["needed"] - got[no]["drawn"])


def test_empty(spark):
    df = spark.createDataFrame([], "panel_id string, subject string, subtype string, complexity_level string")
    sample, report = mix.draw(df, spark.createDataFrame([(1, "x", 500, "bio", None, None, 600, 10)], QUOTAS))
    assert sample.count() == 0 and report.first()["gap"] == 10
    sample, report = mix.draw(df, spark.createDataFrame([], QUOTAS))
    assert sample.count() == 0 and report.count() == 0


def test_take_by_key(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(1000) / 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "s string, u double, i int")
    plan = spark.createDataFrame([("a", 700), ("b", 10_000)], "s string, take long")
    got = {r["i"] for r in mix.take_by_key(df, plan, ["s"], "u", "i").collect()}
    want = {r[2] for r in sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[1], r[2]))[:700]} | {r[2] for r in rows if r[0] == "b"}
    assert got == want
    assert mix.take_by_key(df.where(F.lit(False)), plan, ["s"], "u", "i").count() == 0


def test_inclusion_is_near_the_weights(spark):
    """Over many seeds, records are drawn as often as their cell's raked weight says."""
    rows = [(f"a{i}", "bio", "bar", "low") for i in range(40)] + [(f"b{i}", "phy", "bar", "low") for i in range(160)]
    df = spark.createDataFrame(rows, "panel_id string, subject string, subtype string, complexity_level string").coalesce(1)
    quotas = [(1, "x", 200, "bio", None, None, 500, 0), (2, "x", 200, "phy", None, None, 500, 0)]
    q = spark.createDataFrame(quotas, QUOTAS)
    d = mix.Draw({("bio", "bar", "low"): 40, ("phy", "bar", "low"): 160}, [r.asDict() for r in q.collect()], 200)
    assert [round(float(x)) for x in d.wish] == [20, 20]
    times = {}
    seeds = 12
    for seed in range(seeds):
        sample = [r["panel_id"] for r in mix.draw(df, q, seed=str(seed))[0].collect()]
        assert len(sample) == 40
        for p in sample:
            times[p[0]] = times.get(p[0], 0) + 1
    assert abs(times["a"] / seeds - 20) < 3.5 and abs(times["b"] / seeds - 20) < 3.5
