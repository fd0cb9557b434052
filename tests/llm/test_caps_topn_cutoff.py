import random

from pyspark.sql import functions as F

from figmill.llm import caps, common, cutoff, topn


def test_nested_caps(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abcd"), float(rng.randrange(5))) for i in range(300)] + [(300, None, 1.0), (301, None, 2.0)]
    owner = {"a": "x", "b": "x", "c": "y", "d": "y", None: "z"}
    df = spark.createDataFrame([(i, g, owner[g], s, 0) for i, g, s in rows], "id int, author string, domain string, score double, __rank int")
    got = {r["id"] for r in caps.nested_caps(df, [("author", 5), ("domain", 7)], [F.desc("score"), F.asc("id")]).collect()}
    want, left = set(), sorted(rows, key=lambda r: (-r[2], r[0]))
    taken = {}
    for i, g, _ in left:
        if taken.get(("a", g), 0) < 5 and taken.get(("d", owner[g]), 0) < 7:
            want.add(i)
            taken[("a", g)], taken[("d", owner[g])] = taken.get(("a", g), 0) + 1, taken.get(("d", owner[g]), 0) + 1
    assert got == want
    assert caps.nested_caps(df.limit(0), [("author", 5)], [F.asc("id")]).count() == 0 and caps.nested_caps(df, [("author", 0)], [F.asc("id")]).count() == 0


def test_inner_and_share_caps_change_the_result(spark):
    rows = [(i, f"k{i % 4}", f"a{i % 4 // 2}", "j", float(i)) for i in range(40)] + [(100, "k9", "a9", "other", 0.0)]
    df = spark.createDataFrame(rows, "id int, key string, article string, journal string, score double")
    order = [F.desc("score"), F.asc("id")]
    kept = lambda levels: {r["id"] for r in caps.nested_caps(df, levels, order).collect()}
    assert len(kept([("article", 8)])) == 17 and len(kept([("key", 3), ("article", 8)])) == 13
    assert len(kept([("key", 2), ("article", 5)])) == 9 and len(kept([("article", 5)])) == 11
    assert kept([("key", 3), ("article", 8), ("journal", 0.25)]) == {*range(30, 40), 100}


def test_scores(spark):
    t = "timestamp '2026-01-0{}'"
    rows = [("p", t.format(1), "3.0D"), ("p", t.format(2), "double('NaN')"), ("p", t.format(3), "null"), ("q", t.format(1), "12.0D"), ("q", "null", "1.0D"), ("r", t.format(1), "null"), (None, t.format(1), "1.0D"), ("p", t.format(1), "3.0D")]
    sql = " union all ".join(f"select {repr(p) if p else 'cast(null as string)'} panel_id, {w} scored_at, timestamp '2026-02-01' ingested_at, cast({s} as double) overall_quality_score" for p, w, s in rows)
    assert {tuple(r) for r in common.panel_scores(spark.sql(sql)).collect()} == {("p", 3.0), ("q", 10.0)}


def test_labels(spark):
    names = {"multiline": "multi_line"}
    df = spark.createDataFrame([("Multi‐line",), ("multiLine",), ("ｍｕｌｔｉ_ｌｉｎｅ\n",), (" MULTI  LINE\xa0",), ("multi_lime",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(common.to_known(F.col("v"), names)).collect()] == ["multi_line"] * 4 + [None] * 3


def brute_top(rows, n):
    out = {}
    for g, s, i in sorted({r for r in rows if None not in r and r[1] == r[1]}, key=lambda r: (-r[1], r[2])):
        out.setdefault(g, [])
        if len(out[g]) < n:
            out[g].append((s, i))
    return {(g, s, i) for g, xs in out.items() for s, i in xs}


def test_top_per_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + list("abc")), float(rng.randrange(40)), f"i{k:05d}") for k in range(20_000)]
    rows += rows[:50] + [(None, 1.0, "x"), ("a", None, "y"), ("a", float("nan"), "z"), ("lonely", -1.0, "w")]
    df = spark.createDataFrame(rows, "kind string, points double, name string").withColumn("g", F.lit("clash"))
    for size in (1 << 10, 8 << 20):  # many row groups, most of them skipped; and one a file
        got = {tuple(r) for r in topn.top_per_group(df, "kind", "points", "name", 7, row_group_bytes=size).collect()}
        assert got == brute_top(rows, 7)
    assert topn.top_per_group(df.limit(0), "kind", "points", "name", 7).count() == 0


def test_row_groups_of_many_groups_are_skipped(spark):
    """20,000 groups of up to 30 rows, many in each row group: exact, with row groups skipped."""
    rng = random.Random(14)
    rows = [(f"g{k % 20_000:05d}", float(rng.randrange(10_000)), f"i{k:07d}") for k in range(600_000)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(rows, columns=["kind", "points", "name"]))
    got = topn.top_per_group(df, "kind", "points", "name", 2, row_group_bytes=1 << 16).toPandas()
    assert set(got.itertuples(index=False, name=None)) == brute_top(rows, 2)
    counts = topn.skips(df, "kind", "points", "name", 2, row_group_bytes=1 << 16).first()
    assert counts["skipped"] > 0 and counts["first"] + counts["later"] + counts["skipped"] == counts["row_groups"]


def test_cutoffs(spark):
    rng = random.Random(6)
    rows = [(g, round(rng.random() * rng.choice([1, 10]), rng.choice([0, 1, 6]))) for g in "abc" for _ in range(400)] + [("d", 5.0)] * 10 + [(None, 1.0), ("a", None), ("other", 1.0)]
    targets = {"a": 350, "b": 1000, "c": 1, "d": 500, "empty": 300}
    df = spark.createDataFrame(rows, "g string, score double")
    wanted = spark.createDataFrame(list(targets.items()), "g string, keep_permille int")
    for rule in ("at_least", "closest"):
        got = {r["g"]: (r["cutoff"], r["kept"], r["scored"]) for r in cutoff.cutoffs(df, wanted, "g", 0.0, 10.0, rule).collect()}
        want = {}
        for g, keep in targets.items():
            s = [x for k, x in rows if k == g and x is not None]
            kept = {c: sum(x >= c for x in s) for c in s}
            if not s:
                continue
            enough = [c for c in kept if kept[c] * 1000 >= keep * len(s)]
            c = max(enough) if rule == "at_least" else min(kept, key=lambda c: (abs(kept[c] * 1000 - keep * len(s)), -c))
            want[g] = (c, kept[c], len(s))
        assert got == want, rule
    assert cutoff.cutoffs(df.limit(0), wanted, "g", 0.0, 10.0).count() == 0
