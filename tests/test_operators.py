import random

import pytest
from pyspark.sql import functions as F

from figmill.operators import aggregates as A
from figmill.operators import audit, facets, gates, geometry, identifiers, joins, ordered


def test_gate_partition_and_reasons(spark):
    df = spark.createDataFrame([(1, 10.0, 9.0, 8.0), (2, 10.0, 9.0, 7.9), (3, None, 9.0, 8.0)], "id int, p double, c double, a double")
    least = {"p": 10.0, "c": 9.0, "a": 8.0}
    got = {r["id"]: r["f"] for r in df.select("id", gates.below({k: F.col(k) for k in least}, least).alias("f")).collect()}
    assert got == {1: None, 2: "a=7.9<threshold=8", 3: "p=missing<threshold=10"}
    rules = [gates.Rule("p", F.coalesce("p", F.lit(0.0)) < 10), gates.Rule("a", F.col("a") < 8)]
    passed, rejected = gates.gated(df, rules)
    assert [r["id"] for r in passed.collect()] == [1] and rejected.count() == 2


def test_prefix_and_shards(spark):
    df = spark.createDataFrame(list(enumerate("ABACA")), "i int, paper string")
    assert sorted(r["i"] for r in ordered.prefix_by_keys(df, ["i"], "paper", 2).collect()) == [0, 1, 2]
    assert ordered.prefix_by_keys(df, ["i"], "paper", 0).count() == 5
    many = spark.range(1000).withColumn("id", (F.col("id") * 7919) % 1000)
    parts = [{r["id"] for r in ordered.shard(many, ["id"], 3, k).collect()} for k in range(3)]
    assert parts[1] == {x for x in range(1000) if x % 3 == 1} and sum(map(len, parts)) == 1000


def test_priority_dedupe(spark):
    df = spark.createDataFrame([("x", 1, 3), ("x", 2, 1), ("x", 2, 2)], "id string, p int, run int")
    assert ordered.by_priority(df, "id", "p", "run").collect() == [("x", 2, 2)]


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert df.agg(*A.quantiles(F.col("v"))).first()["p25"] == 1.75
    one = spark.createDataFrame([(5.0,)], "v double").agg(*A.stats(F.col("v"))).first()
    assert one["std"] == 0.0 and spark.createDataFrame([], "v double").agg(*A.stats(F.col("v"))).first()["std"] is None
    bins = A.histogram(spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 9.99, 10.0)], "v double"), F.col("v"), [1.0, 2.0, 3.0, 5.0, 7.0, 10.5])
    assert [r["n"] for r in bins.orderBy("low").collect()] == [1, 1, 0, 0, 2]
    groups = spark.createDataFrame([("a", 10.0)] * 99 + [("b", 20.0)], "k string, v double")
    assert A.macro(groups, "k", F.col("v")).first()["mean"] == 15
    unknown = spark.createDataFrame([("",), (None,), ("0",)], "k string").select(A.known_key(F.col("k")).alias("k"))
    assert {r["k"] for r in unknown.collect()} == {"unknown"}


def test_breakdown_totals(spark):
    df = spark.createDataFrame([("x", None), ("x", "q"), ("", "q")], "a string, b string")
    rows = A.breakdowns(df, [("a",), ("b",), ("a", "b")], [F.count("*").alias("n")]).collect()
    assert {(r["breakdown"], r["label"], r["n"]) for r in rows} == {("a", "x", 2), ("a", "unknown", 1), ("b", "q", 2), ("b", "unknown", 1), ("a_x_b", "x / unknown", 1), ("a_x_b", "x / q", 1), ("a_x_b", "unknown / q", 1)}


def test_joins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 4)], "k string, v int")
    assert {tuple(r) for r in joins.upsert(old, new, "k").collect()} == {("a", 1), (None, 3), ("b", 9), ("c", 4)}
    right = spark.createDataFrame([("a", None)], "k string, v int")
    assert {tuple(r) for r in joins.overlay(old, right, ["k"]).collect()} == {("a", None), ("b", 2), (None, 3)}


def test_related_is_brute_force(spark):
    rng = random.Random(5)
    items = [(i, rng.choice("pqr"), rng.choice("xyz"), rng.randrange(4)) for i in range(40)]
    df = spark.createDataFrame(items, "id int, paper string, kind string, score int")
    got = {}
    for r in joins.related(df, "id", "paper", "kind", "score", 3).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["related_id"]
    for i, p, k, _ in items:
        others = sorted((o for o in items if o[0] != i and (o[1] == p or o[2] == k)), key=lambda o: (o[1] != p, -o[3], o[0]))
        assert [got[i][n] for n in sorted(got[i])] == [o[0] for o in others[:3]]


def test_boxes(spark):
    rows = [("f", 0, 0, 100, 100, 0.9), ("f", 5, 5, 100, 100, 0.8), ("f", 200, 3, 300, 100, 0.7), ("f", 0, 400, 100, 500, 0.6)]
    df = spark.createDataFrame(rows, "fig string, x0 int, y0 int, x1 int, y1 int, confidence double")
    kept = geometry.suppressed(df, ["fig"], 0.8)
    assert sorted(r["confidence"] for r in kept.collect()) == [0.6, 0.7, 0.9]
    assert [r["confidence"] for r in geometry.reading_order(kept, ["fig"]).orderBy("place").collect()] == [0.9, 0.7, 0.6]
    merged = geometry.merged_to(kept.withColumn("n", F.lit(2)), ["fig"], "n")
    assert {tuple(r)[1:] for r in merged.collect()} == {(0, 0, 300, 100), (0, 400, 100, 500)}
    marks = spark.createDataFrame([("f", 10, 10), ("f", 20, 20)], "fig string, lx int, ly int")
    boxed = df.withColumn("box", F.monotonically_increasing_id())
    assert geometry.spanning(boxed, marks, ["fig"], "box").count() == 2
    b = F.struct(F.lit(100).alias("x0"), F.lit(100).alias("y0"), F.lit(300).alias("x1"), F.lit(300).alias("y1"))
    cost = spark.range(1).select(geometry.label_cost(F.lit(90), F.lit(90), b, F.lit(1000), F.lit(1000)).alias("near"), geometry.label_cost(F.lit(90), F.lit(400), b, F.lit(1000), F.lit(1000)).alias("below")).first()
    assert cost["near"] == 10 * 0.75 * 8 + 10 * 0.65 * 0.45 and cost["below"] is None


def test_line_findings(spark):
    df = spark.createDataFrame([(1, "x\nimg = plt.imread('target.png')\r\nok"), (2, None)], "id int, code string")
    rules = [("load", "major", r"imread\("), ("save", "minor", r"savefig")]
    found = audit.findings(df, "id", "code", rules)
    assert [tuple(r)[:4] for r in found.collect()] == [(1, 2, "load", "major")]
    assert [tuple(r) for r in audit.finding_counts(found, "id", ["load", "save"]).collect()] == [(1, 1, 0)]


def test_picture_rules(spark):
    from figmill.plans.gate_plans import _PICTURE_RULES

    lines = {"a = plt.imread ('x')": "reads_picture", "Image.open(p)": "reads_picture", "io.BytesIO(b)": "unpacks_bytes", "np.frombuffer(b)": "unpacks_bytes", "shutil.move(a, b)": "copies_file", "copyfile(a, b)": "copies_file", "ax.imshow(z)": "shows_raster", "ax.plot(x)": None, "opened = 1": None, "imread": None, "see fig_1.png": "names_picture", "a.pngs": None}
    df = spark.createDataFrame(list(enumerate(lines)), "id int, code string")
    got = {r["id"]: r["category"] for r in audit.findings(df, "id", "code", _PICTURE_RULES).collect()}
    assert [got.get(i) for i in range(len(lines))] == list(lines.values())


def test_small_list(spark):
    from figmill.operators import gates

    df = spark.range(1001).selectExpr("cast(id as string) name").union(spark.sql("select cast(null as string)"))
    assert len(gates.small_list(df, "name")) == 1001
    with pytest.raises(ValueError):
        gates.small_list(df, "name", 1000)


def test_mined_json(spark):
    df = spark.createDataFrame([('{"doi": "10.5555/A", "runs": [{"pmcid": "pmc123"}, "10.5555/B", "x"], "note": "10.5555/C"}',)], "body string")
    got = {tuple(r) for r in identifiers.mined_json(df, "body", ["doi", "pmcid"]).collect()}
    assert got == {("doi", "10.5555/a"), ("doi", "10.5555/b"), ("pmcid", "PMC123")}
    state = spark.createDataFrame([("doi", "10.5555/a")], "kind string, identifier string")
    merged, added = identifiers.merged(state, identifiers.mined_json(df, "body", ["doi", "pmcid"]))
    assert merged.count() == 3 and {tuple(r) for r in added.collect()} == {("doi", 1), ("pmcid", 1)}
    raw = spark.createDataFrame([("10.5555/A",), ("10.5555/Z",)], "doi string")
    assert [r[0] for r in identifiers.excluded(raw, state, "doi", F.col("doi")).collect()] == ["10.5555/Z"]


def test_facets(spark):
    df = spark.createDataFrame([(1, "Bar", "J", 9.0, True), (2, "Box", "J", 7.0, False), (3, "Bar", "K", None, None)], "id int, kind string, journal string, score double, passed boolean")
    c = facets.Catalogue(id="id", score="score", texts=["kind", "journal"], weights={"kind": 6}, orders={}, passed="passed")
    ids = lambda s: [r["id"] for r in facets.searched(df, c, s).collect()]
    assert ids(facets.Search()) == [1, 2, 3] and ids(facets.Search(q="bar")) == [1, 3] and ids(facets.Search(state="open")) == [2, 3]
    counts = facets.facet(df, c, facets.Search(equal={"journal": "K"}), "journal").collect()
    assert [tuple(r) for r in counts] == [("J", 2), ("K", 1)]


def test_exemplars_of_a_hot_group(spark):
    from figmill.operators import evaluation

    rows = [("hot", i % 300) for i in range(900)] + [("two", 5), ("two", 3), ("one", 1), ("one", 1), (None, 7), ("null", None)]
    df = spark.createDataFrame(rows, "kind string, id int")
    got = [tuple(r) for r in evaluation.exemplars(df, "kind", "id").collect()]
    assert len(got) == len(rows)
    assert {g for g in got if g[0] != "hot"} == {("two", 5, 3), ("two", 3, 5), ("one", 1, None), (None, 7, None), ("null", None, None)}
    assert {g for g in got if g[0] == "hot"} == {("hot", i, 1 if i == 0 else 0) for i in range(300)}


def test_group_quantiles_are_exact(spark):
    rng = random.Random(21)
    rows = [("hot", round(rng.lognormvariate(0, 3), 4)) for _ in range(4000)] + [("same", 2.0)] * 900 + [("two", 1.0), ("two", 4.0), ("one", 5.0), (None, 1.0), (None, 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "kind string, points double").withColumn("name", F.lit("clash"))
    marks = {"low": 0.0, "p25": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {r["kind"]: tuple(r)[1:] for r in A.group_quantiles(df, ["kind"], "points", marks, ranges=20).collect()}
    want = {r["kind"]: tuple(r)[1:] for r in df.where("points is not null").groupBy("kind").agg(*[F.percentile("points", F.lit(q)).alias(n) for n, q in marks.items()]).collect()}
    assert set(got) == set(want) == {"hot", "same", "two", "one", None}
    assert all(abs(x - y) < 1e-9 * max(1, abs(y)) for k in want for x, y in zip(got[k], want[k], strict=True))
    assert A.group_quantiles(df.limit(0), ["kind"], "points", marks).count() == 0


def test_zip_of_a_large_group(spark):
    left = spark.createDataFrame([("h", i) for i in range(500)] + [("a", 2), ("a", 1), (None, 1)], "g string, x int")
    right = spark.createDataFrame([("h", i) for i in range(700)] + [("a", 9), (None, 3), ("b", 1)], "g string, y int")
    got = {tuple(r) for r in joins.zip_in_order(left, right, ["g"], [F.desc("x")], [F.asc("y")]).collect()}
    assert got == {("h", 499 - i, i) for i in range(500)} | {("a", 2, 9)}
