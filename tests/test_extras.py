import numpy as np
from pyspark.sql import functions as F

from figmill.functions import code
from figmill.operators import evaluation as E
from figmill.operators import geometry as G
from figmill.operators import pixels as P
from figmill.sources import articles as X

ARTICLE = """<article><front><article-meta><title-group><article-title>A  <i>title</i>
 here</article-title></title-group><pub-date pub-type="ppub"><year>2025</year></pub-date><pub-date pub-type="epub"><day>3</day><month>11</month><year>2026</year></pub-date></article-meta></front>
<body><fig><label>Fig. 1</label><caption>One</caption><graphic href="a.tif"/></fig><fig><label>Fig. 2</label><caption>Two</caption><graphic href="b.tif"/></fig><fig><label>Fig. 3</label><caption>Again</caption><graphic href="a.tif"/></fig></body></article>"""
PACKAGE = '<OA><records><record license="CC BY" citation="J 1"{}><link format="pdf" href="x.pdf"/><link format="tgz" href="ftp://host/p.tar.gz"/></record></records></OA>'


def test_articles(spark):
    df = spark.createDataFrame([(ARTICLE,), (ARTICLE.replace('pub-type="epub"', 'pub-type="other"'),), ("<article/>",)], "x string").coalesce(1)
    rows = df.select(X.publication_date(F.col("x")).alias("d"), X.text_at(F.col("x"), "//article-title").alias("t"), X.figures(F.col("x")).alias("f")).collect()
    assert [r["d"]["date"] for r in rows] == ["2026-11-03", "2025-00-00", ""]
    assert rows[0]["t"] == "A title here" and rows[2]["t"] == "" and rows[2]["f"] == []
    assert [tuple(f) for f in rows[0]["f"]] == [(1, "Fig. 1", "One", "a.tif"), (2, "Fig. 2", "Two", "b.tif")]
    p = spark.createDataFrame([(PACKAGE.format(""),), (PACKAGE.format(' retracted="yes"'),), ("<OA/>",)], "x string").coalesce(1).select(X.package(F.col("x")).alias("p")).collect()
    assert p[0]["p"]["link"] == "https://host/p.tar.gz" and p[0]["p"]["license"] == "CC BY" and p[1]["p"] is None and p[2]["p"] is None


def test_marked_up_figures(spark):
    xml = """<article xmlns:xlink="x"><body><sec><fig id="f1"><label>Fig. 1</label><caption><title>A <b>bold</b> title</title><p>First <i>part</i>; second.</p></caption><graphic xlink:href="a.tif"/></fig>
<fig-group><fig><caption><p>No label.</p></caption><graphic xlink:href="b.tif"/></fig></fig-group><fig><label>Fig. 3</label></fig>
<fig><label>Fig. 4</label><alternatives><graphic xlink:href="c.tif"/><graphic xlink:href="c2.tif"/></alternatives></fig></sec></body><back><fig><graphic xlink:href="z.tif"/></fig></back></article>"""
    got = spark.createDataFrame([(xml,), (None,)], "x string").coalesce(1).select(X.figures(F.col("x")).alias("f")).collect()
    assert [tuple(f) for f in got[0]["f"]] == [(1, "Fig. 1", "A bold titleFirst part; second.", "a.tif"), (2, "", "No label.", "b.tif"), (3, "Fig. 4", "", "c.tif")]
    assert got[1]["f"] == []


def test_disjoint_pairs(spark):
    """Three boxes over each other, a null side, and copies; a box cut below the least size is dropped."""
    rows = [("f", 1, 0, 0, 100, 100, "k"), ("f", 2, 60, 0, 160, 100, None), ("f", 3, 0, 70, 100, 170, "k"), ("f", 4, None, 0, 9, 9, "k"), (None, 5, 0, 0, 50, 50, "k"), ("g", 6, 0, 0, 20, 90, "k")]
    df = spark.createDataFrame(rows, "fig string, box int, x0 int, y0 int, x1 int, y1 int, note string")
    got = {r["box"]: tuple(r)[2:6] for r in G.disjoint(df, ["fig"]).collect()}
    # 1 and 2 are cut at x = 80, then 1 and 3 at y = 85, then 2 and 3, whose centres differ more in y, at (100 + 85) / 2, to even.
    assert got == {1: (0, 0, 80, 85), 2: (80, 0, 160, 92), 3: (0, 92, 100, 170)}
    assert G.disjoint(df.limit(0), ["fig"]).columns == df.columns


def test_code(spark):
    df = spark.createDataFrame([("x = 1  # a", "x = 1"), ("x", None), ("", "y")], "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(code.code_similarity("a", "b")).collect()] == [100.0, None, None]
    errors = [r[0] for r in spark.createDataFrame([("x = 1",), ("x = (",), (None,)], "c string").coalesce(1).select(code.syntax_error("c")).collect()]
    assert errors[0]["error"] is None and errors[1]["error"] and errors[2]["error"] == "empty"


def test_evaluation(spark):
    calls = spark.sparkContext.accumulator(0)

    @E.backend("fragile")
    def fragile(batch):
        calls.add(len(batch))
        if (batch["text"] == "bad").any():
            raise ValueError("no")
        return batch[["signature"]].assign(result=batch["text"].str.upper(), error=None)

    df = spark.createDataFrame([("a",), ("bad",), ("b",), ("a",)], "text string").coalesce(1)
    first = E.evaluated(df, ["text"], "fragile", "run1")
    rows = first.collect()
    assert sorted((r["result"], r["error"]) for r in rows if r["result"]) == [("A", None), ("B", None)] and [r["error"] for r in rows if not r["result"]] == ["no"]
    cache = spark.createDataFrame(rows, first.schema)
    before = calls.value
    again = E.evaluated(df, ["text"], "fragile", "run1", cache).collect()
    assert len(again) == 3 and calls.value == before + 1  # only the row that failed
    assert E.evaluated(df, ["text"], "mock", "run2", cache).where("result like 'mock:%'").count() == 3


def test_reports(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("x", 2), ("y", 9)], "g string, id int")
    assert {(r["id"], r["exemplar"]) for r in E.exemplars(df, "g", "id").collect()} == {(1, 2), (2, 1), (3, 1), (9, None)}
    audits = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", False, True)], "g string, c boolean, p boolean")
    assert {tuple(r) for r in E.problem_rates(audits, ["g"], F.col("c"), F.col("p")).collect()} == {("a", 2, 1, 0.5), ("b", 0, 0, None)}
    scored = E.judged(spark.createDataFrame([(True, 1.0, None), (False, 2.0, 50.0), (True, None, None)], "ok boolean, a double, b double").coalesce(1), F.col("ok"), {"s": (F.col("a"), 50.0), "t": (F.col("b"), 1.0)})
    assert [(r["s"], r["mean_score"]) for r in scored.collect()] == [(50.0, 50.0), (0.0, 0.0), (None, None)] or [r["mean_score"] for r in scored.collect()][1] == 0.0
    runs = spark.createDataFrame([("m1", 90), ("m2", 30)], "dir string, elapsed_seconds int")
    made = spark.createDataFrame([("m1", '{"score": {"mean": 51.23456}}')], "dir string, summary string")
    assert {tuple(r) for r in E.leaderboard(runs, made, "dir", ["score"]).collect()} == {("m1", 90, 51.2346, 1.5), ("m2", 30, None, 0.5)}
    kept = E.resume_reasons(spark.createDataFrame([("a", "b")], "x string, y string"), {"changed": F.col("x") == F.col("y"), "fine": F.lit(True), "unknown": F.lit(None).cast("boolean")})
    assert kept.first()["reasons"] == ["changed", "unknown"]


def test_pixels(spark):
    image = np.full((40, 60), 255.0)
    image[5:15, 5:20] = 0
    image[25:35, 40:55] = 100
    flat = [float(v) for v in image.ravel()]
    df = spark.createDataFrame([(flat, 60), (None, 60), ([], 60)], "g array<double>, w int").coalesce(1)
    boxes = [r[0] for r in df.select(P.connected_boxes("g", "w", F.lit(0))).collect()]
    assert [tuple(b) for b in boxes[0]] == [(5, 5, 20, 15), (40, 25, 55, 35)] and boxes[1] == [] == boxes[2]
    assert len(df.select(P.connected_boxes("g", "w", F.lit(12))).first()[0]) == 1
    assert tuple(df.select(P.content_box("g", "w")).first()[0]) == (1, 1, 59, 39)
    c = df.select(P.complexity("g", "w").alias("c"), P.structural_similarity("g", "g", "w").alias("s"), P.line_features("g", "w").alias("l")).collect()
    assert 0 < c[0]["c"]["score"] < 100 and c[1]["c"]["score"] is None and abs(c[0]["s"] - 1) < 1e-9 and c[0]["l"]["axes"] == 3.0
    bits, other = [True, False, False, True], [False, True, True, False]
    t = spark.createDataFrame([(bits, ["a", "b"], [other, bits])], "x array<boolean>, l array<string>, t array<array<boolean>>")
    assert tuple(t.select(P.letter("x", "l", "t")).first()[0]) == ("b", 1.0)


def test_more_boxes(spark):
    df = spark.createDataFrame([("f", 1, 0, 0, 200, 200), ("f", 2, 150, 10, 400, 200), ("f", 3, 0, 300, 200, 500)], "fig string, box int, x0 int, y0 int, x1 int, y1 int")
    cut = {r["box"]: (r["x0"], r["x1"]) for r in G.disjoint(df, ["fig"]).collect()}
    assert cut == {1: (0, 175), 2: (175, 400), 3: (0, 200)} or cut == {1: (0, 175), 2: (175, 400), 3: (0, 200)}
    marks = spark.createDataFrame([("f", "a", 0, 0), ("f", "b", 150, 5), ("f", "c", 0, 295)], "fig string, label string, lx int, ly int")
    given = {r["box"]: r["label"] for r in G.labelled(df, marks, ["fig"], "box", F.lit(500), F.lit(500)).collect()}
    assert given.get(2) == "b" and given.get(3) == "c"
    b = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(300).alias("x1"), F.lit(200).alias("y1"))
    cells = spark.range(1).select(G.grid(b, F.lit(6)).alias("c")).first()["c"]
    assert [tuple(c) for c in cells] == [(0, 0, 100, 100), (100, 0, 200, 100), (200, 0, 300, 100), (0, 100, 100, 200), (100, 100, 200, 200), (200, 100, 300, 200)]
    small = F.struct(F.lit(10).alias("x0"), F.lit(10).alias("y0"), F.lit(20).alias("x1"), F.lit(300).alias("y1"))
    assert tuple(spark.range(1).select(G.at_least(small, F.lit(500), F.lit(500)).alias("b")).first()["b"]) == (0, 10, 100, 300)
