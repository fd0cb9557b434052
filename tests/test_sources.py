import json

from pyspark.sql import functions as F

from figmill.sources import manifests as M
from figmill.sources import schemas
from figmill.streaming import state


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y", z\nw', [1, 2]), ("b", "", None)], "k string, v string, l array<int>")
    M.write_csv(df, str(tmp_path / "c"))
    back = {r["k"]: r for r in M.read_csv(spark, str(tmp_path / "c"), ["k", "v", "l", "absent"]).collect()}
    assert back["a"]["v"] == 'x "y", z\nw' and back["a"]["l"] == "[1,2]" and back["b"]["v"] == "" and back["a"]["absent"] is None
    assert M.read_csv(spark, str(tmp_path / "none"), ["k"]).columns == ["k"]
    assert M.read_csv(spark, str(tmp_path / "c"), limit=1).count() == 1


def test_union_header(spark):
    a, b = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int")
    assert M.union_all([a, b]).columns == ["a", "b", "c"]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.5)], "k int, v double")
    M.write_json(df, str(tmp_path / "j"))
    lines = sorted((json.loads(x) for f in (tmp_path / "j").glob("part*") for x in f.read_text().splitlines()), key=lambda r: r["k"])
    assert lines == [{"k": 1, "v": None}, {"k": 2, "v": 2.5}]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"ok": true}')
    (tmp_path / "r" / "b.json").write_text("no json")
    rows = M.read_json(spark, str(tmp_path / "r"), "ok boolean").collect()
    assert sorted((r["ok"], r["_bad"] is None) for r in rows if r["ok"]) == [(True, True)] and sum(r["_bad"] is not None for r in rows) == 1


def test_samples(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"records": [{"panel_id": "p1", "reproduce_png": "", "reference_png": "r.png", "threshold_complexity_level": "low"}, {"dataset_dir": "a/p2/"}, {"caption": "x"}, 5]}))
    samples, rejected = M.read_samples(spark, str(tmp_path / "m.json"))
    got = {r["panel_id"]: r for r in samples.collect()}
    assert set(got) == {"p1", "p2"} and got["p1"]["reproduce_png"] == "r.png" and got["p1"]["complexity_level"] == "low"
    assert {r["reason"] for r in rejected.collect()} == {"no panel_id", "not an object"}


def test_identifiers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n# no\n\n y \n")
    (tmp_path / "b.json").write_text('["p", "q"]')
    (tmp_path / "c.json").write_text('{"dois": ["d"], "other": ["o"]}')
    read = lambda n: {r[0] for r in M.read_identifiers(spark, str(tmp_path / n), ["dois", "pmcids"]).collect()}
    assert read("a.txt") == {"x", "y"} and read("b.json") == {"p", "q"} and read("c.json") == {"d"} and read("none") == set()
    M.write_identifiers(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string"), "k", str(tmp_path / "o"))
    assert [x for f in sorted((tmp_path / "o").glob("part*")) for x in f.read_text().split()] == ["a", "b"]


def test_file_choices(spark):
    files = spark.createDataFrame([("r", "x/papers.json"), ("r", "x/papers.csv"), ("s", "y/other.json")], "run string, path string")
    assert {tuple(r) for r in M.first_existing(files, ["run"], "path", ["papers.csv", "papers.json"]).collect()} == {("r", "x/papers.csv"), ("s", "y/other.json")}
    members = spark.createDataFrame([(1, "f1.jpg", "f1"), (1, "f1.png", "f1"), (1, "f1_HTML.png", "f1"), (2, "g2x.png", "g2.tif")], "fig int, member string, href string")
    assert {tuple(r) for r in M.choose_image(members, ["fig"], "member", "href", ["png", "jpg"]).collect()} == {(1, "f1.png"), (2, "g2x.png")}
    listed = spark.createDataFrame([("a/run_1/manifest.json",), ("a/run_smoke/manifest.json",), ("assets/manifest.json",)], "path string")
    assert M.manifest_files(listed, F.col("path"), ["assets"]).count() == 1
    assert M.one_figure(spark, "a.png", "my fig").first()["paper_id"] == "my_fig" and M.one_panel(spark, "a.png", "p").count() == 1


def test_typed(spark):
    df = spark.createDataFrame([("p", "3", "[1, 2, 3, 4]", "x", "True"), ("q", "no", "bad", None, "")], "paper_id string, figure_index string, bbox_xyxy string, other string, is_complete_panel string")
    rows = schemas.typed(df, "panels").collect()
    assert rows[0]["figure_index"] == 3 and rows[0]["bbox_xyxy"] == [1, 2, 3, 4] and rows[1]["figure_index"] is None and rows[1]["bbox_xyxy"] is None and rows[0]["doi"] is None
    assert [r["is_complete_panel"] for r in schemas.typed(df, "scores").collect()] == [True, None]


def test_resolved_paths(spark):
    files = spark.createDataFrame([("/r2/a.png",), ("/r1/b.png",), ("/r2/b.png",), ("c.png",)], "file string")
    df = spark.createDataFrame([("a.png",), ("b.png",), ("c.png",), ("d.png",), (None,)], "path string")
    got = {r["path"]: r["found"] for r in M.resolved(df, "path", files, "file", ["/r1", "/r2/"]).collect()}
    assert got == {"a.png": "/r2/a.png", "b.png": "/r1/b.png", "c.png": "c.png", "d.png": None, None: None}


def test_stream_state(spark, tmp_path):
    source, kept = str(tmp_path / "in"), []
    spark.createDataFrame([("a",), ("b",), ("a",)], "k string").write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        stream = state.read(spark, source, schema)
        q = state.into_state(stream, "k", str(tmp_path / "state"), str(tmp_path / "ck"), lambda df, _: kept.append(sorted(r[0] for r in df.collect())))
        q.awaitTermination(120)

    run()
    spark.createDataFrame([("b",), ("c",)], "k string").write.mode("append").parquet(source)
    run()
    assert kept == [["a", "b"], ["c"]]
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "state")).collect()) == ["a", "b", "c"]


def test_stream_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("select timestamp '2026-01-01 00:00:10' ts, 'v' kind, 2.0D value union all select timestamp '2026-01-01 00:00:20', 'v', 3.0D union all select timestamp '2026-01-01 01:00:00', 'v', 1.0D").coalesce(1).write.parquet(source)
    stream = state.read(spark, source, spark.read.parquet(source).schema)
    q = state.windowed(stream, "ts", ["kind"], "1 minute", "5 minutes", "value").writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["n"], r["total"]) for r in spark.sql("select * from win").collect()] == [(2, 5.0)]


def test_json_without_nan_at_any_depth(spark, tmp_path):

    df = spark.sql("select double('NaN') a, array(1.5D, double('Infinity')) b, named_struct('c', double('NaN'), 'd', array(named_struct('e', double('NaN')))) s, map('k', double('NaN')) m, cast(null as struct<x:double>) n, 'text' `odd.name`")
    M.write_json(df, str(tmp_path / "out"))
    [text] = [line for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert json.loads(text) == {"a": None, "b": [1.5, None], "s": {"c": None, "d": [{"e": None}]}, "m": {"k": None}, "n": None, "odd.name": "text"}
