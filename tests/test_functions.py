import math

from pyspark.sql import functions as F

from figmill.functions import casts, ids, jsonx, text


def values(spark, c, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(c(F.col("v"))).collect()]


def test_casts(spark):
    assert values(spark, casts.number_or_null, ["3.5", "not-a-number", " 9 ", "1_0", "3d", "", None]) == [3.5, None, 9.0, 10.0, None, None, None]
    assert math.isnan(values(spark, casts.number_or_null, ["nan"])[0])
    assert values(spark, casts.truthy, ["yes", "", "TRUE", "0", None, " y "]) == [True, False, True, False, False, True]
    assert values(spark, casts.number_unless_blank, ["null", "2", " "]) == [None, 2.0, None]
    assert values(spark, lambda c: casts.bounded(c, 0, 100), [float("nan"), 120.0, None, -1.0, float("inf")], "double") == [0, 100, 0, 0, 0]
    assert values(spark, lambda c: casts.clamped_high_nan(c, 0, 10), [float("nan"), 12.0, None], "double") == [10, 10, None]
    assert values(spark, casts.general_format, [7.9, 8.0, 0.0, 1234567.0, 0.00001234, None, -0.5, 123456.7], "double") == ["7.9", "8", "0", "1.23457e+06", "1.234e-05", None, "-0.5", "123457"]
    assert values(spark, casts.score_label, [9.0, 9.5, 10.0], "double") == ["9", "9.5", "10"]
    assert values(spark, casts.yes_no, ["YES", "false", "maybe", None]) == ["yes", "no", "no", "no"]


def test_ids(spark):
    assert values(spark, ids.slug, ["10.5555/AB.c-1", "--", "x" * 80]) == ["10-5555-ab-c-1", "item", "x" * 72]
    assert values(spark, ids.doi, ["https://doi.org/10.5555/AbC.1).", "10.5555%2Fx", "none", None, "100%"]) == ["10.5555/abc.1", "10.5555/x", "", "", ""]
    assert values(spark, ids.pmcid, ["see pmc1234567.", "x", None]) == ["PMC1234567", "", ""]
    assert values(spark, ids.doi_of_slug, ["10-5555-x-1__fig02_a", "no"]) == ["10.5555/x-1", ""]
    assert values(spark, ids.panel_id_in, ["runs/10-5555-x__fig02_a.png", "x"]) == ["10-5555-x__fig02_a", ""]
    assert values(spark, ids.safe_name, ["a b/c", " ", None]) == ["a_b_c", "unknown", "unknown"]
    assert values(spark, ids.safe_name_unicode, ["é a"]) == ["é_a"]
    assert ids.boolean_query([["a", "b"], [], ["c"]], "Title") == '("a"[Title] OR "b"[Title]) AND ("c"[Title])'


def test_caption_labels(spark):
    heads = values(spark, text.caption_labels, ["a. First one. b) Second; c, Third. Not d Fourth", "a – c Range. b Again.", "c-a Backwards. d Next", "Intro. e(x) in brackets. f lower case", "g-h. Both 1. i 2 j"])
    assert [h["labels"] for h in heads] == [["a", "b", "c"], ["a", "b", "c"], ["c", "d"], ["e"], ["g", "h", "i"]]
    assert heads[0]["segments"] == {"a": "a. First one.", "b": "b) Second;", "c": "c, Third. Not d Fourth"} and heads[1]["segments"]["b"] == "b Again."
    got = values(spark, text.caption_labels, ["a Sample sizes. b-d Grouped outcomes. e Final panel.", None, "No marks here", "a One. a Two."])
    assert got[0]["labels"] == list("abcde") and "Grouped outcomes" in got[0]["segments"]["c"]
    assert got[1]["labels"] == [] and got[2]["labels"] == []
    assert got[3]["labels"] == ["a"] and "Two" in got[3]["segments"]["a"]
    given = values(spark, lambda c: text.labels_or_given(F.lit("x, y"), c), ["a Wrong caption."])
    assert given == [["x", "y"]]


def test_search_text(spark):
    assert values(spark, lambda c: text.relevance("Bar", [(c, 10), (F.lit("bars"), 4)]), ["a bar", "no", None]) == [14, 4, 4]
    assert values(spark, lambda c: text.parsed_query(c), ["q=a%20b&sort=date", None])[0] == {"q": "a b", "sort": "date"}
    assert values(spark, lambda c: text.query_string({"q": c, "s": F.lit("x")}, {"q": "", "s": "x"}), ["a b", ""]) == ["q=a+b", ""]
    assert values(spark, lambda c: text.alias(c, {"zero_shot": "zero"}), ["Zero-Shot ", "other", None]) == ["zero", "other", None]
    assert values(spark, lambda c: text.rendered("<{a}> {b}", {"a": c, "b": F.lit(2)}), ["x", None]) == ["<x> 2", "<> 2"]
    assert values(spark, text.title_of_key, ["multi_line"]) == ["Multi Line"]


def test_json_and_code(spark):
    assert values(spark, jsonx.json_in, ['<think>{"a":0}</think> x ```json\n{"a": 1}\n``` y', 'text {"b": {"c": 2}} end', "none", None]) == ['{"a": 1}', '{"b": {"c": 2}}', None, None]
    assert values(spark, jsonx.json_in, ['```json\n{"a": {"b": 1}}```', '```json {"a" 1', '{"x": 1} ```json\n[1]\n``` {"y": 2}', "}{", "<think>no end {1}"]) == ['{"a": {"b": 1}}', None, '{"x": 1} ```json\n[1]\n``` {"y": 2}', None, "{1}"]
    got = values(spark, jsonx.code_in, ['{"code": "x = 1"}', "hi\n```\nshort\n```\n```python\nimport os\n```", "<code>y</code>", "Sure.\nimport re\nz", "plain"])
    assert [(r["strategy"], r["code"]) for r in got] == [("json", "x = 1"), ("python_fence", "import os"), ("tag", "y"), ("plain", "import re\nz"), ("plain", "plain")]


def test_score_record(spark):
    df = spark.sql("""select map('category', 'data_statistical', 'data_subtype', 'unknown_type', 'clarity_integrity_score', '12', 'data_purity_score', '11', 'confidence', '2',
        'code_reproducibility_score', '9.25', 'aesthetic_score', 'nan', 'overall_quality_score', '8.75', 'is_complete_panel', 'True', 'has_foreign_overlap', 'false', 'xy_label_complete', 'YES') r
        union all select map('category', 'schematic', 'data_subtype', 'bar', 'data_purity_score', '10')""")
    one, two = [r[0] for r in df.select(jsonx.score_record(F.col("r"), ["bar"])).collect()]
    assert (one["clarity_integrity_score"], one["data_purity_score"], one["confidence"], one["code_reproducibility_score"], one["aesthetic_score"]) == (10, 10, 1, 9.25, 10)
    assert one["data_subtype"] == "other_data_display" and one["xy_label_complete"] == "yes" and one["is_good_quality"]
    assert two["data_subtype"] is None and two["data_purity"] == "not_data_statistical" and two["data_purity_score"] is None


def test_severity(spark):
    flags = {"edit": F.lit(True), "text": F.lit(None).cast("boolean")}
    ranks = [("critical", ["edit"]), ("minor", ["text"])]
    assert values(spark, lambda c: jsonx.severity(c, flags, ranks), ["clean", "bad", None]) == ["clean", "critical", "critical"]
