"""Queries that are to read all texts and rows there are."""

from figmill.plans.catalogue import QUERIES


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, section string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_code_outside_its_section(spark, tmp_path):
    code = "import numpy as np\nax.plot(np.arange(3))\nfig.savefig('a.png')"
    rows = [(1, code, "code"), (2, "The curve rises.", "caption"), (3, code, "web_page"), (4, f"See this:\n```python\n{code}\n```\n", None), (5, "import (", "readme"), (6, None, "code"), (7, "plt.imread('b.png')", None)]
    d = documents(spark, tmp_path, rows)
    errors = dict(map(tuple, QUERIES["code_compiles"](spark, d).collect()))
    assert set(errors) == {1, 2, 3, 4, 5, 7} and {i for i, e in errors.items() if e is None} == {1, 3, 4, 7}
    alike = dict(map(tuple, QUERIES["code_similarity"](spark, d).collect()))
    assert set(alike) == {3, 4, 5, 7} and alike[3] == alike[4] == 100.0
    marks = {r["doc_id"]: (r["has_save"], r["loads"]) for r in QUERIES["code_predicates_all"](spark, d).collect()}
    assert marks == {1: (True, False), 2: (False, False), 3: (True, False), 4: (True, False), 5: (False, False), 7: (False, True)}


def test_findings_up_to_the_bound(spark, tmp_path):
    d = documents(spark, tmp_path, [(1, "import a\n" * 25, "code"), (2, "x\n" + "import a\n" * 90, "web_page")])
    lines = {}
    for r in QUERIES["line_findings_all"](spark, d).collect():
        lines.setdefault(r["doc_id"], []).append(r["line"])
    assert {i: sorted(n) for i, n in lines.items()} == {1: list(range(1, 26)), 2: list(range(2, 82))}


def test_casts_of_all_texts(spark, tmp_path):
    spark.createDataFrame([(i, None if i == 16 else 1e-5) for i in range(17)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: (r["number"], r["truth"]) for r in QUERIES["lenient_casts_all"](spark, str(tmp_path)).collect()}
    one = [(1e-5, False), (9.0, False), (None, False), (None, True), (None, False), (1.0, True), (-0.0025, False), (None, False)]
    assert got == dict(enumerate([*one, *one, (None, False)]))
