"""The pN queries against their SQL on the smallest data."""

import pytest
from conftest import DATA, same_rows

from figmill.llm.queries import QUERIES
from figmill.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name, tmp_path):
    one, two = same_rows(spark, duck, QUERIES[name], SQL[name], tmp_path)
    assert not one[:3] and not two[:3]


def test_splits_keep_articles_whole(spark, duck):
    rows = QUERIES["p1_splits"](spark, DATA).collect()
    ids = [r["panel_id"] for r in rows]
    assert len(ids) == len(set(ids)) and {r["split_name"] for r in rows} <= {"train", "validation", "test"}
    by_prefix = {}
    for r in rows:
        by_prefix.setdefault(r["panel_id"].rpartition("__fig")[0].lower().strip("_-"), set()).add(r["split_name"])
    assert all(len(s) == 1 for s in by_prefix.values())


def test_sample_and_report(spark):
    report = {r["quota_no"]: r for r in QUERIES["p3_report"](spark, DATA).collect()}
    assert len(report) == 147
    assert all(r["drawn"] >= min(r["needed"], r["available"]) and r["gap"] == max(0, r["needed"] - r["drawn"]) for r in report.values())
    sample = [tuple(r) for r in QUERIES["p3_sample"](spark, DATA).collect()]
    assert len(sample) == len(set(sample))


def test_closest_cutoffs(spark):
    rows = QUERIES["p5_closest"](spark, DATA).collect()
    assert rows and all(0 < r["kept"] <= r["scored"] for r in rows)


def test_packed(spark):
    report = QUERIES["p7_report"](spark, DATA).first()
    assert report["least"] <= report["containers"] <= report["least"] * 1.05 + 2


def test_stuffed(spark):
    assert QUERIES["p8_found"](spark, DATA).columns == ["doc_id"]
