import random

from pyspark.sql import functions as F

from figmill.llm import common, splits


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    by_record = {}
    for record, entity in edges:
        if record is not None and entity is not None:
            by_record.setdefault(record, []).append(entity)
            find(entity)
    for entities in by_record.values():
        for e in entities:
            parent[max(find(e), find(entities[0]))] = min(find(e), find(entities[0]))
    return {x: find(x) for x in parent}


def test_propagation_is_union_find(spark):
    rng = random.Random(3)
    edges = [(f"r{rng.randrange(60)}", f"e{rng.randrange(70):02d}") for _ in range(90)] + [(None, "x"), ("r", None), ("r1", "e01"), ("r1", "e01")]
    got = {r["entity"]: r["label"] for r in splits.propagate(spark.createDataFrame(edges, "record string, entity string")).collect()}
    assert got == components(edges)


def test_propagation_closes_chains(spark):
    names = [f"n{i:03d}" for i in range(40)]
    random.Random(1).shuffle(names)
    edges = [(f"r{i}", n) for i, pair in enumerate(zip(names, names[1:])) for n in pair]
    got = splits.propagate(spark.createDataFrame(edges, "record string, entity string")).select("label").distinct().collect()
    assert [r[0] for r in got] == ["n000"]


def test_empty_edges(spark):
    assert splits.propagate(spark.createDataFrame([], "record string, entity string")).count() == 0


PANELS = "paper_id string, doi string, pmcid string"


def test_articles(spark):
    rows = [
        ("10-5555-a-1", "10.5555/A-1", None),
        ("PMC12345678", None, ""),
        ("10.5555/a-1 ", "", "pmc12345678"),
        ("10-5555-a-12", "https://doi.example/10.5555/a-12", "PMC0"),
        ("odd name", "n/a", "null"),
        (None, None, None),
        ("10-5555-a-1", "10.5555/A-1", None),
    ]
    labels, homes = splits.articles(spark.createDataFrame(rows, PANELS))
    by = {r["entity"]: r["label"] for r in labels.collect()}
    assert by["d:10-5555-a-1"] == by["p:12345678"] != by["d:10-5555-a-12"]
    home = {r["label"]: r["home_id"] for r in homes.collect()}
    assert home[by["d:10-5555-a-1"]] == "10-5555-a-1" and home["r:odd name"] == "odd name" and len(home) == 3


def test_cut_slugs_meet(spark):
    doi = "10.5555/x-" + "y" * 80
    slug = doi.replace(".", "-", 1).replace("/", "-")[:72]
    keys = spark.createDataFrame([(doi,), (slug,)], "v string").select(common.doi_key(F.col("v"))).distinct()
    assert keys.count() == 1


def test_misplaced(spark):
    panels = spark.createDataFrame([("10-5555-a", "10.5555/a", "PMC11111111"), ("PMC11111111", None, None)], PANELS)
    samples = spark.createDataFrame(
        [("PMC11111111__fig01_a", 1), ("10-5555-a__fig01_a", 1), ("https_doi.example_10.5555_A__fig02_b", 1), ("10-5555-none__fig01_a", 1), ("unknown", 1), ("", 1), (None, 1), ("PMC11111111__fig01_a", 2), ("no prefix", 1)],
        "panel_id string, loaded_at int",
    )
    got = {tuple(r) for r in splits.misplaced(samples, panels).collect()}
    assert got == {("PMC11111111__fig01_a", "10-5555-a"), ("https_doi.example_10.5555_A__fig02_b", "10-5555-a")}
    assert splits.misplaced(samples.limit(0), panels).count() == 0 and splits.misplaced(samples, panels.limit(0)).count() == 0


def test_groups_are_whole_and_shares_near(spark):
    rng = random.Random(7)
    rows = [(f"g{g}", rng.choice(["a", "b", None]), rng.randrange(1, 4)) for g in range(3000) for _ in range(2)] + [("big", "a", 5000), (None, "a", 3)]
    df = spark.createDataFrame(rows, "group string, stratum string, n int")
    shares = [("train", 0.6), ("valid", 0.1), ("test", 0.3)]
    got = [tuple(r) for r in splits.split_groups(df, shares).collect()]
    split = dict(got)
    assert len(got) == len(split) == 3001
    total = sum(n for g, _, n in rows if g)
    for name, share in shares:
        for stratum in ("a", "b", None):
            whole = sum(n for g, s, n in rows if g and s == stratum)
            here = sum(n for g, s, n in rows if g and s == stratum and split[g] == name)
            assert abs(here / whole - share) < 0.03
        assert abs(sum(n for g, _, n in rows if g and split[g] == name) / total - share) < 0.01
    assert splits.split_groups(df.limit(0), shares).count() == 0


def test_skew_lookup(spark):
    left = spark.createDataFrame([("h", i) for i in range(500)] + [("c", 1), ("d", 2), (None, 3)], "k string, i int")
    right = spark.createDataFrame([("h", "H", 500), ("c", "C", 1)], "k string, v string, rows long")
    rows = common.skew_lookup(left, right, "k", "rows", 0.1).collect()
    assert len(rows) == 501 and {r["v"] for r in rows} == {"H", "C"}


def test_articles_that_panels_lacks_stay_whole(spark):
    """Every written form of a DOI or PMCID is one article, whether panels has it or not."""
    panels = [(f"10-5555-a{i}", f"10.5555/a{i}", None, 1, "a", 1) for i in range(30)] + [("PMC00000007", "10.5555/a7", None, 1, "b", 2)]
    df = spark.createDataFrame(panels, "paper_id string, doi string, pmcid string, figure_index int, panel_label string, panel_ordinal int")
    ids = [f"{form.format(i, chr(97 + i))}__fig0{k}_a" for i in range(20) for k, form in enumerate(("10-5555-zz{1}{1}", "https_doi.org_10.5555_ZZ{1}{1}", "doi_10.5555_zz{1}{1}", "PMC123456{0:02d}", "pmc-123456{0:02d}"), 1)]
    samples = spark.createDataFrame([(x, "bio", 1) for x in ids] + [("no prefix", "bio", 1), ("unknown", "bio", 1)], "panel_id string, subject string, loaded_at int")
    names = spark.createDataFrame([("bio",)], "subject string")
    targets = spark.createDataFrame([("train", 600), ("valid", 200), ("test", 200)], "split_name string, share_permille int")
    assigned = splits.article_splits(df, samples, names, targets)
    got = {r["panel_id"]: r["split_name"] for r in assigned.collect()}
    assert len(got) == 31 + len(ids) + 1
    for i in range(20):
        assert len({got[x] for x in ids[5 * i : 5 * i + 3]}) == 1 and len({got[x] for x in ids[5 * i + 3 : 5 * i + 5]}) == 1
    assert got["10-5555-a7__fig01_a"] == got["PMC00000007__fig01_b"]
    report = {r["split_name"]: r for r in splits.split_report(assigned, df, targets).collect()}
    assert set(report) == {"train", "valid", "test"} and all(r["torn"] == 0 for r in report.values()) and sum(r["records"] for r in report.values()) == len(got)
    torn = spark.createDataFrame([("10-5555-zzaa__fig01_a", "train"), ("doi_10.5555_zzaa__fig03_a", "test")], "panel_id string, split_name string")
    assert {r["split_name"]: r["torn"] for r in splits.split_report(torn, df, targets).collect()} == {"train": 1, "test": 1, "valid": 0}
