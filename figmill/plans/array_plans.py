"""Vector metrics, composite scores and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.operators import arrays as V
from figmill.operators import geometry as G
from figmill.operators import joins
from figmill.plans.registry import query
from figmill.sources.tables import table

_PAIRS = "(select a.vec_id, a.embedding::double[] x, b.embedding::double[] y, a.label la, b.label lb from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"), F.col("label").alias("lb"))
    return e.select("vec_id", F.col("embedding").alias("x"), F.col("label").alias("la")).join(nxt, "vec_id")


_D = "list_transform(list_zip(x, y), lambda p: p[1] - p[2])"
_NCC = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - list_avg(x)) * (p[2] - list_avg(y)))) / sqrt(list_sum(list_transform(x, lambda v: (v - list_avg(x)) ** 2)) * list_sum(list_transform(y, lambda v: (v - list_avg(y)) ** 2)))"


@query(
    f"""select vec_id, round(mae, 4) mae, round(mse, 4) mse, round(sqrt(mse), 4) rmse, round(case when mse = 0 then 100 else 20 * log10(255.0 / sqrt(mse)) end, 4) psnr, round(ncc, 4) ncc, round(greatest(0, 1 - mae / 255), 4) l1 from (
        select vec_id, list_avg(list_transform({_D}, lambda v: abs(v))) mae, list_avg(list_transform({_D}, lambda v: v * v)) mse, {_NCC} ncc from {_PAIRS})"""
)
def vector_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = _pairs(spark, d).select("vec_id", V.vector_metrics(F.col("x"), F.col("y")).alias("m"))
    return out.select("vec_id", *[F.round(f"m.{c}", 4).alias(c) for c in ("mae", "mse", "rmse", "psnr", "ncc")], F.round("m.l1_similarity", 4).alias("l1"))


_BITS = "list_transform({0}, lambda v: (v >= list_avg({0}))::int)"


@query(f"select vec_id, list_sum(list_transform(list_zip({_BITS.format('x')}, {_BITS.format('y')}), lambda p: (p[1] <> p[2])::int))::bigint distance from {_PAIRS}")
def mean_bit_distance(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", V.hamming(V.mean_bits(F.col("x")), V.mean_bits(F.col("y"))).cast("long").alias("distance"))


@query(
    f"""select vec_id, round(case when u = 0 then 1.0 else i / u end, 6) iou from (select vec_id, list_sum(list_transform(list_zip(x, y), lambda p: (p[1] < 0 and p[2] < 0)::int))::double i,
    list_sum(list_transform(list_zip(x, y), lambda p: (p[1] < 0 or p[2] < 0)::int))::double u from {_PAIRS})"""
)
def mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.round(V.mask_iou(F.col("x"), F.col("y"), 0.0), 6).alias("iou"))


_C = "case when {0} is null or isnan({0}) then null else greatest(0, least(10, {0})) / 10 end"


@query(
    f"""select panel_id, scored_at, round(greatest(0, least(100, coalesce(100 * list_avg(list_filter([{_C.format("clarity_integrity_score")}, {_C.format("aesthetic_score")}, {_C.format("data_purity_score")}], lambda v: v is not null)), 0)
    + case when coalesce(is_complete_panel, false) then 6 else 0 end)), 4) score, greatest(0, least(100, 50.0 + case lower(xy_label_complete) when 'yes' then 3 when 'no' then -5 else 0 end + case lower(xytick_complete) when 'yes' then 3 when 'no' then -5 else 0 end))::double labels
    from qwen_panel_scoring where coalesce(clarity_integrity_score, aesthetic_score, data_purity_score) is not null"""
)
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean of what is there with a bonus and bounds, and a score moved by yes and no."""
    s = table(spark, d, "qwen_panel_scoring")
    share = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col(c))) / 10)
    columns = ("clarity_integrity_score", "aesthetic_score", "data_purity_score")
    score = V.visual_score([share(c) for c in columns], F.when(F.coalesce("is_complete_panel", F.lit(False)), 6.0).otherwise(0.0))
    s = s.where(F.coalesce(*columns).isNotNull())
    return s.select("panel_id", "scored_at", F.round(score, 4).alias("score"), V.label_adjusted(F.lit(50.0), F.col("xy_label_complete"), F.col("xytick_complete")).alias("labels"))


@query("select event_id, (case when value is null then 75.0 when value <= 5 then 100.0 when value <= 30 then 90.0 when value <= 120 then 70.0 else 45.0 end)::double score from events")
def stepped_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.stepped(F.col("value"), [(5, 100.0), (30, 90.0), (120, 70.0)], 45.0, 75.0).alias("score"))


_TOKENS = {"numpy": 10.0, "pyplot": 10.0, "pandas": 10.0, "seaborn": 10.0, "savefig": 15.0}


@query(f"select doc_id, case when coalesce(text, '') = '' then 0.0 else least(100, 35.0 + {' + '.join(f"case when contains(text, '{w}') then {p} else 0 end" for w, p in _TOKENS.items())}) end::double score from documents")
def library_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.words_score(F.col("text"), 35.0, _TOKENS).alias("score"))


_KINDS = {"data": ["chart", "plot", "fit"], "scheme": ["schematic", "workflow"], "photo": ["image", "cells"]}
_COUNT = {k: " + ".join(f"(instr(lower(coalesce(caption, '')), '{w}') > 0)::int" for w in ws) for k, ws in _KINDS.items()}


@query(f"select panel_id, loaded_at, case when a >= b and a >= c and a >= 0.8 then 'data' when b >= c and b >= 0.8 then 'scheme' when c >= 0.8 then 'photo' else 'other' end kind from (select panel_id, loaded_at, ({_COUNT['data']}) * 1.4 a, ({_COUNT['scheme']}) * 1.6 b, ({_COUNT['photo']}) * 1.5 c from samples)")
def keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of the greatest weighted keyword count, the first named on a tie."""
    from figmill.functions.text import keyword_count

    n = {k: keyword_count(F.col("caption"), ws) for k, ws in _KINDS.items()}
    best = V.best_of({"data": n["data"] * 1.4, "scheme": n["scheme"] * 1.6, "photo": n["photo"] * 1.5, "other": F.lit(0.8)})
    return table(spark, d, "samples").select("panel_id", "loaded_at", best["name"].alias("kind"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Panel boxes of figures, each once, with its confidence."""
    b = table(spark, d, "panels").select("paper_id", "figure_index", G.parsed(F.col("bbox_xyxy")).alias("b"), "codex_confidence").where("b is not null")
    rows = b.select("paper_id", "figure_index", *[F.col("b")[i].cast("int").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], F.coalesce("codex_confidence", F.lit(0.0)).alias("confidence"))
    return rows.groupBy("paper_id", "figure_index", "x0", "y0", "x1", "y1").agg(F.max("confidence").alias("confidence"))


@query(
    """select distinct bbox_xyxy, (b[3] - b[1]) * (b[4] - b[2]) area from (select bbox_xyxy, from_json(nullif(bbox_xyxy, ''), '["INTEGER"]') b from panels where bbox_xyxy is not null)
    where len(b) = 4 and b[1] >= 0 and b[2] >= 0 and b[3] <= 1600 and b[4] <= 1600 and b[3] - b[1] >= 20 and b[4] - b[2] >= 20"""
)
def strict_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "panels").where("bbox_xyxy is not null").select("bbox_xyxy", G.strict(G.parsed(F.col("bbox_xyxy")), F.lit(1600), F.lit(1600)).alias("b")).where("b is not null")
    return rows.select("bbox_xyxy", ((F.col("b")[2] - F.col("b")[0]) * (F.col("b")[3] - F.col("b")[1])).alias("area")).distinct()


_BOXES = """(select paper_id, figure_index, b[1] x0, b[2] y0, b[3] x1, b[4] y1, max(coalesce(codex_confidence, 0)) c from (select *, from_json(nullif(bbox_xyxy, ''), '["INTEGER"]') b from panels where bbox_xyxy is not null) where len(b) = 4 group by all)"""


@query(f"select paper_id, figure_index, greatest(0, min(x0) - 10) x0, greatest(0, min(y0) - 10) y0, least(2000, max(x1) + 10) x1, least(2000, max(y1) + 10) y1 from {_BOXES} group by 1, 2")
def figure_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).groupBy("paper_id", "figure_index").agg(*G.union_box(10, F.lit(2000), F.lit(2000)))


_KEY = "(not (900 between x0 and x1 and 500 between y0 and y1)), case when 900 between x0 and x1 and 500 between y0 and y1 then -c else sqrt((900 - x0) ** 2 + (500 - y0) ** 2) end, x0, y0, x1, y1"


@query(f"select paper_id, figure_index, x0, y0, x1, y1 from (select *, row_number() over (partition by paper_id, figure_index order by {_KEY}) k from {_BOXES}) where k = 1")
def nearest_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box around a point of each figure, else the nearest."""
    b = _boxes(spark, d)
    box = F.struct("x0", "y0", "x1", "y1")
    order = [F.asc("cost"), *[F.asc(c) for c in ("x0", "y0", "x1", "y1")]]
    scored = b.withColumn("cost", G.nearest_cost(F.lit(900), F.lit(500), box, F.col("confidence")))
    return joins.one_per_key(scored, ["paper_id", "figure_index"], order).select("paper_id", "figure_index", "x0", "y0", "x1", "y1")


@query()
def greedy_suppression(spark: SparkSession, d: str) -> DataFrame:
    return G.suppressed(_boxes(spark, d), ["paper_id", "figure_index"], 0.8)


@query()
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return G.reading_order(_boxes(spark, d), ["paper_id", "figure_index"])


@query()
def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of each figure merged until four are left."""
    return G.merged_to(_boxes(spark, d).withColumn("most", F.lit(4)), ["paper_id", "figure_index"], "most")
