"""Metrics of numeric arrays and composite scores, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from figmill.functions.casts import bounded


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def vector_metrics(a: Column, b: Column, peak: float = 255.0) -> Column:
    """Struct of mae, mse, rmse, psnr (100 for equal arrays), ncc (null without variance) and l1_similarity.

    Arrays of different or no length give null.
    """
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    mae = total(F.transform(d, F.abs)) / F.size(a)
    mse = total(F.transform(d, lambda x: x * x)) / F.size(a)
    ma, mb = mean(a), mean(b)
    ca, cb = F.transform(a, lambda x: x.cast("double") - ma), F.transform(b, lambda x: x.cast("double") - mb)
    norm = F.sqrt(total(F.transform(ca, lambda x: x * x)) * total(F.transform(cb, lambda x: x * x)))
    ncc = F.when(norm > 0, total(F.zip_with(ca, cb, lambda x, y: x * y)) / norm)
    psnr = F.when(mse == 0, 100.0).otherwise(20 * F.log10(peak / F.sqrt(mse)))
    out = F.struct(mae.alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), psnr.alias("psnr"), ncc.alias("ncc"), F.greatest(F.lit(0.0), 1 - mae / peak).alias("l1_similarity"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), out)


def mean_bits(a: Column) -> Column:
    """Text of 0 and 1: whether each value is at least the mean."""
    m = mean(a)
    return F.array_join(F.transform(a, lambda x: F.when(x.cast("double") >= m, "1").otherwise("0")), "")


def hamming(a: Column, b: Column) -> Column:
    """How many places two texts of equal length differ in."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))


def mask_iou(a: Column, b: Column, below: float) -> Column:
    """Overlap of the places below a value: intersection over union, 1 if there are none."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x < below).alias("x"), (y < below).alias("y")))
    union = F.size(F.filter(pairs, lambda p: p["x"] | p["y"]))
    return F.when(union == 0, 1.0).otherwise(F.size(F.filter(pairs, lambda p: p["x"] & p["y"])) / union)


def visual_score(parts: list[Column], bonus: Column) -> Column:
    """Mean of the parts (each 0 to 1) that are not null, of 100, with a bonus, within 0 and 100."""
    values = F.array_compact(F.array(*parts))
    return bounded(F.when(F.size(values) > 0, 100 * total(values) / F.size(values) + bonus).otherwise(0.0), 0.0, 100.0)


def size_match(width: Column, height: Column, other_width: Column, other_height: Column) -> Column:
    """A third each for equal width, equal height and near aspect ratio."""
    aspect = F.abs(other_width / other_height - width / height)
    return ((width == other_width).cast("double") + (height == other_height).cast("double") + F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), aspect))) / 3


def stepped(value: Column, steps: list[tuple[float, float]], beyond: float, missing: float) -> Column:
    """The score of the first step that value is at most."""
    out = F.when(value.isNull() | F.isnan(value), missing)
    for high, score in steps:
        out = out.when(value <= high, score)
    return out.otherwise(beyond)


def label_adjusted(score: Column, *answers: Column, gain: float = 3.0, loss: float = 5.0) -> Column:
    """Score raised for each yes and lowered for each no."""
    for a in answers:
        word = F.lower(F.coalesce(a, F.lit("")))
        score = score + F.when(word == "yes", gain).when(word == "no", -loss).otherwise(0.0)
    return bounded(score, 0.0, 100.0)


def words_score(text: Column, base: float, words: dict[str, float]) -> Column:
    """Base and the points of each word that the text has, within 0 and 100; 0 for no text."""
    gained = sum((F.when(text.contains(w), p).otherwise(0.0) for w, p in words.items()), F.lit(base))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(bounded(gained, 0.0, 100.0))


def best_of(scores: dict[str, Column]) -> Column:
    """Struct of the name of the greatest score (the first named on a tie) and a confidence from its lead."""
    names = list(scores)
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(scores[n].alias("score"), F.lit(-i).alias("first"), F.lit(n).alias("name")) for i, n in enumerate(names)])))
    lead = (ranked[0]["score"] - ranked[1]["score"] + 1.0) / 4.0
    return F.struct(ranked[0]["name"].alias("name"), F.greatest(F.lit(0.2), F.least(F.lit(0.95), lead)).alias("confidence"))
