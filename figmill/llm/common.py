"""Identifiers, labels, scores and records as the operators of this subpackage read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.operators.joins import broadcast_if_small, skew_lookup  # noqa: F401

#: A paper id made from a DOI is cut at this many characters, so all forms are compared up to here.
SLUG_LENGTH = 72


def _slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def doi_key(c: Column) -> Column:
    """One key for all written forms of a DOI (URL, doi:, slug, any case or separators), else null."""
    found = F.regexp_extract(_slug(c), r"(?:^|-)(10-[0-9]{4,9}-[a-z0-9].*)$", 1)
    return F.when(found != "", F.concat(F.lit("d:"), F.rtrim(F.left(found, F.lit(SLUG_LENGTH)), F.lit("-"))))


def pmcid_key(c: Column) -> Column:
    """One key for all written forms of an eight-digit PMCID, else null (fillers such as PMC0 name nothing)."""
    found = F.regexp_extract(_slug(c), r"^(?:(?:.*-)?pmc-?)?([0-9]{8})$", 1)
    return F.when((found != "") & (found != "00000000"), F.concat(F.lit("p:"), found))


def paper_key(c: Column) -> Column:
    """The DOI or else the PMCID that an id names, else null."""
    return F.coalesce(doi_key(c), pmcid_key(c))


def panel_id() -> Column:
    """panel_id of a panels row; null where paper_id, figure_index or both label and ordinal are null."""
    label = F.coalesce(F.nullif("panel_label", F.lit("")), F.concat(F.lit("panel"), F.col("panel_ordinal")))
    figure = F.col("figure_index").cast("string")
    figure = F.when(F.length(figure) < 2, F.lpad(figure, 2, "0")).otherwise(figure)
    raw = F.concat("paper_id", F.lit("__fig"), figure, F.lit("_"), label)
    return F.regexp_replace(raw, "[^A-Za-z0-9_.-]+", "_")


def before_fig(c: Column) -> Column:
    """The text before the last __fig of a panel_id; null where there is none."""
    return F.when(c.contains("__fig"), F.regexp_extract(c, r"(?s)^(.*)__fig", 1))


def row_keys() -> Column:
    """The distinct entity keys of a panels row in order; its own paper_id where it names neither DOI nor PMCID."""
    named = F.array_compact(F.array(paper_key(F.col("paper_id")), doi_key(F.col("doi")), pmcid_key(F.col("pmcid"))))
    own = F.array_compact(F.array(F.concat(F.lit("r:"), F.col("paper_id"))))
    return F.when(F.size(named) > 0, F.array_sort(F.array_distinct(named))).otherwise(own)


def label_key(c: Column) -> Column:
    """A label without case, character width, spacing and separators.

    Full-width ASCII (U+FF01 to U+FF5E) maps to ASCII; camelCase needs no split as separators are dropped anyway.
    """
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.regexp_replace(F.lower(F.translate(c, wide, "".join(map(chr, range(0x21, 0x7F))))), r"[^\p{L}\p{N}]+", "")


def known_names(targets: DataFrame, column: str, most: int = 10_000) -> dict[str, str]:
    """label key -> known name. The list of known names is a small table of its own; more than ``most`` is an error."""
    rows = targets.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column}: more than {most} known names")
    from_key = {}
    for name in sorted(r[0] for r in rows):
        folded = name.translate({w: w - 0xFEE0 for w in range(0xFF01, 0xFF5F)}).lower()
        from_key["".join(x for x in folded if x.isalnum())] = name
    return from_key


def to_known(c: Column, names: dict[str, str]) -> Column:
    """The known name a label names, else null."""
    if not names:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for pair in sorted(names.items()) for x in pair]
    return F.try_element_at(F.create_map(*pairs), label_key(c))


def panel_scores(scores: DataFrame) -> DataFrame:
    """panel_id, score: of each panel the row of the latest scored_at among those neither null nor NaN, in 0 to 10.

    A null scored_at counts as earliest; of rows of one scored_at the later ingested, then higher score counts.
    """
    s = F.col("overall_quality_score").cast("double")
    usable = scores.where(F.col("panel_id").isNotNull() & s.isNotNull() & ~F.isnan(s))
    last = F.max(F.struct("scored_at", "ingested_at", s.alias("s")))
    return usable.groupBy("panel_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(10.0), last["s"])).alias("score"))


def records(samples: DataFrame, columns: list[str]) -> DataFrame:
    """panel_id and ``columns`` of each record: the row of a panel_id with the latest loaded_at.

    Null, empty and ``unknown`` panel_ids are no records. A null loaded_at counts as earliest; ties fall to the
    greatest values of ``columns``.
    """
    real = samples.where(F.col("panel_id").isNotNull() & ~F.trim("panel_id").isin("", "unknown"))
    last = F.max(F.struct("loaded_at", *columns))
    return real.groupBy("panel_id").agg(last.alias("last")).select("panel_id", *[F.col("last")[c].alias(c) for c in columns])


LEVELS = ["complexity_level", "threshold_complexity_level", "original_complexity_level"]


def labelled(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """panel_id, subject, subtype, complexity_level of each record as known names, null where a label names none."""
    names = {c: known_names(targets, c) for c in ("subject", "subtype", "complexity_level")}
    return records(samples, ["subject", "subtype", *LEVELS]).select(
        "panel_id",
        to_known(F.col("subject"), names["subject"]).alias("subject"),
        to_known(F.col("subtype"), names["subtype"]).alias("subtype"),
        F.coalesce(*[to_known(F.col(c), names["complexity_level"]) for c in LEVELS]).alias("complexity_level"),
    )
