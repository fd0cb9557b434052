"""Identifiers of articles, figures and panels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from figmill.functions.casts import or_else


def slug(c: Column, fallback: str = "item", most: int = 72) -> Column:
    """Lower-case letters and digits joined by hyphens, cut at ``most`` characters."""
    made = F.lower(F.trim(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), F.lit("-")))
    return F.coalesce(F.nullif(F.substring(made, 1, most), F.lit("")), F.lit(fallback))


def safe_name(c: Column, fallback: str = "unknown") -> Column:
    """Runs of characters outside A-Z, a-z, 0-9, _ . - become one underscore."""
    return F.regexp_replace(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(fallback)), "[^A-Za-z0-9_.-]+", "_")


def safe_name_unicode(c: Column) -> Column:
    """Every character but letters and digits of any script and . _ - becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def safe_file_name(c: Column, fallback: str = "sample", most: int = 160) -> Column:
    made = F.trim(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), F.lit("._-"))
    return F.substring(F.coalesce(F.nullif(made, F.lit("")), F.lit(fallback)), 1, most)


def doi(c: Column) -> Column:
    """The DOI a text holds, in lower case; empty if there is none. URL escapes are decoded if valid."""
    text = F.trim(F.coalesce(F.try_url_decode(c), c, F.lit("")))
    found = F.regexp_extract(text, r"(?i)(10\.[0-9]{4,9}/[^\s?#<>]+)", 1)
    return F.lower(F.regexp_replace(found, r"""[.,;)\]}"']+$""", ""))


def doi_as_written(c: Column) -> Column:
    """A DOI without its resolver prefix, case kept."""
    return F.trim(F.regexp_replace(F.coalesce(F.try_url_decode(c), c), r"(?i)^\s*(?:https?://(?:dx\.)?doi\.[a-z]+/|doi:\s*)", ""))


def pmcid(c: Column) -> Column:
    """The first PMC number of a text in upper case; empty if there is none."""
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b(PMC[0-9]+)\b", 1))


def pmcid_or_digits(c: Column) -> Column:
    """PMC and the first run of digits; the text itself if it has none."""
    digits = F.regexp_extract(c, r"(?i)(?:PMC)?([0-9]+)", 1)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits)).otherwise(c)


def doi_of_slug(c: Column) -> Column:
    """10-5555-x as 10.5555/x. A slug has lost dots, slashes and what was cut, so this is a guess."""
    head = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^\s*(.*?)(?:__.*)?\s*$", 1)
    number, rest = F.regexp_extract(head, "(?i)(10-([0-9]{4,9})-([A-Za-z0-9-]+))", 2), F.regexp_extract(head, "(?i)(10-([0-9]{4,9})-([A-Za-z0-9-]+))", 3)
    return F.when(number != "", F.concat(F.lit("10."), number, F.lit("/"), rest)).otherwise("")


def panel_id_in(c: Column) -> Column:
    """The panel id a text or path holds, without an image or JSON suffix; empty if there is none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"([A-Za-z0-9][A-Za-z0-9.-]*__fig[0-9]+_[A-Za-z0-9_.-]+)", 1)
    return F.regexp_replace(found, r"(?i)\.(?:png|pdf|json|jpe?g|tiff?)$", "")


def figure_id(paper: Column, index: Column) -> Column:
    return F.concat(paper, F.lit("__fig"), F.lpad(index.cast("string"), 2, "0"))


def panel_id(paper: Column, index: Column, label: Column, ordinal: Column) -> Column:
    """paper__figNN_label, where an absent label is panelN; other characters become underscores."""
    name = or_else(label, F.concat(F.lit("panel"), F.coalesce(ordinal.cast("string"), F.lit(""))))
    shown = F.when(F.length(index.cast("string")) < 2, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    return F.regexp_replace(F.concat(paper, F.lit("__fig"), shown, F.lit("_"), name), "[^A-Za-z0-9_.-]+", "_")


def safe_label(label: Column, ordinal: Column) -> Column:
    """A single letter or panelN stays (lower case); anything else becomes panelNN of the ordinal."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(low.rlike("^(?:[a-z]|panel[0-9]{1,3})$"), low).otherwise(F.concat(F.lit("panel"), F.lpad(ordinal.cast("string"), 2, "0")))


def search_clause(doi_value: Column, pmcid_value: Column, url: Column, query: Column) -> Column:
    """A literature search clause: DOI before PMCID before what a URL names before free text."""
    by_doi = lambda d: F.concat(F.lit('"'), d, F.lit('"[DOI]'))
    by_pmc = lambda p: F.concat(p, F.lit("[PMCID]"))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(by_doi(some(doi(doi_value))), by_pmc(some(pmcid(pmcid_value))), by_doi(some(doi(url))), by_pmc(some(pmcid(url))), some(F.trim(query)))


def boolean_query(groups: list[list[str]], field: str) -> str:
    """(a[f] OR b[f]) AND (c[f]): the AND of the OR of each group; empty groups are left out."""
    quoted = [[f'"{term}"[{field}]' for term in g] for g in groups if g]
    return " AND ".join("(" + " OR ".join(g) + ")" for g in quoted)
