"""Articles as XML texts: metadata, dates, figures and package links, all by XPath expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TYPES = ["epub", "ppub", "collection", "pmc-release"]


def text_at(xml: Column, path: str) -> Column:
    """Text of the first node at a path with white space runs as one space; empty if there is none."""
    return F.trim(F.regexp_replace(F.coalesce(F.xpath_string(xml, F.lit(path)), F.lit("")), r"(?U)\s+", " "))


def publication_date(xml: Column) -> Column:
    """Struct of year and date of the preferred publication date that has a year.

    Months and days of one digit get a zero; absent ones are 00, so a date is a text and may be no day of a calendar.
    """
    dates = []
    for kind in [f"[@pub-type='{k}']" for k in DATE_TYPES] + ["[year]"]:
        node = f"//article-meta/pub-date{kind}[year != '']"
        year = text_at(xml, f"({node})[1]/year")
        part = lambda name: F.lpad(text_at(xml, f"({node})[1]/{name}"), 2, "0")  # noqa: E731, B023
        dates.append(F.when(year != "", F.struct(year.alias("year"), F.concat_ws("-", year, part("month"), part("day")).alias("date"))))
    return F.coalesce(*dates, F.struct(F.lit("").alias("year"), F.lit("").alias("date")))


def figures(xml: Column, most: int = 1_000_000) -> Column:
    """Array of (figure_index, label, caption, member) of the figures of the body, numbered from 1.

    The body is first cut into its fig elements, each of which is then read for itself, so that a figure without a
    label, or a caption with paragraphs and markup, shifts no other. Absent labels and captions are empty. Figures without an image,
    and those whose image was named before, are left out.
    """
    body = F.regexp_extract(F.coalesce(xml, F.lit("")), r"(?s)<body[\s>].*</body>", 0)
    each = F.regexp_extract_all(body, F.lit(r"(?s)<fig(?:\s[^>]*)?>.*?</fig>"), F.lit(0))
    each = F.transform(each, lambda f: F.regexp_replace(f, r"\s[A-Za-z]+:href=", " href="))  # a piece doesn't declare its prefixes
    rows = F.transform(each, lambda f: F.struct(text_at(f, "/fig/label").alias("label"), text_at(f, "/fig/caption").alias("caption"), F.xpath_string(f, F.lit("(/fig//graphic)[1]/@href")).alias("member")))
    rows = F.filter(rows, lambda r: F.coalesce(r["member"], F.lit("")) != "")
    members = F.transform(rows, lambda r: r["member"])
    kept = F.slice(F.filter(rows, lambda r, i: F.array_position(members, r["member"]) == i + 1), 1, most)
    return F.transform(kept, lambda r, i: F.struct((i + 1).alias("figure_index"), r["label"].alias("label"), r["caption"].alias("caption"), r["member"].alias("member")))


def package(xml: Column) -> Column:
    """Struct of link, license and citation of a package record: the first tgz link; null if there is none or it is retracted."""
    link = text_at(xml, "(//record/link[@format='tgz'])[1]/@href")
    retracted = F.lower(text_at(xml, "(//record)[1]/@retracted")) == "yes"
    https = F.regexp_replace(link, "^ftp://", "https://")
    return F.when((link != "") & ~retracted, F.struct(https.alias("link"), text_at(xml, "(//record)[1]/@license").alias("license"), text_at(xml, "(//record)[1]/@citation").alias("citation")))


def media_urls(base: str, doi: Column, stem: Column, extensions: list[str]) -> Column:
    """The places an image may be at, best first."""
    return F.array(*[F.concat(F.lit(base), F.url_encode(doi), F.lit("/"), stem, F.lit("."), F.lit(e)) for e in extensions])
