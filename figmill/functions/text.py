"""Captions, keywords, search and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = "labels array<string>, segments map<string,string>"


def one_line(c: Column) -> Column:
    """White space runs as one space, en and em dashes as hyphens."""
    return F.trim(F.regexp_replace(F.translate(c, "–—", "--"), r"(?U)\s+", " "))


def _char(c: Column) -> Column:
    return F.substring(c, 1, 1)


def _after(c: Column) -> Column:
    return F.ltrim(F.substr(c, F.lit(2)))


def _mark(sentence: Column) -> Column:
    """Struct of the first and last letter that a sentence's head names, null where it is none.

    A head is a small letter, or two with a hyphen between, perhaps a comma, dot or bracket, and then a capital, digit or bracket.
    """
    text = F.ltrim(sentence)
    rest = _after(text)
    other = F.ltrim(F.substr(rest, F.lit(2)))
    ranged = rest.startswith("-") & _char(other).rlike("[a-z]")
    rest = F.when(ranged, _after(other)).otherwise(rest)
    rest = F.when(_char(rest).isin(",", ".", ")"), _after(rest)).otherwise(rest)
    is_mark = _char(text).rlike("[a-z]") & _char(rest).rlike("[A-Z0-9(]")
    return F.when(is_mark, F.struct(_char(text).alias("first"), F.when(ranged, _char(other)).otherwise(_char(text)).alias("last")))


def caption_labels(c: Column) -> Column:
    """Struct of the labels of a caption in order of first mention and a map of label to its part of the caption.

    A caption is read sentence by sentence (up to a dot or semicolon; the dot of a lone mark such as "a." ends none).
    A sentence that begins with a mark starts a part, which goes on until the next such sentence. A range a-d names
    four labels. A label named twice keeps its last part. A null caption gives no labels.
    """
    text = one_line(F.coalesce(c, F.lit("")))
    sentences = F.split(text, r"(?<=[.;])(?<!(?:^|[.;]|[.;] )[a-z]\.)(?<!(?:^|[.;]|[.;] )[a-z] ?- ?[a-z]\.)")
    none = F.array().cast("array<struct<mark:struct<first:string,last:string>,value:string>>")

    def add(parts: Column, s: Column) -> Column:
        mark, last = _mark(s), F.element_at(parts, -1)
        longer = F.array(F.struct(last["mark"].alias("mark"), F.concat(last["value"], s).alias("value")))
        going_on = F.when(F.size(parts) > 0, F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), longer)).otherwise(parts)
        return F.when(mark.isNotNull(), F.concat(parts, F.array(F.struct(mark.alias("mark"), s.alias("value"))))).otherwise(going_on)

    def names(mark: Column) -> Column:
        many = mark["last"] >= mark["first"]
        return F.transform(F.sequence(F.ascii(mark["first"]), F.ascii(F.when(many, mark["last"]).otherwise(mark["first"]))), lambda x: F.char(x))

    parts = F.aggregate(sentences, none, add)
    entries = F.flatten(F.transform(parts, lambda p: F.transform(names(p["mark"]), lambda n: F.struct(n.alias("key"), F.trim(p["value"]).alias("value")))))
    labels = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(labels, lambda n: F.struct(n.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"].alias("value")))
    return F.struct(labels.alias("labels"), F.map_from_entries(last).alias("segments"))


def labels_or_given(given: Column, caption: Column) -> Column:
    """The labels of a comma list if it has any, else those of the caption."""
    listed = F.filter(F.transform(F.split(F.coalesce(given, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(listed) > 0, listed).otherwise(caption_labels(caption)["labels"])


def keyword_count(c: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in the text, each counted once, without regard to case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return sum((low.contains(k.lower()).cast("int") for k in keywords), F.lit(0))


def pattern_hits(c: Column, patterns: list[str]) -> Column:
    """The patterns that match, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")).rlike(p), F.lit(p)) for p in patterns]))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text holds any of the words, without regard to case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.greatest(F.lit(False), *[low.contains(w.lower()) for w in words])


def search_text(*columns: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in columns]))


def relevance(query: str, weights: list[tuple[Column, int]]) -> Column:
    """Sum of the weights of the columns that hold the query; 0 for a blank query."""
    q = query.strip().lower()
    if not q:
        return F.lit(0)
    return sum((F.when(F.lower(F.coalesce(c, F.lit(""))).contains(q), w).otherwise(0) for c, w in weights), F.lit(0))


def truncated(c: Column, most: int, mark: str = "\n...[truncated]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(mark))).otherwise(c)


def tail(c: Column, most: int) -> Column:
    return F.right(c, F.lit(most))


def title_of_key(c: Column) -> Column:
    """multi_line as Multi Line."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def last_path_part(c: Column) -> Column:
    return F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)


def figure_index_in(c: Column) -> Column:
    """The number after fig in a file name; null if there is none."""
    return F.nullif(F.regexp_extract(last_path_part(c), r"(?i)fig0*([0-9]+)", 1), F.lit("")).cast("int")


def query_string(filters: dict[str, Column], defaults: dict[str, str]) -> Column:
    """key=value pairs joined by &, without those that hold their default."""
    return F.concat_ws("&", *[F.when(F.coalesce(c, F.lit(defaults[k])) != defaults[k], F.concat(F.lit(k + "="), F.url_encode(c))) for k, c in filters.items()])


def parsed_query(c: Column) -> Column:
    """A query string as a map; values are URL-decoded."""
    return F.transform_values(F.str_to_map(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("=")), lambda _, v: F.coalesce(F.try_url_decode(v), v))


def alias(c: Column, names: dict[str, str], default: str | None = None) -> Column:
    """The name an alias stands for, without regard to case, blanks and hyphens; else the default, or the text itself."""
    key = F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.lit(default) if default is not None else c)


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """The template with each {name} replaced by its column, null by nothing."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out
