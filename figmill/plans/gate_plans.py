"""Gates, routes and predicates over scores, samples and code texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.functions import text
from figmill.functions.casts import number_or, truthy
from figmill.operators import audit, gates, joins
from figmill.plans.registry import query
from figmill.sources.tables import table

LEAST = {"data_purity_score": 7.0, "code_reproducibility_score": 6.5, "aesthetic_score": 7.0}


def score_rules() -> list[gates.Rule]:
    """A missing number counts as 0 and NaN as failing."""
    low = lambda c, t: (number_or(F.col(c)) < t) | F.isnan(number_or(F.col(c)))
    return [
        gates.Rule("category", ~F.col("category").eqNullSafe("data_statistical")),
        gates.Rule("incomplete", ~truthy(F.col("is_complete_panel"))),
        gates.Rule("foreign_overlap", truthy(F.col("has_foreign_overlap"))),
        gates.Rule("purity", ~F.col("data_purity").eqNullSafe("pure_data_statistical")),
        *[gates.Rule(f"low_{c}", low(c, t)) for c, t in LEAST.items()],
    ]


_REASONS = "[" + ", ".join(
    [
        "case when category is distinct from 'data_statistical' then 'category' end",
        "case when not coalesce(is_complete_panel, false) then 'incomplete' end",
        "case when has_foreign_overlap then 'foreign_overlap' end",
        "case when data_purity is distinct from 'pure_data_statistical' then 'purity' end",
        *[f"case when coalesce({c}, 0) < {t} or isnan(coalesce({c}, 0)) then 'low_{c}' end" for c, t in LEAST.items()],
    ]
) + "]"
_MARKED = f"(select *, list_filter({_REASONS}, lambda x: x is not null) rs from qwen_panel_scoring)"


@query(f"select panel_id, scored_at, array_to_string(rs, ';') reasons, len(rs) = 0 passed from {_MARKED}")
def gate_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = gates.reasons(score_rules())
    return table(spark, d, "qwen_panel_scoring").select("panel_id", "scored_at", F.array_join(r, ";").alias("reasons"), (F.size(r) == 0).alias("passed"))


@query(f"select reason, count(*) n from (select unnest(rs) reason from {_MARKED}) group by reason")
def gate_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return gates.reason_counts(table(spark, d, "qwen_panel_scoring"), score_rules())


@query(f"select 'passed' part, count(*) n from {_MARKED} where len(rs) = 0 union all select 'rejected', count(*) from {_MARKED} where len(rs) > 0")
def gate_partition(spark: SparkSession, d: str) -> DataFrame:
    passed, rejected = gates.gated(table(spark, d, "qwen_panel_scoring"), score_rules())
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(passed, "passed").unionByName(count(rejected, "rejected"))


_BELOW = ", ".join(f"case when {c} is null then '{c}=missing<threshold={t:g}' when {c} < {t} then '{c}=' || format('{{:g}}', {c}) || '<threshold={t:g}' end" for c, t in LEAST.items())


@query(f"select panel_id, scored_at, nullif(array_to_string(list_filter([{_BELOW}], lambda x: x is not null), ';'), '') failure from qwen_panel_scoring")
def gate_missing_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The other gate: only thresholds, and a missing value is named as such."""
    return table(spark, d, "qwen_panel_scoring").select("panel_id", "scored_at", gates.below({c: F.col(c) for c in LEAST}, LEAST).alias("failure"))


_ROUTE = f"case when category = 'schematic' then 'schematic' when category = 'data_statistical' and {' and '.join(f'{c} >= {t}' for c, t in LEAST.items())} then 'data' else 'ignored' end"


@query(f"select {_ROUTE} route, coalesce(nullif(category, ''), 'unknown') category, count(*) n from qwen_panel_scoring group by 1, 2")
def gate_routes(spark: SparkSession, d: str) -> DataFrame:
    enough = gates.reaches({c: F.col(c) for c in LEAST}, LEAST)
    where = gates.route([("schematic", F.col("category") == "schematic"), ("data", (F.col("category") == "data_statistical") & enough)], "ignored")
    category = F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))
    return table(spark, d, "qwen_panel_scoring").groupBy(where.alias("route"), category.alias("category")).agg(F.count("*").alias("n"))


@query("select panel_id, subject, subtype from samples where subject in ('biology', 'physics') and complexity_level in ('high') and coalesce(target_png, '') <> ''")
def filter_in_lists(spark: SparkSession, d: str) -> DataFrame:
    """Optional IN lists; the empty list of subtypes filters nothing."""
    wanted = {"subject": ["biology", "physics"], "complexity_level": ["high"], "subtype": []}
    df = table(spark, d, "samples").where(F.coalesce("target_png", F.lit("")) != "")
    for column, allowed in wanted.items():
        df = df.where(gates.within(column, allowed))
    return df.select("panel_id", "subject", "subtype")


_FILES = ["target_png", "target_pdf", "reproduce_png", "reproduce_code"]
_MISSING = ", ".join(f"case when coalesce({f}, '') = '' then '{f}' end" for f in _FILES)


@query(f"select panel_id, loaded_at, array_to_string(list_filter([{_MISSING}], lambda x: x is not null), ',') missing from samples where {' or '.join(f"coalesce({f}, '') = ''" for f in _FILES)}")
def required_missing(spark: SparkSession, d: str) -> DataFrame:
    """Rows that lack a required file, with the names of those they lack."""
    present = F.array_compact(F.array(*[F.when(F.coalesce(f, F.lit("")) != "", F.lit(f)) for f in _FILES]))
    missing = gates.missing_of(_FILES, present)
    return table(spark, d, "samples").where(F.size(missing) > 0).select("panel_id", "loaded_at", F.array_join(missing, ",").alias("missing"))


@query("select doc_id, instr(lower(text), 'savefig') > 0 has_save, regexp_matches(lower(text), '\\b(image\\.open|imread)\\b') loads from documents where section = 'code' and text is not null")
def code_predicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("section = 'code' and text is not null")
    return docs.select("doc_id", text.any_of(F.col("text"), ["savefig"]).alias("has_save"), F.lower("text").rlike(r"\b(image\.open|imread)\b").alias("loads"))


@query("select doc_id, instr(lower(text), 'savefig') > 0 has_save, regexp_matches(lower(text), '\\b(image\\.open|imread)\\b') loads from documents where text is not null")
def code_predicates_all(spark: SparkSession, d: str) -> DataFrame:
    """As code_predicates, but of all texts: code is also found outside the section of that name."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", text.any_of(F.col("text"), ["savefig"]).alias("has_save"), F.lower("text").rlike(r"\b(image\.open|imread)\b").alias("loads"))


#: Lines that take a picture from somewhere instead of drawing it.
_PICTURE_RULES: list[tuple[str, str, str]] = [
    ("reads_picture", "major", r"\b(imread|image\.open|loadimg)\s*\("),
    ("unpacks_bytes", "critical", r"\b(b64decode|frombytes|frombuffer|bytesio)\s*\("),
    ("copies_file", "critical", r"\b(copyfile|copy2|shutil\.\w+)\s*\("),
    ("shows_raster", "minor", r"\b(imshow|figimage|imsave)\s*\("),
    ("names_picture", "minor", r"[a-z0-9_]\.(png|tiff?|jpe?g|svg)\b"),
]
_DOC_RULES: list[tuple[str, str, str]] = [("import", "minor", "^\\s*import "), ("save", "major", "savefig\\("), ("label", "minor", "set_[xy]label\\("), ("bar", "minor", "\\.bar\\(")]
_DOC_CASE = "case " + " ".join(f"when regexp_matches(lower(t), '{p}') then '{c}'" for c, _, p in _DOC_RULES) + " end"


@query(
    f"""select doc_id, line, category, text from (
        select doc_id, line, category, text, row_number() over (partition by doc_id order by line) k from (
            select doc_id, i line, {_DOC_CASE} category, left(trim(t), 240) "text" from (
                select doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) t, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) i from documents where section = 'code' and text is not null))
        where category is not null) where k <= 20"""
)
def line_findings(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("section = 'code' and text is not null")
    return audit.findings(docs, "doc_id", "text", _DOC_RULES, most=20).select("doc_id", F.col("line").cast("long").alias("line"), "category", "text")


@query(
    f"""select doc_id, line, category, text from (
        select doc_id, line, category, text, row_number() over (partition by doc_id order by line) k from (
            select doc_id, i line, {_DOC_CASE} category, left(trim(t), 240) "text" from (
                select doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) t, generate_subscripts(string_split_regex(text, '\\r\\n|\\n|\\r'), 1) i from documents where text is not null))
        where category is not null) where k <= 80"""
)
def line_findings_all(spark: SparkSession, d: str) -> DataFrame:
    """As line_findings, but of all texts and with the operator's own bound of findings a text."""
    docs = table(spark, d, "documents").where("text is not null")
    return audit.findings(docs, "doc_id", "text", _DOC_RULES).select("doc_id", F.col("line").cast("long").alias("line"), "category", "text")


@query(
    r"""with line as (select doc_id, lower(unnest(string_split_regex(text, '\r\n|\n|\r'))) t from documents where text is not null), named as (
        select doc_id, case when regexp_matches(t, '\b(imread|image\.open|loadimg)\s*\(') then 1 when regexp_matches(t, '\b(b64decode|frombytes|frombuffer|bytesio)\s*\(') then 2
            when regexp_matches(t, '\b(copyfile|copy2|shutil\.\w+)\s*\(') then 3 when regexp_matches(t, '\b(imshow|figimage|imsave)\s*\(') then 4
            when regexp_matches(t, '[a-z0-9_]\.(png|tiff?|jpe?g|svg)\b') then 5 end k from line)
    select doc_id, count(*) filter (k = 1) reads_picture, count(*) filter (k = 2) unpacks_bytes, count(*) filter (k = 3) copies_file, count(*) filter (k = 4) shows_raster, count(*) filter (k = 5) names_picture
    from named where k is not null group by doc_id"""
)
def image_use_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines that take a picture from somewhere; the first rule that matches a line counts."""
    found = audit.findings(table(spark, d, "documents").where("text is not null"), "doc_id", "text", _PICTURE_RULES, most=1_000_000_000)
    return audit.finding_counts(found, "doc_id", [c for c, _, _ in _PICTURE_RULES])


@query("select message, regexp_matches(lower(message), 'rate limit|timeout|timed out|overloaded|connection reset') retry from (select distinct short_reason message from qwen_panel_scoring)")
def retryable(spark: SparkSession, d: str) -> DataFrame:
    markers = ["rate limit", "timeout", "timed out", "overloaded", "connection reset"]
    return table(spark, d, "qwen_panel_scoring").select(F.col("short_reason").alias("message")).distinct().withColumn("retry", F.when(F.col("message").isNotNull(), text.any_of(F.col("message"), markers)))


@query("select p.paper_id, p.year, count(*) n from papers p where p.journal not in ('Geo Figures') and p.journal like '%Figure%' and p.year in ('2025', '2026') and coalesce(p.doi, '') <> '' and len(p.figures) >= 2 and p.doi not in (select doi from panels where doi is not null) group by 1, 2")
def paper_filter(spark: SparkSession, d: str) -> DataFrame:
    """Per-paper conditions, a deny list, a least number of figures, and no DOI seen before."""
    p = table(spark, d, "papers")
    p = p.where(F.col("journal").contains("Figure") & ~F.col("journal").isin("Geo Figures") & F.col("year").isin("2025", "2026") & (F.coalesce("doi", F.lit("")) != "") & (F.size("figures") >= 2))
    return joins.unseen(p, table(spark, d, "panels"), "doi").groupBy("paper_id", "year").agg(F.count("*").alias("n"))
