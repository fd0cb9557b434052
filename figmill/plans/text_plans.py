"""Casts, identifiers, captions, search and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.functions import casts, ids, jsonx, text
from figmill.operators import facets, gates, identifiers
from figmill.plans.registry import query
from figmill.sources.tables import table


@query("select distinct doi, trim(regexp_replace(lower(regexp_replace(doi, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g')) slug0, left(trim(lower(regexp_replace(doi, '[^A-Za-z0-9]+', '-', 'g')), '-'), 72) slug from panels where coalesce(doi, '') <> ''")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "panels").select("doi").where("coalesce(doi, '') <> ''").distinct()
    return rows.select("doi", ids.slug(F.col("doi"), most=100_000).alias("slug0"), ids.slug(F.col("doi")).alias("slug"))


@query("select distinct paper_id, regexp_replace(coalesce(nullif(trim(paper_id), ''), 'unknown'), '[^A-Za-z0-9_.-]+', '_', 'g') name, regexp_replace(paper_id, '[^\\p{L}\\p{N}._-]', '_', 'g') wide_name, left(trim(regexp_replace(paper_id, '[^A-Za-z0-9_.-]+', '_', 'g'), '._-'), 160) file_name from panels")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    rows, c = table(spark, d, "panels").select("paper_id").distinct(), F.col("paper_id")
    return rows.select(c, ids.safe_name(c).alias("name"), ids.safe_name_unicode(c).alias("wide_name"), ids.safe_file_name(c).alias("file_name"))


_DOI = "lower(regexp_replace(regexp_extract(trim(coalesce({0}, '')), '(?i)(10\\.[0-9]{{4,9}}/[^\\s?#<>]+)', 1), '[.,;)\\]}}\"'']+$', ''))"
_PMC = "upper(regexp_extract(coalesce({0}, ''), '(?i)\\b(PMC[0-9]+)\\b', 1))"


@query(f"select distinct doi, pmcid, {_DOI.format('doi')} doi_key, {_PMC.format('pmcid')} pmc_key from panels")
def normal_identifiers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "panels").select("doi", "pmcid").distinct()
    return rows.select("doi", "pmcid", ids.doi(F.col("doi")).alias("doi_key"), ids.pmcid(F.col("pmcid")).alias("pmc_key"))


@query(
    """select distinct regexp_replace(paper_id || '__fig' || case when length(figure_index::varchar) < 2 then lpad(figure_index::varchar, 2, '0') else figure_index::varchar end || '_'
    || coalesce(nullif(panel_label, ''), 'panel' || coalesce(panel_ordinal::varchar, '')), '[^A-Za-z0-9_.-]+', '_', 'g') panel_id,
    case when regexp_matches(lower(trim(coalesce(panel_label, ''))), '^(?:[a-z]|panel[0-9]{1,3})$') then lower(trim(panel_label)) else 'panel' || lpad(panel_ordinal::varchar, 2, '0') end label from panels"""
)
def stable_panel_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "panels").select(ids.panel_id(c("paper_id"), c("figure_index"), c("panel_label"), c("panel_ordinal")).alias("panel_id"), ids.safe_label(c("panel_label"), c("panel_ordinal")).alias("label"))
    return rows.distinct()


@query(
    f"""select distinct kind, identifier from (
        select 'doi' kind, {_DOI.format("doi_url")} identifier from papers union all select 'pmcid', {_PMC.format("doi_url")} from papers
        union all select 'pmcid', {_PMC.format("pmc_url")} from papers union all select 'doi', {_DOI.format("pmc_url")} from papers) where identifier <> ''"""
)
def mined_identifiers(spark: SparkSession, d: str) -> DataFrame:
    found = identifiers.mined(table(spark, d, "papers"), ["doi_url", "pmc_url"])
    return found.where("kind <> 'panel_id'")


@query(
    """select distinct case when regexp_extract(lower(coalesce(doi, '')), '(10\\.[0-9]{4,9}/[^\\s?#<>]+)', 1) <> '' then '"' || regexp_replace(regexp_extract(lower(trim(doi)), '(10\\.[0-9]{4,9}/[^\\s?#<>]+)', 1), '[.,;)\\]}"'']+$', '') || '"[DOI]'
    when regexp_extract(coalesce(pmcid, ''), '(?i)\\b(PMC[0-9]+)\\b', 1) <> '' then upper(regexp_extract(pmcid, '(?i)\\b(PMC[0-9]+)\\b', 1)) || '[PMCID]' else nullif(trim(paper_id), '') end clause from papers"""
)
def search_clauses(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    return p.select(ids.search_clause(F.col("doi"), F.col("pmcid"), F.lit(None).cast("string"), F.col("paper_id")).alias("clause")).distinct()


_FAMILIES = {
    "uncertainty": ["standard (?:error|deviation)", "confidence|interval", "error bars?"],
    "counts": ["\\bn = [0-9]+", "[0-9]+ of [0-9,]+"],
    "tests": ["\\bP = [0-9]", "(?:rank|ratio|permutation|paired) tests?", "least squares"],
}
_HITS = ", ".join(f"array_to_string(list_filter([{', '.join(f"case when regexp_matches(text, '{p}') then '{p}' end" for p in ps)}], lambda x: x is not null), '; ') {k}" for k, ps in _FAMILIES.items())


@query(f"select doc_id, {_HITS} from documents where text is not null")
def regex_families(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", *[F.array_join(text.pattern_hits(F.col("text"), p), "; ").alias(k) for k, p in _FAMILIES.items()])


_WORDS = ["heatmap", "scatter", "bar chart", "fit", "median"]


@query(f"select panel_id, {' + '.join(f"(instr(lower(coalesce(caption, '')), '{w}') > 0)::int" for w in _WORDS)} n from samples")
def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "samples").select("panel_id", text.keyword_count(F.col("caption"), _WORDS).alias("n"))


@query()
def caption_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and parts of figure captions; SQL engines without look-behind can't say it."""
    captions = table(spark, d, "panels").select("figure_caption").where("figure_caption is not null").distinct()
    found = captions.select("figure_caption", text.caption_labels(F.col("figure_caption")).alias("f"))
    return found.select("figure_caption", F.array_join("f.labels", ",").alias("labels"), F.size("f.labels").alias("n"))


@query("select distinct overall_quality_score, case when isnan(overall_quality_score) then 'nan' else regexp_replace(regexp_replace(format('{:.3f}', overall_quality_score), '0+$', ''), '\\.$', '') end label, format('{:g}', overall_quality_score) general from qwen_panel_scoring where overall_quality_score is not null and not isnan(overall_quality_score)")
def number_formats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("overall_quality_score")
    return table(spark, d, "qwen_panel_scoring").where(c.isNotNull() & ~F.isnan(c)).select(c, casts.score_label(c).alias("label"), casts.general_format(c).alias("general")).distinct()


_NUMBER = "'^\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)\\s*$'"


@query(f"select event_id, case when regexp_matches(v, {_NUMBER}) then trim(v)::double end number, lower(trim(v)) in ('1', 'true', 'yes', 'y') truth from (select event_id, case event_id % 6 when 0 then value::varchar when 1 then ' 9 ' when 2 then '3d' when 3 then 'Yes' when 4 then '' else '1' end v from events where value is not null) where not regexp_matches(v, 'e')")
def lenient_casts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 6
    v = F.when(k == 0, F.col("value").cast("string")).when(k == 1, " 9 ").when(k == 2, "3d").when(k == 3, "Yes").when(k == 4, "").otherwise("1")
    e = table(spark, d, "events").where("value is not null").withColumn("v", v).where(~F.col("v").rlike("[eE]") | F.col("v").isin("Yes"))
    return e.where("v <> 'Yes'").select("event_id", casts.number_or_null(F.col("v")).alias("number"), casts.truthy(F.col("v")).alias("truth"))


_EXPONENT = _NUMBER.replace("\\s*$", "([eE][+-]?[0-9]+)?\\s*$")


@query(
    f"""select event_id, case when regexp_matches(v, {_EXPONENT}) then trim(v)::double end number, coalesce(lower(trim(v)) in ('1', 'true', 'yes', 'y'), false) truth
    from (select event_id, case event_id % 8 when 0 then value::varchar when 1 then ' 9 ' when 2 then '3d' when 3 then 'Yes' when 4 then '' when 5 then '1' when 6 then '-2.5E-3' end v from events)"""
)
def lenient_casts_all(spark: SparkSession, d: str) -> DataFrame:
    """As lenient_casts, but of all events, with words, exponents and nulls among the texts."""
    k = F.col("event_id") % 8
    v = F.when(k == 0, F.col("value").cast("string"))
    for i, text_of in enumerate([" 9 ", "3d", "Yes", "", "1", "-2.5E-3"], 1):
        v = v.when(k == i, text_of)
    e = table(spark, d, "events").withColumn("v", v)
    return e.select("event_id", casts.number_or_null(F.col("v")).alias("number"), casts.truthy(F.col("v")).alias("truth"))


_CLAMP = "round(case when {0} is null then 0 when isnan({0}) then 10 else greatest(0, least(10, {0})) end, 3)"


@query(
    f"""select panel_id, scored_at, case when category in ('schematic', 'data_statistical', 'chemical_structure', 'characterization_photo', 'other_uncertain') then category else 'other_uncertain' end category,
    case when category = 'data_statistical' then case when data_subtype in (select distinct subtype from mix_targets where subtype is not null) then data_subtype else 'other_data_display' end end data_subtype,
    case when category is distinct from 'data_statistical' then null else {_CLAMP.format("data_purity_score")} end data_purity_score, {_CLAMP.format("overall_quality_score")} overall_quality_score,
    ({_CLAMP.format("clarity_integrity_score")} >= 8 and {_CLAMP.format("overall_quality_score")} >= 8 and coalesce(is_complete_panel, false) and not coalesce(has_foreign_overlap, false)) is_good_quality from qwen_panel_scoring"""
)
def score_records(spark: SparkSession, d: str) -> DataFrame:
    """Score records brought to their schema from JSON texts."""
    s = table(spark, d, "qwen_panel_scoring")
    names = sorted(r[0] for r in gates.small_list(table(spark, d, "mix_targets"), "subtype"))
    read = F.from_json(F.to_json(F.struct(*[c for c in s.columns if c not in ("panel_id", "scored_at", "ingested_at")])), "map<string,string>")
    out = s.select("panel_id", "scored_at", jsonx.score_record(read, names).alias("r"))
    return out.select("panel_id", "scored_at", *[f"r.{c}" for c in ("category", "data_subtype", "data_purity_score", "overall_quality_score", "is_good_quality")])


@query("select event_id, json_extract_string(props, '$.k')::bigint k from events where props is not null")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("props is not null").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query()
def code_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Code found in document texts and how it was found."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", jsonx.code_in(F.col("text")).alias("c"))
    return docs.select("doc_id", "c.strategy", F.length("c.code").alias("length"))


def _catalogue() -> facets.Catalogue:
    return facets.Catalogue(id="p_partkey", score="p_retailprice", texts=["p_name", "p_brand", "p_type"], weights={"p_name": 10, "p_brand": 8, "p_type": 6}, orders={"size": [F.desc("p_size"), F.desc("p_retailprice")]})


_TEXT = "lower(concat_ws(' ', p_name, p_brand, p_type))"


@query(f"select p_partkey, p_brand, p_size from part where {_TEXT} like '%1%' and p_retailprice >= 1000 order by p_size desc, p_retailprice desc, p_partkey limit 60")
def facet_search(spark: SparkSession, d: str) -> DataFrame:
    found = facets.searched(table(spark, d, "part"), _catalogue(), facets.Search(q="1", least_score=1000.0, order="size"))
    return found.select("p_partkey", "p_brand", "p_size")


@query("select p_partkey, (case when lower(p_name) like '%3%' then 10 else 0 end + case when lower(p_brand) like '%3%' then 8 else 0 end + case when lower(p_type) like '%3%' then 6 else 0 end) relevance from part where lower(concat_ws(' ', p_name, p_brand, p_type)) like '%3%' order by relevance desc, p_retailprice desc, p_partkey limit 60")
def relevance_search(spark: SparkSession, d: str) -> DataFrame:
    return facets.searched(table(spark, d, "part"), _catalogue(), facets.Search(q=" 3 ", order="relevance")).select("p_partkey", "relevance")


@query("select p_brand, count(*) n from part where p_retailprice >= 1000 and p_type = (select min(p_type) from part) group by 1")
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a facet ignore its own filter."""
    part = table(spark, d, "part")
    least = part.agg(F.min("p_type")).first()[0]
    return facets.facet(part, _catalogue(), facets.Search(least_score=1000.0, equal={"p_brand": "Brand#11", "p_type": least}), "p_brand")


@query("select count(*) items, count(distinct p_type) kinds, count(distinct p_brand) journals, round(avg(p_retailprice), 6) score from part")
def facet_totals(spark: SparkSession, d: str) -> DataFrame:
    return facets.totals(table(spark, d, "part"), _catalogue(), "p_type", "p_brand").withColumn("score", F.round("score", 6))


@query("select distinct subtype, case when length(caption) > 40 then left(caption, 40) || '...' else caption end short, right(caption, 10) tail from samples")
def display_text(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    return s.select("subtype", text.truncated(F.col("caption"), 40, "...").alias("short"), text.tail(F.col("caption"), 10).alias("tail")).distinct()


_LAST = "regexp_extract(rtrim({0}, '/'), '([^/]*)$', 1)"


@query(f"select distinct {_LAST.format('target_png')} file, {_LAST.format('dataset_dir')} folder, nullif(regexp_extract(lower({_LAST.format('dataset_dir')}), 'fig0*([0-9]+)', 1), '')::int figure from samples")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "samples")
    return s.select(text.last_path_part(F.col("target_png")).alias("file"), text.last_path_part(F.col("dataset_dir")).alias("folder"), text.figure_index_in(F.col("dataset_dir")).alias("figure")).distinct()
