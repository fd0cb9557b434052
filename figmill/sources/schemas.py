"""Types of the manifest tables, and typed views of tables read as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figmill.functions.casts import number_unless_blank, truthy

#: Dates stay texts, as they may be partial (2025-00-00).
TABLES: dict[str, str] = {
    "papers": "paper_id string, pmcid string, doi string, doi_url string, journal string, publication_date string, year string, title string, abstract string, license string, citation string, pmc_url string, oa_package_url string, figures array<struct<index:int,label:string,caption:string,original_member:string,output_file:string>>",
    "full_figures": "paper_id string, doi string, pmcid string, journal string, publication_date string, figure_label string, figure_index int, relative_path string, figure_pdf_path string, source_url string, panel_count int, parsed_panel_labels string, split_method string, review_path string, caption string",
    "panels": "paper_id string, doi string, pmcid string, journal string, publication_date string, figure_label string, figure_index int, panel_label string, panel_ordinal int, relative_path string, panel_pdf_path string, source_figure_path string, source_figure_pdf_path string, source_figure_url string, review_path string, bbox_xyxy array<int>, split_method string, codex_confidence double, assigned_subplots string, panel_caption string, figure_caption string",
    "scores": "panel_id string, category string, data_subtype string, is_complete_panel boolean, has_foreign_overlap boolean, xy_label_applicable boolean, xy_label_complete string, xytick_applicable boolean, xytick_complete string, clarity_integrity_score double, data_purity string, data_purity_score double, code_reproducibility_score double, aesthetic_score double, overall_quality_score double, confidence double, is_good_quality boolean, short_reason string, target_path string, prompt_path string",
    "samples": "panel_id string, dataset_dir string, target_png string, target_pdf string, reproduce_png string, reproduce_pdf string, reproduce_code string, description_md string, subject string, topic string, subtype string, complexity_level string, refine_complexity_score double, caption string, content_summary string, complexity_reason string",
    "reviews": "panel_id string, status string, review_passed boolean, review_rounds_completed int, max_review_rounds int, final_assessment string",
    "audits": "panel_id string, status string, overall_pass boolean, severity string, issue_flags map<string,boolean>, issue_summary string, recommended_action string, confidence double, audited_at string",
    "runs": "model_id string, gpu_id string, mode string, output_dir string, start_iso string, end_iso string, elapsed_seconds int, returncode int, status string",
}


def read_as(c: Column, kind: T.DataType) -> Column:
    """A text as a type; what can't be read is null. Booleans are words, nested types are JSON."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.when(F.coalesce(F.trim(c), F.lit("")) != "", truthy(c))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.from_json(F.nullif(F.trim(c), F.lit("")), kind)
    if isinstance(kind, T.NumericType):
        return number_unless_blank(c).try_cast(kind) if not isinstance(kind, T.IntegralType) else F.floor(number_unless_blank(c)).try_cast(kind)
    return c.try_cast(kind)


def typed(df: DataFrame, table: str) -> DataFrame:
    """``df``, all texts, with the columns and types of a table; columns it lacks are null, others are dropped."""
    fields = T._parse_datatype_string(TABLES[table]).fields
    return df.select(*[(read_as(F.col(f.name), f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
