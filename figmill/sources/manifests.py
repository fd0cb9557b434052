"""Readers and writers of manifests: CSV and JSON record files, identifier lists and run folders.

Paths are given to Spark, so any file system it knows will do; a path without files gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figmill.functions import ids, text
from figmill.functions.casts import or_else

#: Fields of a sample record and the names each may go by, best first.
SAMPLE_FIELDS: dict[str, list[str]] = {
    "panel_id": ["panel_id", "id"],
    "dataset_dir": ["dataset_dir"],
    "target_png": ["target_png"],
    "target_pdf": ["target_pdf"],
    "reproduce_png": ["reproduce_png", "reference_png"],
    "reproduce_pdf": ["reproduce_pdf", "reference_pdf"],
    "reproduce_code": ["reproduce_code", "reference_code"],
    "description_md": ["description_md"],
    "subject": ["subject"],
    "topic": ["topic"],
    "subtype": ["subtype"],
    "complexity_level": ["complexity_level", "threshold_complexity_level", "original_complexity_level"],
    "refine_complexity_score": ["refine_complexity_score"],
    "caption": ["caption"],
    "content_summary": ["content_summary"],
    "complexity_reason": ["complexity_reason"],
}
#: Keys under which a JSON manifest may hold its list of records.
LIST_KEYS = ["samples", "records", "items", "data"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file is at the path or matches its pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int = 0) -> DataFrame:
    """CSV rows, all columns strings, empty fields as empty strings, columns the file lacks null; limit 0 keeps all.

    Without ``columns`` the header names them. A missing file gives an empty table of ``columns``.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or []]))
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\0", emptyValue="", mode="PERMISSIVE")
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    if columns:
        df = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
    return df.limit(limit) if limit else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; the columns are the first-seen union, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one object or a list each, with the file they came from; a file that is no JSON has its text in ``_bad``."""
    full = T._parse_datatype_string(schema).add("_bad", "string")
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*full.fields, T.StructField("path", T.StringType())]))
    df = spark.read.schema(full).option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True, mode="PERMISSIVE")
    return df.withColumn("path", F.input_file_name())


def _finite(c: Column, kind: T.DataType) -> Column:
    """The value with NaN and infinities as null at any depth."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, x: _finite(x, kind.valueType))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; NaN and infinities, which JSON has not, as null, also within arrays, maps and structs."""
    safe = [_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    df.select(*safe).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def records_in(body: Column) -> Column:
    """The record texts of a JSON manifest: a list, or an object with a list under one of LIST_KEYS. Not JSON gives null."""
    listed = [F.from_json(body, "array<string>")] + [F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>") for k in LIST_KEYS]
    return F.coalesce(*listed)


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected) of JSON manifests; the rejected have a reason: no object, or no panel_id.

    A field is the first of its names that holds a value that is not empty. Paths of panels end in their id.
    """
    whole = spark.read.text(path, wholetext=True).select(F.explode(records_in(F.col("value"))).alias("body"))
    keys = sorted({n for names in SAMPLE_FIELDS.values() for n in names})
    parsed = whole.select("body", F.from_json("body", T.StructType([T.StructField(k, T.StringType()) for k in keys])).alias("r"))
    fields = {c: or_else(*[F.col(f"r.{n}") for n in names]) for c, names in SAMPLE_FIELDS.items()}
    fields["panel_id"] = F.coalesce(fields["panel_id"], F.nullif(text.last_path_part(fields["dataset_dir"]), F.lit("")))
    rows = parsed.select("body", *[c.alias(n) for n, c in fields.items()])
    reason = F.when(~F.trim("body").startswith("{"), "not an object").when(F.col("panel_id").isNull(), "no panel_id")
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason", "body"), marked.where("reason is not null").select("body", "reason")


def read_identifiers(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """identifier of an exclusion file: a JSON list, a JSON object with lists under ``keys``, or lines without # comments."""
    if not exists(spark, path):
        return spark.createDataFrame([], "identifier string")
    whole = spark.read.text(path, wholetext=True).select(F.col("value"))
    lists = F.array_compact(F.array(F.from_json("value", "array<string>"), *[F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in keys]))
    is_json = F.trim("value").rlike(r"^[\[{]")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    found = whole.select(F.explode(F.when(is_json, F.flatten(lists)).otherwise(lines)).alias("identifier"))
    return found.select(F.trim("identifier").alias("identifier")).where("identifier <> ''").distinct()


def write_identifiers(df: DataFrame, column: str, path: str) -> None:
    """Distinct values in order, one a line."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def run_parts(path: Column) -> Column:
    """Struct of subject, topic and run of a path .../subject/topic/run_name/..."""
    take = lambda i: F.nullif(F.regexp_extract(path, r"([^/]+)/([^/]+)/(run_[^/]+)(?:/|$)", i), F.lit(""))
    return F.struct(take(1).alias("subject"), take(2).alias("topic"), take(3).alias("run"))


def manifest_files(files: DataFrame, path: str, skipped: list[str], suffix: str = "_smoke") -> DataFrame:
    """Rows of a file listing without those in skipped folders or in folders that end in ``suffix``."""
    folders = F.split(F.lower(path), "/")
    bad = F.exists(folders, lambda x: x.isin([s.lower() for s in skipped]) | x.endswith(suffix))
    return files.where(~bad)


def first_existing(files: DataFrame, group: list[str], path: str, preferred: list[str]) -> DataFrame:
    """Of each group the file whose name comes first in ``preferred``, then by path; other files only where none is named."""
    name = text.last_path_part(F.col(path))
    place = F.lit(len(preferred))
    for i, p in reversed(list(enumerate(preferred))):
        place = F.when(name == p, i).otherwise(place)
    return files.groupBy(*group).agg(F.min_by(path, F.struct(place, F.col(path))).alias(path))


def choose_image(members: DataFrame, group: list[str], member: str, href: str, extensions: list[str]) -> DataFrame:
    """Of each group the member whose stem is that of ``href``, else begins with it; preferred extensions, then names, first."""
    base = text.last_path_part(F.col(member))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    wanted = F.regexp_replace(text.last_path_part(F.col(href)), r"\.(?:png|jpe?g|tiff?|gif)$", "")
    extension = F.array_position(F.array(*map(F.lit, extensions)), F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1)))
    match = F.when(stem == wanted, 0).when(stem.startswith(wanted), 1)
    rows = members.withColumn("__match", match).where("__match is not null").withColumn("__ext", extension).where("__ext > 0")
    return rows.groupBy(*group).agg(F.min_by(member, F.struct("__match", "__ext", member)).alias(member))


def resolved(df: DataFrame, path: str, files: DataFrame, file: str, roots: list[str], column: str = "found") -> DataFrame:
    """``df`` with the first place in a file listing where the path is: as it stands, then under each root; null if nowhere."""
    base = F.regexp_replace(F.col(path), "^/+", "")
    places = F.array(F.struct(F.lit(-1).alias("rank"), F.col(path).alias("place")), *[F.struct(F.lit(i).alias("rank"), F.concat(F.lit(r.rstrip("/") + "/"), base).alias("place")) for i, r in enumerate(roots)])
    asked = df.select(path).where(F.coalesce(path, F.lit("")) != "").distinct()
    listed = files.select(F.col(file).alias("place")).distinct()
    found = asked.select(path, F.inline(places)).join(listed, "place").groupBy(path).agg(F.min_by("place", "rank").alias(column))
    return df.join(found, path, "left")


def figures(papers: DataFrame) -> DataFrame:
    """One row for each figure of each paper; papers without figures have none."""
    return papers.select("paper_id", "doi", F.inline("figures")).withColumnRenamed("index", "figure_index")


def paper_markdown(title: Column, journal: Column, date: Column, doi: Column, abstract: Column) -> Column:
    """A paper as Markdown; absent values leave their line out."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {name}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(title, F.lit(""))), line("Journal", journal), line("Date", date), line("DOI", doi), F.when(F.coalesce(abstract, F.lit("")) != "", F.concat(F.lit("\n"), abstract)))


def one_figure(spark: SparkSession, path: str, paper_id: str, figure_index: int = 1, caption: str = "") -> DataFrame:
    """A full-figure table of one image, for runs on a single file."""
    row = (paper_id, figure_index, path, caption)
    made = spark.createDataFrame([row], "paper_id string, figure_index int, relative_path string, caption string")
    return made.withColumn("paper_id", ids.safe_name(F.col("paper_id"))).withColumn("figure_label", F.format_string("Fig. %d", "figure_index"))


def one_panel(spark: SparkSession, path: str, panel_id: str, caption: str = "", subtype: str = "other_data_display") -> DataFrame:
    """A panel table of one image with a placeholder score."""
    made = spark.createDataFrame([(panel_id, path, caption, subtype)], "panel_id string, target_path string, caption string, data_subtype string")
    return made.withColumn("panel_id", ids.safe_name(F.col("panel_id"))).withColumn("overall_quality_score", F.lit(None).cast("double"))
