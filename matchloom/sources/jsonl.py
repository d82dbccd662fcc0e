"""Tolerant readers and ordered writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import coerce as co
from matchloom.functions.hashing import EDUCATION_DDL, EXPERIENCE_DDL

# ---------------------------------------------------------------- fixed values
# Loose scalars and nested lists are read as text and coerced afterwards.
PROFILE_DDL = (
    "id string, name string, location string, linkedin_url string, headline string, "
    "about string, is_open_to_work string, skills string, experience string, "
    "education string, total_experience_months string, text_context_full string, "
    "created_at string, updated_at string, _observed_at string, _source string"
)
LOOSE_ENTRY_DDL = (
    "role string, company_name string, start_date string, end_date string, "
    "is_current string, duration_months string, job_type string, work_type string, "
    "location string, description string, skills_used string"
)
LOOSE_STUDY_DDL = (
    "degree string, field_of_study string, school_name string, start_date string, "
    "end_date string, period string, skills string"
)
JOB_DDL = (
    "job_id string, title string, company string, location string, min_years double, "
    "max_years double, budget_lpa array<double>, must_have array<string>, "
    "good_to_have array<string>, raw_query string"
)
LABEL_DDL = "job_id string, candidate_id string, relevance int, graded_by string, graded_on string"
# ------------------------------------------------------------ end fixed values


def split_json(lines: DataFrame, raw: str, schema: str, keep: list[str] | None = None
               ) -> tuple[DataFrame, DataFrame]:
    """(parsed, quarantine) of a text column of JSON objects; blank lines are skipped.

    Parsed rows keep the raw text as ``_raw`` so that absent and null keys differ.
    """
    keep = keep or []
    rows = lines.where(F.trim(raw) != "")
    good = F.try_parse_json(F.col(raw)).isNotNull() & F.trim(raw).startswith("{")
    parsed = rows.where(good).select(
        *keep, F.col(raw).alias("_raw"), F.from_json(F.col(raw), schema).alias("_j")).select(
        *keep, "_raw", "_j.*")
    return parsed, rows.where(~good).select(*keep, F.col(raw).alias("_raw"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    return split_json(spark.read.text(path), "value", schema)


def _objects(raw: Column, ddl: str) -> Column:
    """Object items of a raw JSON array, each read loosely; anything else is dropped."""
    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    items = F.filter(items, lambda i: F.startswith(i, F.lit("{")))
    parsed = F.transform(items, lambda i: F.from_json(i, ddl))
    return F.coalesce(parsed, F.array().cast(f"array<struct<{ddl}>>"))


def coerce_profiles(parsed: DataFrame) -> DataFrame:
    """Typed profiles from loosely parsed ones; a bad field never loses the record."""
    entry = F.transform(_objects(F.col("experience"), LOOSE_ENTRY_DDL), lambda e: F.struct(
        *[e[c].alias(c) for c in ("role", "company_name", "start_date", "end_date")],
        co.to_bool(e["is_current"]).alias("is_current"),
        co.to_int(e["duration_months"]).alias("duration_months"),
        *[e[c].alias(c) for c in ("job_type", "work_type", "location", "description")],
        co.text_or_list(e["skills_used"]).alias("skills_used")))
    study = F.transform(_objects(F.col("education"), LOOSE_STUDY_DDL), lambda e: F.struct(
        *[e[c].alias(c) for c in ("degree", "field_of_study", "school_name", "start_date",
                                  "end_date", "period")],
        co.text_or_list(e["skills"]).alias("skills")))
    return (
        parsed.withColumn("experience", entry.cast(EXPERIENCE_DDL))
        .withColumn("education", study.cast(EDUCATION_DDL))
        .withColumn("is_open_to_work", co.to_bool(F.col("is_open_to_work")))
        .withColumn("skills", co.text_or_list(F.col("skills")))
        .withColumn("total_experience_months", co.to_int(F.col("total_experience_months")))
    )


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    good, bad = read_json_lines(spark, path, PROFILE_DDL)
    return coerce_profiles(good), bad


def read_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Partial profiles with an ingest ordinal.

    The ordinal is text that orders records by file, then by place in the file,
    however the files are split into tasks; it only breaks ties between records
    of one time.  List and flag fields stay null when the key is null.
    """
    def padded(n: Column) -> Column:
        return F.lpad(n.cast("string"), 20, "0")

    # Inside one split the running number follows the lines; splits follow their start.
    place = F.concat_ws("|", F.col("_metadata.file_path"), padded(F.col("_metadata.file_block_start")),
                        padded(F.monotonically_increasing_id()))
    lines = spark.read.text(path).select("value", place.alias("ordinal"))
    good, bad = split_json(lines, "value", PROFILE_DDL, ["ordinal"])
    typed = coerce_profiles(good)
    for group in ("skills", "experience", "education"):
        typed = typed.withColumn(group, F.when(
            F.get_json_object("_raw", f"$.{group}").isNotNull(), F.col(group)))
    return typed, bad


def explode_profiles(profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, entries, education) rows that the signal jobs read."""
    people = profiles.select("id", "headline", "about", F.col("is_open_to_work").alias("is_open"),
                             "location", "skills")
    entries = profiles.select("id", F.posexplode("experience").alias("ix", "e")).select(
        "id", "ix", "e.*")
    studies = profiles.select("id", F.posexplode("education").alias("ix", "e")).select(
        "id", "ix", "e.*")
    return people, entries, studies


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs from one JSON array."""
    return spark.read.schema(JOB_DDL).option("multiLine", True).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_DDL).option("header", True).csv(path).select(
        "job_id", "candidate_id", "relevance")


def write_json(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines; with ``order`` the part files follow it from first to last."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
