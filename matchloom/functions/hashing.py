"""Canonical JSON and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import fixed_values as fv
from matchloom.functions import text as tx


# ---------------------------------------------------------------- fixed values
EXPERIENCE_DDL = (
    "array<struct<role string, company_name string, start_date string, end_date string, "
    "is_current boolean, duration_months bigint, job_type string, work_type string, "
    "location string, description string, skills_used array<string>>>"
)
EDUCATION_DDL = (
    "array<struct<degree string, field_of_study string, school_name string, "
    "start_date string, end_date string, period string, skills array<string>>>"
)
# ------------------------------------------------------------ end fixed values


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with keys in alphabetical order, no blanks, nulls kept."""
    cols = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def input_hash(df: DataFrame, exclude: list[str] | None = None) -> Column:
    """Hash of every column but the crawl metadata."""
    skip = set(fv.CRAWL_METADATA if exclude is None else exclude)
    return sha256(canonical_json({c: F.col(c) for c in df.columns if c not in skip}))


def json_text(c: Column) -> Column:
    """A string as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def text_group_hash(value: Column) -> Column:
    """Hash of a text field group: the normalised text as a JSON string."""
    return sha256(json_text(tx.norm_text(value)))


def set_group_value(items: Column) -> Column:
    """A list field group reduced to its sorted set of normalised items."""
    items = tx.norm_nested(items, "array<string>")
    return _sorted_set(items)


def set_group_hash(items: Column) -> Column:
    return sha256(F.to_json(set_group_value(items)))


def flag_group_hash(flag: Column) -> Column:
    return sha256(F.coalesce(flag.cast("string"), F.lit("null")))


def _text(c: Column) -> Column:
    return tx.norm_plain(c)


def _sorted_set(items: Column) -> Column:
    items = F.coalesce(items, F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(
        F.transform(F.filter(items, lambda i: i.isNotNull()), tx.norm_plain)))


def experience_value(entries: Column) -> Column:
    """Experience group: entries projected to what matters, in a stable order."""
    def project(e: Column) -> Column:
        return F.struct(
            tx.norm_company(_text(e["company_name"])).alias("company"),
            F.substring(tx.blank_if_null(e["start_date"]), 1, 10).alias("start_date"),
            _text(e["role"]).alias("role"),
            F.struct(
                tx.norm_company(_text(e["company_name"])).alias("company"),
                _text(e["description"]).alias("description"),
                F.substring(tx.blank_if_null(e["end_date"]), 1, 10).alias("end_date"),
                F.coalesce(e["is_current"], F.lit(False)).alias("is_current"),
                _text(e["role"]).alias("role"),
                _sorted_set(e["skills_used"]).alias("skills_used"),
                F.substring(tx.blank_if_null(e["start_date"]), 1, 10).alias("start_date"),
            ).alias("body"),
        )
    return F.transform(F.array_sort(F.transform(entries, project)), lambda e: e["body"])


def education_value(entries: Column) -> Column:
    def project(e: Column) -> Column:
        return F.struct(
            tx.norm_company(_text(e["school_name"])).alias("school"),
            _text(e["degree"]).alias("degree"),
            _text(e["field_of_study"]).alias("field"),
            F.struct(
                _text(e["degree"]).alias("degree"),
                _text(e["field_of_study"]).alias("field"),
                tx.norm_company(_text(e["school_name"])).alias("school"),
                _sorted_set(e["skills"]).alias("skills"),
            ).alias("body"),
        )
    return F.transform(F.array_sort(F.transform(entries, project)), lambda e: e["body"])


def group_hash(group: str, value: Column) -> Column:
    """Hash of one field group of a profile; equal for edits that change nothing."""
    if group in ("headline", "about", "location"):
        return text_group_hash(value)
    if group == "skills":
        return set_group_hash(F.coalesce(value, F.array().cast("array<string>")))
    if group == "is_open_to_work":
        return flag_group_hash(value)
    if group == "experience":
        entries = experience_value(tx.norm_nested(value, EXPERIENCE_DDL))
    else:
        entries = education_value(tx.norm_nested(value, EDUCATION_DDL))
    return sha256(F.coalesce(F.to_json(entries), F.lit("[]")))
