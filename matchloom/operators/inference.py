"""Tables around an external text model: prompts, work lists and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
ENTRY_LINE = "- %s at %s (%s to %s, %s months): %s [%s]"
# ------------------------------------------------------------ end fixed values


def entry_line(role: Column, company: Column, start: Column, end: Column, months: Column,
               description: Column, skills: Column) -> Column:
    return F.format_string(
        ENTRY_LINE, F.coalesce(role, F.lit("None")), F.coalesce(company, F.lit("None")),
        F.coalesce(start, F.lit("None")), F.coalesce(F.nullif(end, F.lit("")), F.lit("present")),
        F.coalesce(months.cast("string"), F.lit("None")), F.coalesce(description, F.lit("")),
        F.array_join(F.coalesce(skills, F.array().cast("array<string>")), ", "))


def prompt(headline: Column, skills: Column, lines: Column, instruction: str, question: str) -> Column:
    """Deterministic prompt text of one profile; ``lines`` are its entry lines in order."""
    body = F.array_join(lines, "\n")
    return F.concat(
        F.lit(instruction + "\n\nProfile:\nheadline: "), F.coalesce(headline, F.lit("")),
        F.lit("\nskills: "), F.array_join(skills, ", "), F.lit("\nexperience:\n"),
        F.when(body != "", body).otherwise("- none listed"), F.lit("\n\n" + question))


def cache_key(model: str, prompt_text: Column, schema: str) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(model), prompt_text, F.lit(schema)), 256)


def misses(work: DataFrame, key: str, replies: DataFrame) -> DataFrame:
    """Distinct keys not answered before."""
    return work.dropDuplicates([key]).join(replies.select(key), key, "left_anti")


def reply_json(reply: Column) -> Column:
    """The text from the first brace to the last, or null."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def parse_reply(df: DataFrame, reply: str, schema: str, field: str, allowed: DataFrame) -> DataFrame:
    """Adds the parsed fields, valid_json, and valid_value (the field is in ``allowed``)."""
    cut = df.withColumn("_cut", reply_json(F.col(reply)))
    ok = F.try_parse_json("_cut").isNotNull()
    parsed = cut.withColumn("valid_json", ok).withColumn(
        "_j", F.when(ok, F.from_json("_cut", schema)))
    listed = allowed.select(F.col(field).alias("_v"), F.lit(True).alias("_known")).distinct()
    rows = parsed.select(*df.columns, "valid_json", "_j.*")
    return rows.join(listed, F.col(field) == F.col("_v"), "left").withColumn(
        "valid_value", F.coalesce("_known", F.lit(False))).drop("_v", "_known")
