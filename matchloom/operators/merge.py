"""Merge policies for list fields, as aggregates per entry key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import hashing as hs
from matchloom.functions import text as tx
from matchloom.operators.skew import carry_last

# ---------------------------------------------------------------- fixed values
# Fields of an experience entry that a newer observation may overwrite.
ENTRY_FIELDS = ["role", "end_date", "is_current", "duration_months", "job_type", "work_type",
                "location", "description", "skills_used"]
# ------------------------------------------------------------ end fixed values


def present(c: Column, is_list: bool) -> Column:
    """Null, and an empty list, mean "not observed"."""
    return c.isNotNull() & (F.size(c) > 0) if is_list else c.isNotNull()


def merge_by_key(entries: DataFrame, key: list[str], order: list[str], fields: list[str],
                 keep_first: list[str] | None = None) -> DataFrame:
    """Merged entries: per key and field the newest observed value; nothing is deleted.

    ``entries`` is stored and observed entries together, ``order`` their
    processing order.  ``keep_first`` fields stay as first seen.
    """
    lists = {f.name for f in entries.schema.fields if f.dataType.typeName() == "array"}
    at = F.struct(*[F.col(c) for c in order])
    newest = [F.max_by(f, F.when(present(F.col(f), f in lists), at)).alias(f) for f in fields]
    oldest = [F.min_by(f, at).alias(f) for f in (keep_first or [])]
    # A field only ever seen empty stays an empty list.
    blanks = [F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f"_e_{f}")
              for f in fields if f in lists]
    out = entries.groupBy(*key).agg(*newest, *oldest, *blanks)
    for f in fields:
        if f in lists:
            out = out.withColumn(f, F.coalesce(f, f"_e_{f}")).drop(f"_e_{f}")
    return out


def merge_append(stored: DataFrame, observed: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Stored rows plus the first observed row of each key not stored yet."""
    fresh = observed.join(stored.select(*key).distinct(), key, "left_anti")
    packed = F.struct(*[F.col(c) for c in observed.columns])
    first = fresh.groupBy(*key).agg(F.min_by(packed, order).alias("_r")).select("_r.*")
    return stored.unionByName(first)


def entry_key(company: Column, start: Column) -> list[Column]:
    return [tx.norm_company(tx.norm_text(company)).alias("company_key"),
            F.substring(tx.blank_if_null(start), 1, 10).alias("start_key")]


def list_change_kind(stored: DataFrame, observed: DataFrame, by: str, key: list[str],
                     was_current: str, ended: str) -> DataFrame:
    """new_role, current_role_ended or entry_updated per entity with observed entries."""
    old = stored.groupBy(by, *key).agg(F.bool_or(was_current).alias("_was"))
    met = observed.select(by, *key, F.col(ended).isNotNull().alias("_ended")).join(
        old, [by] + key, "left")
    rolled = met.groupBy(by).agg(
        F.bool_or(F.col("_was").isNull()).alias("_new"),
        F.bool_or(F.coalesce("_was", F.lit(False)) & F.col("_ended")).alias("_stop"))
    return rolled.select(by, F.when(F.col("_new"), "new_role").when(
        F.col("_stop"), "current_role_ended").otherwise("entry_updated").alias("kind"))


def running_total(df: DataFrame, key: list[str], bucket: Column, order: list[str], n: str,
                  name: str) -> DataFrame:
    """Sum of ``n`` over strictly earlier rows of the key, by bucket then inside it."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    cells = rows.groupBy(*key, "_bucket").agg(F.sum(n).alias("_n")).select(
        *key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(
        cells, key + ["_bucket"]).withColumn(name, F.col("_in") + F.col("_before")).drop(
        "_in", "_before", "_bucket")


def experience_changes(records: DataFrame, base_entries: DataFrame) -> DataFrame:
    """noise / applied and the list kind for each accepted experience record.

    records(entity, observed_at, ordinal, entries) are accepted (not stale, not
    null); base_entries(entity, and the entry fields) is the stored list.  The
    observed list is noise when each of its entries equals the merged entry of
    its key and the merged list holds no other key.  Both follow from the
    newest earlier value per (entity, entry key, field), so no list is folded.
    """
    order = ["observed_at", "ordinal", "pos"]
    seen = records.select("entity", "observed_at", "ordinal",
                          F.posexplode("entries").alias("pos", "e")).select(
        "entity", "observed_at", "ordinal", "pos", "e.*", F.lit(True).alias("observed"))
    stored = base_entries.select(
        "entity", F.lit("").alias("observed_at"), F.lit(-1).cast("bigint").alias("ordinal"),
        F.lit(0).alias("pos"), "company_name", "start_date", *ENTRY_FIELDS,
        F.lit(False).alias("observed"))
    both = stored.unionByName(seen.select(*stored.columns))
    both = both.select("*", *entry_key(F.col("company_name"), F.col("start_date")))
    skills = F.array_join(hs.set_group_value(F.col("skills_used")), "\u0001")
    # The projection that decides equality, one text per field; null is "not observed".
    view = {
        "v_role": tx.norm_text(F.col("role")), "v_end": F.substring("end_date", 1, 10),
        "v_current": F.col("is_current").cast("string"),
        "v_description": tx.norm_text(F.col("description")), "v_skills": skills,
    }
    raw = {"v_role": F.col("role").isNotNull(), "v_end": F.col("end_date").isNotNull(),
           "v_current": F.col("is_current").isNotNull(),
           "v_description": F.col("description").isNotNull(),
           "v_skills": F.size("skills_used") > 0}
    rows = both.select("entity", "company_key", "start_key", "observed_at", "ordinal", "pos",
                       "observed", *[c.alias(n) for n, c in view.items()],
                       *[F.coalesce(c, F.lit(False)).alias(f"has_{n}") for n, c in raw.items()])
    key = ["entity", "company_key", "start_key"]
    bucket = F.substring("observed_at", 1, 7)
    for n in view:
        rows = carry_last(rows, key, bucket, order, F.col(f"has_{n}"), {f"was_{n}": F.col(n)})
    firsts = rows.groupBy(*key).agg(F.min(F.struct("observed_at", "ordinal")).alias("_f"))
    rows = rows.join(firsts, key)
    at = F.struct("observed_at", "ordinal")
    blank = {"v_current": "false"}
    same = F.col("_f") < at
    for n in view:
        default = F.lit(blank.get(n, ""))
        now = F.when(F.col(f"has_{n}"), F.col(n)).otherwise(default)
        same = same & (now == F.coalesce(f"was_{n}", default))
    met = rows.where("observed").groupBy("entity", "observed_at", "ordinal").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(same).alias("_same"),
        F.bool_or(F.col("_f") >= at).alias("_new"),
        F.bool_or((F.col("_f") < at) & (F.coalesce("was_v_current", F.lit("false")) == "true")
                  & F.col("has_v_end") & (F.col("v_end") != "")).alias("_stop"))
    # Keys known before each record: births summed over earlier times.
    births = firsts.groupBy("entity", F.col("_f.observed_at").alias("observed_at"),
                            F.col("_f.ordinal").alias("ordinal")).agg(
        F.count(F.lit(1)).alias("_born"))
    met = records.select("entity", "observed_at", "ordinal").join(
        met, ["entity", "observed_at", "ordinal"], "left")
    timeline = met.join(births, ["entity", "observed_at", "ordinal"], "full_outer").fillna(
        0, ["_born", "_n"])
    timeline = running_total(timeline, ["entity"], bucket, ["observed_at", "ordinal"], "_born",
                             "_known")
    noise = F.coalesce("_same", F.lit(True)) & (F.col("_n") == F.col("_known"))
    return timeline.where(F.col("ordinal") >= 0).select(
        "entity", "observed_at", "ordinal",
        F.when(noise, "noise").otherwise("applied").alias("change"),
        F.when(F.coalesce("_new", F.lit(False)), "new_role")
        .when(F.coalesce("_stop", F.lit(False)), "current_role_ended")
        .otherwise("entry_updated").alias("list_kind"))
