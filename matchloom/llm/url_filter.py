"""URL filtering: longest matching rule, else boosted trees on lexical features.

All work is DataFrame expressions and Spark ML: no Python runs on the executors.
Features are length, depth, digit ratio, character entropy, parameter counts,
marks in the host, and statistics of the host's suffix.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import bounded_sample
from matchloom.session import materialised

#: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: At most this many labelled URLs are learned from, chosen by a hash.
TRAIN_ROWS = 20_000
#: Weight of the general rate beside a suffix's own.
PRIOR = 20.0
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy", "parameters",
            "query_length", "fragment", "hyphens", "signs", "last_length", "secure", "suffix_share", "suffix_rate"]


def split(url: Column) -> tuple[Column, Column, Column]:
    """Host in lower case (A-Z only), path, and the rest with query and fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substr(rest, F.char_length(raw) + 1)
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, path, F.substr(after, F.char_length(path) + 1)


def rule_for(host: Column, path: Column, rules: list[tuple] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, both null if none does.

    A rule fits its host and all subdomains where the path starts with the
    rule's.  Rules of equal length are taken in the order given.
    """
    name = verdict = F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    for kind, at, prefix in reversed(ordered):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name = F.when(fits, F.lit(at + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character; an empty text has 0."""
    n = F.char_length(text)
    share = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", (
        n - F.char_length(F.replace(text, c, F.lit("")))) / n))
    return F.coalesce(F.aggregate(share, F.lit(0.0), lambda s, p: s - F.coalesce(p * F.log2(p), F.lit(0.0))), F.lit(0.0))


def described(urls: DataFrame) -> DataFrame:
    """``_in`` (the input row), ``_host``, ``_path``, ``suffix`` and the features that need one row only."""
    host, path, tail = split(F.col("url"))
    rows = urls.select(F.struct("*").alias("_in"), F.coalesce("url", F.lit("")).alias("_url"), host.alias("_host"),
                       path.alias("_path"), tail.alias("_tail"))
    n = F.greatest(F.lit(1), F.char_length("_url"))
    query = F.regexp_extract("_tail", r"^\?([^#]*)", 1)
    count = lambda text, sign: F.regexp_count(text, F.lit(sign)).cast("double")
    columns = {
        "length": F.char_length("_url"), "host_length": F.char_length("_host"), "path_length": F.char_length("_path"),
        "depth": F.size(F.filter(F.split("_path", "/"), lambda p: p != "")), "labels": count(F.col("_host"), r"\."),
        "digit_ratio": count(F.col("_url"), "[0-9]") / n, "host_digits": count(F.col("_host"), "[0-9]"),
        "entropy": entropy(F.col("_url")), "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0),
        "query_length": F.char_length(query), "fragment": F.contains("_tail", F.lit("#")),
        "hyphens": count(F.col("_host"), "-"), "signs": count(F.col("_url"), "[%_~@=+]"),
        "last_length": F.char_length(F.substring_index("_path", "/", -1)), "secure": F.startswith("_url", F.lit("https:"))}
    return rows.select("_in", "_url", "_host", "_path", F.substring_index("_host", ".", -1).alias("suffix"),
                       *[c.cast("double").alias(k) for k, c in columns.items()])


def judge(urls: DataFrame, labels: DataFrame | None = None, rules: list[tuple] = RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` (and ``block_score``) to the input row struct ``row``.

    ``labels`` are URLs (``url``, ``block`` 0 or 1) to learn from; without them
    the URLs that a rule decides are the labelled ones.  Null URLs, and URLs
    without ``://``, have an empty host and path and go by their features.  With
    labels of one class only that class is the verdict, without any it is allow.
    """
    rows = described(urls)
    name, verdict = rule_for(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumn("_rule", name).withColumn("_verdict", verdict)
    if labels is None:
        known = rows.where("_verdict is not null").withColumn("block", (F.col("_verdict") == "block").cast("double"))
    else:
        known = described(labels.where(F.col("url").isNotNull() & F.col("block").isin(0, 1))).withColumn(
            "block", F.col("_in.block").cast("double"))
    known = known.drop("_in", "_rule", "_verdict")
    # Statistics of suffixes are taken over all rows, the trees learn from a bounded sample.
    rates = known.groupBy("suffix").agg(F.sum("block").alias("bad"), F.count(F.lit(1)).alias("seen"))
    sizes = rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    facts = rates.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen")).first()
    bad, seen = float(facts["bad"]), float(facts["seen"])
    if not 0 < bad < seen:
        score = F.lit(1.0 if seen and bad == seen else 0.0)
        return _out(rows.withColumn("block_score", score))
    total = sizes.agg(F.sum("n")).first()[0]
    suffixes = materialised(sizes.join(rates, "suffix", "left").select(
        "suffix", (F.col("n") / float(total)).alias("suffix_share"),
        ((F.coalesce("bad", F.lit(0.0)) + PRIOR * bad / seen) / (F.coalesce("seen", F.lit(0)) + PRIOR)).alias("suffix_rate")),
        "suffixes")
    vector = VectorAssembler(inputCols=FEATURES, outputCol="_vector")

    def complete(df: DataFrame) -> DataFrame:
        filled = {"suffix_share": F.coalesce("suffix_share", F.lit(0.0)), "suffix_rate": F.coalesce("suffix_rate", F.lit(bad / seen))}
        return vector.transform(df.join(suffixes, "suffix", "left").withColumns(filled))

    sample = materialised(bounded_sample(known.withColumn("_key", F.xxhash64("_url")), "_key", TRAIN_ROWS), "urls")
    if sample.select("block").distinct().count() < 2:
        return _out(rows.withColumn("block_score", F.lit(bad / seen)))
    trees = GBTClassifier(featuresCol="_vector", labelCol="block", maxIter=12, maxDepth=4, stepSize=0.3, seed=3).fit(
        complete(sample).select("_vector", "block"))
    judged = trees.transform(complete(rows))
    return _out(judged.withColumn("block_score", vector_to_array("probability")[1]))


def _out(rows: DataFrame) -> DataFrame:
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return rows.select(F.col("_in").alias("row"), F.col("_host").alias("host"), F.col("_path").alias("path"),
                       F.col("_rule").alias("rule"), F.coalesce("_verdict", own).alias("verdict"), "block_score")
