"""URL filters: host and path rules, and gradient-boosted trees for what no rule decides.

The trees see lexical features only: lengths, depth, digit ratio, entropy, parameter counts, and how
often the host's suffix is blocked among labelled URLs. Labels are the rules' own verdicts unless
a table of labelled URLs is given.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.scratch import materialize

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled URLs that the trees are fitted on at most: those with the smallest hash.
FIT_ROWS = 20_000
FEATURES = ("length", "host_length", "host_labels", "depth", "digits", "entropy", "parameters", "hyphens", "fragment", "suffix_rate", "suffix_log")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as ``host`` + ``path``) and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(of + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: F.when(c == "", acc).otherwise(acc - share(c) * F.log2(share(c))))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda pattern: F.regexp_count(url, F.lit(pattern)).cast("double")
    return {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "host_labels": F.regexp_count(host, F.lit(r"\.")).cast("double"), "depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "digits": count("[0-9]") / n, "entropy": entropy(url), "parameters": count(r"[?&][^=&#]*="),
        "hyphens": count("-"), "fragment": count("#"),
    }


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, limit: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and ``score`` (the trees' probability of a block; null under a rule).

    ``labelled`` (url, block 0/1) replaces the rules' verdicts as training rows; the trees are fitted
    on at most ``limit`` of them, taken by hash, while suffix rates come from all. Without labels of
    both kinds every undecided URL gets the commoner verdict, allow on a tie. A null url, or one
    without ``://``, has an empty host and path, no rule, and is judged by its other features. Repeated
    rows repeat, no rows give no rows. Other columns are not read.
    """
    parts = pages.select("page_id", F.col("url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule_column(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "url", "host", "path", name.alias("rule"), verdict.alias("given"))
    if labelled is None:
        marked = parts.where("given is not null").select("url", "host", "path", F.when(F.col("given") == "block", 1.0).otherwise(0.0).alias("label"))
    else:
        marked = labelled.where("block in (0, 1)").select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("block").cast("double").alias("label"))
    suffix = F.substring_index("host", ".", -1).alias("suffix")
    rates = marked.groupBy(suffix).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    rates = materialize(rates, "suffixes")
    n, blocked = rates.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    result = ["page_id", "host", "path", "rule"]
    if blocked == 0 or blocked == n:
        other = "block" if n and blocked == n else "allow"
        return parts.select(*result, F.coalesce("given", F.lit(other)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    prior = blocked / n

    def featured(rows: DataFrame, keep: list) -> DataFrame:
        with_rate = rows.select("*", suffix).join(rates, "suffix", "left")
        stats = {
            "suffix_rate": (F.coalesce("blocked", F.lit(0.0)) + prior) / (F.coalesce("n", F.lit(0)) + 1),
            "suffix_log": F.log1p(F.coalesce(F.col("n"), F.lit(0)).cast("double")) / math.log(n + 2),
        }
        values = lexical(F.col("url"), F.col("host"), F.col("path")) | stats
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
            with_rate.select(*keep, *[c.alias(k) for k, c in values.items()])
        ).select(*keep, "features")

    some = marked.orderBy(F.xxhash64("url", "label"), "url", "label").limit(limit).coalesce(1)
    some = featured(materialize(some, "labelled-urls"), ["label"])
    model = GBTClassifier(maxIter=12, maxDepth=4, maxBins=32, seed=11, cacheNodeIds=False).fit(materialize(some.coalesce(2), "features"))
    scored = model.transform(featured(parts.where("given is null"), result)).select(
        *result, vector_to_array("probability")[1].alias("score")
    )
    decided = parts.where("given is not null").select(*result, F.col("given").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return decided.union(scored.select(*result, F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("verdict"), "score"))
