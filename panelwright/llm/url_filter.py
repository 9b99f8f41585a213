"""URL filtering by association rules, with DataFrame functions and Spark's FP-growth.

Listed rules (host and path prefixes) decide the URLs they fit. From those labelled URLs
FP-growth mines combinations of URL tokens that go with a verdict. Rules are pruned by support
and confidence, and a rule that adds nothing to a shorter one is dropped. Every other URL is
judged by the mined rules: its tokens meet an inverted index (token to rules), and a rule
applies when all its tokens are met.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import lower_ascii, stash, unit_draw

#: Listed rules of the filter: verdict, host, path.
LISTED = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
#: Labelled URLs that rules are mined from (drawn by id): the documented bound of the fit.
FIT_URLS = 100_000
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 0.75, 3
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Null, or no ``://``, has both empty."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, listed=LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits and its verdict, or nulls.

    A rule fits its host and every subdomain if the path starts with the rule's. Longest counts
    the characters of host and path together; of equally long ones the first in order wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(listed, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    for kind, h, p in reversed(order):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: its host labels (the last two by place), path parts, query names."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    tagged = F.concat(
        F.transform(F.slice(F.reverse(labels), 1, 2), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)),
        F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x)),
        F.transform(
            F.filter(F.split(lower_ascii(path), r"[/._-]"), lambda x: (x != "") & ~F.rlike(x, F.lit(r"\A[0-9]+\z"))),
            lambda x: F.concat(F.lit("p:"), x),
        ),
        F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x)),
    )
    return F.array_distinct(tagged)


def mine(labelled: DataFrame, size: int = FIT_URLS, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``rule_id, parts, verdict, confidence, support`` from ``labelled(page_id, parts, verdict)``.

    Mined from about ``size`` rows, drawn by a hash of the id. No labelled rows give no rules.
    """
    n = labelled.count()
    drawn = labelled.where(unit_draw(F.col("page_id"), "rules") < min(1.0, size / max(1, n)))
    baskets = stash(drawn.select(F.array_append("parts", F.concat(F.lit("="), "verdict")).alias("items")), "baskets")
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    rules = stash(
        found.where(F.size("consequent") == 1).where(F.startswith(F.col("consequent")[0], F.lit("=")))
        .where(F.size("antecedent") <= MAX_TOKENS)
        .select(
            F.array_sort("antecedent").alias("parts"), F.substring(F.col("consequent")[0], 2, 99).alias("verdict"),
            "confidence", "support",
        ), "rules",
    )
    # a rule falls if one of its parts alone says the same at least as surely
    shorter = rules.where(F.size("parts") == 1).select(
        F.col("parts")[0].alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c")
    )
    long = rules.where(F.size("parts") > 1)
    worse = (
        long.withColumn("part", F.explode("parts")).join(shorter, "part")
        .where("v = verdict and c >= confidence").select("parts", "verdict").distinct()
    )
    kept = long.join(worse, ["parts", "verdict"], "left_anti").unionByName(rules.where(F.size("parts") == 1))
    return stash(kept.select(
        F.xxhash64("parts", "verdict").alias("rule_id"), "parts", "verdict", "confidence", "support"
    ), "mined")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", listed=LISTED, size: int = FIT_URLS) -> DataFrame:
    """Per row: ``page_id, host, path, rule, verdict, mined`` (the mined rule's tokens, if one decided).

    A listed rule decides where one fits. Elsewhere the mined rule of highest confidence does
    (then support, then fewer tokens, then the tokens in order), and without any the default,
    ``allow``. A null or odd URL has empty host and path; repeated rows are judged alike.
    Verdicts are worked out once per distinct set of tokens.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u"), host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    rows = stash(
        rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"),
                    F.array_sort(tokens(F.col("u"), F.col("host"), F.col("path"))).alias("parts")), "urls",
    )
    rules = mine(rows.where("rule is not null").select("page_id", "parts", F.col("listed").alias("verdict")), size)

    # inverted index: each token of the open URLs against the rules that need it
    open_sets = rows.where("rule is null").select("parts").distinct().withColumn("set_id", F.xxhash64("parts"))
    index = rules.select("rule_id", F.size("parts").alias("need"), F.explode("parts").alias("token"))
    met = (
        open_sets.select("parts", F.explode("parts").alias("token")).join(index, "token")
        .groupBy("parts", "rule_id", "need").count().where("count = need")
    )
    best = met.join(rules.withColumnRenamed("parts", "mined"), "rule_id").groupBy("parts").agg(
        F.max_by(F.struct("verdict", "mined"), F.struct(
            "confidence", "support", (-F.size("mined")).alias("short"), F.array_join("mined", " ").alias("name")
        )).alias("best")
    )
    best = stash(best.select("parts", "best.verdict", "best.mined"), "verdicts")
    out = rows.join(best, "parts", "left")
    open_row = F.col("rule").isNull()
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", "verdict", F.lit(DEFAULT)).alias("verdict"),
        F.when(open_row, F.col("mined")).alias("mined"),
    )
