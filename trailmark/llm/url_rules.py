"""URL filters by association rules.

Native: SQL functions, joins and Spark's FP-growth.  Explicit host and path rules label some URLs; the
token combinations that go with the label block are mined, pruned by support and confidence, and judge
the URLs that no explicit rule fits.  URLs without a label count against a combination, so it must be
blocked wherever it is seen, not only where somebody looked.  A mined rule is found through its rarest
token.

A rule that contains a smaller rule says nothing new, and one of two tokens that are always seen
together says as much as both.  So tokens that are rules alone, tokens too rare to be in any rule and
all but one of such twins are left out before mining, which keeps the number of combinations small.  FP-growth
makes every frequent combination, up to 2^k of k tokens of one URL, so where a URL has more than WIDE tokens left the
combinations are made level by level, and one that is a rule, or is seen as often as a part of it, is never extended.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, settle

#: Fixed values: (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
SUPPORT, CONFIDENCE = 0.01, 0.6
#: Tokens of one URL, left after pruning, up to which FP-growth makes all combinations.
WIDE = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)\??([^#]*)"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _SHAPE, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SHAPE, 2), F.lit(""))


def explicit_rule(host: Column, path: Column, rules: Sequence = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule whose host is the URL's or a parent of it and whose path
    starts the URL's; null where none fits.  Of equally long rules the first by name wins."""
    name = verdict = F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name = F.when(fits, own + start).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def _tagged_with(tag: str):
    return lambda x: F.concat(F.lit(tag), x)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, path segments with digits as #, names of query parameters."""
    tagged = []
    for tag, text, cut in (
        ("h=", host_of(url), r"\."),
        ("p=", F.regexp_replace(path_of(url), "[0-9]+", "#"), "/"),
        ("q=", F.regexp_replace(F.coalesce(F.regexp_extract(url, _SHAPE, 3), F.lit("")), "=[^&]*", ""), "&"),
    ):
        found = F.filter(F.split(text, cut), lambda x: x != "")
        tagged.append(F.transform(found, _tagged_with(tag)))
    return F.array_distinct(F.concat(*tagged))


def _each_token(seen: DataFrame) -> DataFrame:
    numbered = seen.withColumn("id", F.monotonically_increasing_id())  # before rows are multiplied
    return numbered.select("id", "verdict", F.explode("tokens").alias("token"))


def token_counts(seen: DataFrame) -> DataFrame:
    """(token, n, blocked, twin): in how many URLs a token is, how many of these are blocked, and the smallest token
    that is in exactly the same URLs."""
    each = _each_token(seen)
    wide = "decimal(38,0)"
    counts = each.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"),
        F.sum(F.xxhash64("id").cast(wide)).alias("a"), F.sum(F.xxhash64("id", F.lit(1)).cast(wide)).alias("b"),
    )
    twins = counts.groupBy("n", "a", "b").agg(F.min("token").alias("twin"))
    return counts.join(twins, ["n", "a", "b"]).select("token", "n", "blocked", "twin")


def mine(seen: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, support): the smallest token combinations that go with the verdict block.

    ``seen`` has tokens and verdict, null where there is no label.  A rule that contains a smaller kept
    rule says nothing new and goes; of rules that differ only in twins the one of the smallest tokens is
    given.  No blocked row gives no rules.
    """
    spark = seen.sparkSession
    total, blocked = seen.agg(F.count("*"), F.count_if(F.col("verdict") == "block")).first()
    need = max(1, math.ceil(Fraction(str(support)) * total))
    if blocked < need:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    counts = settle(token_counts(seen).where(F.col("blocked") >= need))
    alone = F.col("blocked") / F.col("n") >= confidence
    single = counts.where(alone).select(
        F.array("token").alias("antecedent"), (F.col("blocked") / F.col("n")).alias("confidence"), (F.col("blocked") / total).alias("support")
    )
    # a token here has `need` blocked URLs, so there are at most 1 / support times the tokens of a URL
    open_tokens = counts.where(~alone & (F.col("token") == F.col("twin"))).select("token")
    each = _each_token(seen)
    says = F.when(F.col("verdict") == "block", F.array(F.lit("verdict=block"))).otherwise(F.array().cast("array<string>"))
    baskets = each.join(open_tokens, "token").groupBy("id").agg(F.collect_set("token").alias("tokens"), F.first("verdict").alias("verdict"))
    baskets = settle(baskets.where("size(tokens) > 1").select("id", F.concat("tokens", says).alias("items")))
    n, widest = baskets.agg(F.count("*"), F.max(F.size(F.array_remove("items", "verdict=block")))).first()
    if n < need:
        return single
    larger = _grown(baskets, n, need, confidence) if widest <= WIDE else _by_levels(baskets, need, confidence)
    return single.unionByName(larger.select("antecedent", "confidence", (F.col("blocked") / total).alias("support")))


def _grown(baskets: DataFrame, n: int, need: int, confidence: float) -> DataFrame:
    """(antecedent, confidence, blocked) of the smallest rules of two tokens or more, by FP-growth."""
    model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / n, minConfidence=confidence).fit(baskets)
    kept = model.associationRules.where(
        (F.col("consequent") == F.array(F.lit("verdict=block"))) & (F.size("antecedent") > 1) & ~F.array_contains("antecedent", "verdict=block")
    )
    rules = settle(kept.select(F.array_sort("antecedent").alias("antecedent"), "confidence", F.round(F.col("support") * n).alias("blocked")))
    small = rules.select(F.col("antecedent").alias("small"), F.element_at("antecedent", 1).alias("token"))
    large = rules.withColumn("token", F.explode("antecedent"))
    hidden = (
        large.join(small, "token")
        .where((F.size("small") < F.size("antecedent")) & (F.size(F.array_except("small", "antecedent")) == 0))
        .select("antecedent")
        .distinct()
    )
    return rules.join(hidden, "antecedent", "left_anti")


def _by_levels(baskets: DataFrame, need: int, confidence: float) -> DataFrame:
    """What :func:`_grown` gives, a level a round: open sets of k tokens that agree but for the last make one of k + 1, if
    all its parts are open.

    A set is open if it is frequent, no rule, and seen less often than each of its parts.  What is seen as often as a
    part is in the same URLs, so a rule with it is one without, and smaller.
    """
    block = "verdict=block"
    urls = baskets.select(
        "id", F.array_contains("items", block).alias("blocked"), F.array_sort(F.array_remove("items", block)).alias("tokens")
    )
    seen = settle(urls.select("id", "blocked", "tokens", F.explode(F.transform("tokens", lambda t: F.array(t))).alias("set")))
    open_sets = settle(seen.groupBy("set").agg(F.count("*").alias("n")))
    rules = []
    while True:
        stem, last = F.slice("set", 1, F.size("set") - 1), F.element_at("set", -1)
        ends = open_sets.select(stem.alias("stem"), last.alias("last"))
        pairs = ends.join(ends.withColumnRenamed("last", "next"), "stem").where("last < next")
        made = pairs.select(F.concat("stem", F.array("last", "next")).alias("set"))
        place = F.sequence(F.lit(1), F.size("set"))
        without = F.transform(place, lambda i: F.concat(F.slice("set", 1, i - 1), F.slice("set", i + 1, F.size("set"))))
        part = made.select("set", F.explode(without).alias("part")).join(open_sets.select(F.col("set").alias("part"), "n"), "part")
        whole = part.groupBy("set").agg(F.count("*").alias("parts"), F.min("n").alias("least")).where(F.col("parts") == F.size("set"))
        asked = settle(whole.select("set", "least"))
        if asked.isEmpty():
            break
        grown = seen.select("id", "blocked", "tokens", "set", F.explode(F.filter("tokens", lambda t: t > F.element_at("set", -1))).alias("token"))
        grown = grown.select("id", "blocked", "tokens", F.concat("set", F.array("token")).alias("set"))
        met = settle(grown.join(bounded(asked, 1 << 16), "set"))
        counts = met.groupBy("set", "least").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b")).where(F.col("b") >= need)
        counts = settle(counts.withColumn("confidence", F.col("b") / F.col("n")))
        rules.append(counts.where(F.col("confidence") >= confidence).select(F.col("set").alias("antecedent"), "confidence", F.col("b").alias("blocked")))
        before = seen, open_sets, asked, met
        open_sets = settle(counts.where((F.col("confidence") < confidence) & (F.col("n") < F.col("least"))).select("set", "n"))
        seen = settle(met.join(open_sets.select("set"), "set", "left_semi").select("id", "blocked", "tokens", "set"))
        for df in before:
            forget(baskets.sparkSession, df)
    if not rules:
        return baskets.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, blocked double")
    return reduce(DataFrame.unionByName, rules)


def matches(urls: DataFrame, rules: DataFrame, seen: DataFrame) -> DataFrame:
    """(url, mined_rule) of the distinct ``urls`` (url, tokens) that contain a rule's tokens; of several
    rules the first by text.  The index lists every rule under the token rarest in ``seen``."""
    named = rules.select(F.array_join("antecedent", " ").alias("mined_rule"), "antecedent")
    counts = seen.select(F.explode("tokens").alias("token")).groupBy("token").count()
    index = (
        named.withColumn("token", F.explode("antecedent"))
        .join(counts, "token")
        .groupBy("mined_rule")
        .agg(F.min_by("token", F.struct("count", "token")).alias("token"), F.first("antecedent").alias("antecedent"))
    )
    return (
        urls.withColumn("token", F.explode("tokens"))
        .join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("url")
        .agg(F.min("mined_rule").alias("mined_rule"))
    )


def judge(
    pages: DataFrame, rules: Sequence = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE
) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of every page.

    A page has the verdict of its explicit rule, else block if a mined rule fits its URL, else allow.
    Null URLs and those without :// have empty host and path, fit no rule and are allowed.  Repeated
    pages give repeated rows; an empty table gives none; other columns are left behind.
    """
    url = F.col("url")
    name, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)})
    seen = seen.withColumns({"rule": name, "own": verdict})
    baskets = seen.where("host <> ''").select(tokens_of(url).alias("tokens"), F.col("own").alias("verdict"))
    open_urls = seen.where("own is null and host <> ''").select("url").distinct()
    open_urls = open_urls.withColumn("tokens", tokens_of(url))
    found = matches(open_urls, mine(baskets, support, confidence), baskets)
    said = F.coalesce("own", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return seen.join(found, "url", "left").select(
        "page_id", "host", "path", "rule", said.alias("verdict"),
        F.when(F.col("own").isNull(), F.col("mined_rule")).alias("mined_rule"),
    )
