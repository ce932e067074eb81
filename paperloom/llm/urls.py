"""URL filtering by association rules over tokens, and by listed host and path rules.

FP-growth mines the frequent token sets of labelled URLs; a set whose URLs carry the bad label often
enough becomes a rule.  Rules that a smaller rule implies at no less confidence are pruned.  An
inverted index from each rule's rarest token to the rule finds the candidates of a URL; those whose
other tokens are all present block it.

Null and token-less URLs have no candidates and are allowed.  Equal URLs get equal verdicts; repeated
rows repeat; an empty label table gives no rules, and an empty table of pages no rows.  URLs of any length
are whole.  Extra columns are not carried, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "!bad"


@dataclass(frozen=True)
class Listed:
    """A rule of a list: a host with its subdomains and the start of a path."""

    host: str
    path: str
    verdict: str


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, words of the path, extension, keys of the query, fragment."""
    h, p = host(url), path(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    words = F.transform(F.filter(F.split(F.lower(p), "[^\\p{L}\\p{N}]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("p="), x))
    keys = F.transform(F.regexp_extract_all(F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("")), F.lit("(?:^|&)([^=&]+)"), F.lit(1)), lambda x: F.concat(F.lit("q="), x))
    scheme = F.array(F.concat(F.lit("s="), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("#")))
    none = F.array().cast("array<string>")
    parts = [F.coalesce(x, none) for x in (scheme, F.transform(labels, lambda x: F.concat(F.lit("h="), x)), words, keys, mark)]
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(*parts))).otherwise(none)


def mine(urls: DataFrame, bad: str = "bad", support: float = 0.002, least: int = 5, confidence: float = 0.5) -> DataFrame:
    """Rules (rule_id, items, key, confidence, support) from rows (url, bad boolean); rows without a label or tokens are left out.

    A rule's token set stands with the bad label in at least ``support`` of the rows and in ``least``
    rows, and at least ``confidence`` of the rows with the set are bad.
    """
    rows = urls.where(F.col(bad).isNotNull()).select(tokens(F.col("url")).alias("items"), bad).where(F.size("items") > 0)
    baskets = rows.select(F.when(F.col(bad), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    n = baskets.count()
    spark = urls.sparkSession
    schema = "rule_id string, items array<string>, key string, confidence double, support double"
    if not n:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    smaller = found.select(F.col("items").alias("_few"), F.col("confidence").alias("_sure"))
    part = smaller.select("*", F.element_at("_few", 1).alias("_key"))
    probe = found.select("*", F.explode("items").alias("_key")).join(part, "_key")
    implied = probe.where((F.size("_few") < F.size("items")) & (F.size(F.array_except("_few", "items")) == 0) & (F.col("_sure") >= F.col("confidence"))).select("items").distinct()
    kept = found.join(implied, "items", "left_anti")
    seen = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("_key"), "freq")
    rare = kept.select("items", F.explode("items").alias("_key")).join(seen, "_key").groupBy("items").agg(F.min_by("_key", F.struct("freq", "_key")).alias("key"))
    return kept.join(rare, "items").select(F.sha2(F.array_join("items", "\n"), 256).alias("rule_id"), "items", "key", "confidence", "support")


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence, support, rule_id) of each distinct URL that a rule fits: its most confident rule, then the lowest id."""
    distinct = urls.select("url").where("url IS NOT NULL").distinct().select("url", tokens(F.col("url")).alias("_tokens"))
    index = rules.select("rule_id", "items", "support", F.col("key").alias("_key"), F.col("confidence").alias("_sure"))
    near = distinct.select("*", F.explode("_tokens").alias("_key")).join(index, "_key")
    fits = near.where(F.size(F.array_except("items", "_tokens")) == 0)
    best = F.min_by(F.struct(F.col("_sure").alias("confidence"), "support", "rule_id"), F.struct(-F.col("_sure"), F.col("rule_id")))
    return fits.groupBy("url").agg(best.alias("b")).select("url", "b.*")


def listed_rule(h: Column, p: Column, rules: list[Listed]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls; of equal length the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((h == r.host) | h.endswith(f".{r.host}")) & p.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labelled: DataFrame, listed: list[Listed], **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence, support) of every page; labelled: (url, bad).

    mined_rule is the id of the mined rule that fits best, whether or not a listed rule decides.
    """
    bad = blocked(pages, mine(labelled, **mining)).select(F.col("url").alias("_url"), F.col("rule_id").alias("mined_rule"), "confidence", "support")
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    rows = pages.select("page_id", "url").join(bad, F.col("url") == F.col("_url"), "left").select("page_id", h.alias("host"), p.alias("path"), "mined_rule", "confidence", "support")
    own = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mined_rule", "confidence", "support")
