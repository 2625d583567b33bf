"""robots.txt as tables: one row of rules for each origin, joined to URLs by origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batched
from ..functions.url import let, url_parts
from ..kernel import robots as K

_RULES = "struct<rules: array<struct<allow: boolean, pattern: string, regex: string, specificity: int>>, delay: double>"


def parse(body: Column, agent: str) -> Column:
    """The rules and crawl delay for an agent; a null body allows everything."""

    def run(text: str | None) -> dict:
        r = K.rules_for(text, agent)
        return {"rules": [{"allow": a, "pattern": p, "regex": K.pattern_regex(p), "specificity": len(p.encode())} for a, p in r.rules], "delay": r.delay}

    return batched(run, _RULES)(body)


def rules(documents: DataFrame, agent: str) -> DataFrame:
    """origin, rules, delay: a row for each origin of documents (origin, body); of repeated origins the least body."""
    one = documents.groupBy("origin").agg(F.min("body").alias("body"))
    return one.select("origin", parse(F.col("body"), agent).alias("__r")).select("origin", "__r.*")


def rule_rows(documents: DataFrame, agent: str) -> DataFrame:
    """origin, pos, allow, pattern, specificity."""
    r = rules(documents, agent)
    return r.select("origin", F.posexplode("rules").alias("pos", "r")).select("origin", "pos", "r.allow", "r.pattern", "r.specificity")


def decide(target: Column, rules_: Column) -> Column:
    """The longest matching rule decides, allow before disallow; none allows.  Works on the array alone, without a second shuffle."""
    hits = let(target, lambda t: F.filter(rules_, lambda r: F.rlike(t, r["regex"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["specificity"].alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def allowed(urls: DataFrame, rules_: DataFrame, url: str = "url", name: str = "allowed") -> DataFrame:
    """urls with a column allowed; an unknown origin, or what isn't a URL, is allowed. rules_: (origin, rules, ...), a row an origin."""
    parts = urls.withColumn("__u", url_parts(F.col(url)))
    known = rules_.select(F.col("origin").alias("__origin"), F.col("rules").alias("__rules"))
    both = parts.join(known, F.col("__u.origin") == F.col("__origin"), "left")
    return both.withColumn(name, decide(F.col("__u.target"), F.col("__rules"))).drop("__u", "__origin", "__rules")


def sitemaps(documents: DataFrame) -> DataFrame:
    """origin, pos, sitemap of the Sitemap lines."""
    lines = F.split("body", r"\r?\n")
    found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)^\s*sitemap\s*:\s*([^#]*?)\s*(?:#.*)?$", 1)), lambda x: x != "")
    return documents.select("origin", F.posexplode(found).alias("pos", "sitemap"))
