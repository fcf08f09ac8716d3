"""URL filters: pattern rules indexed by their rarest literal token.

Each rule names literal tokens that every URL it matches must contain as whole runs of a-z and 0-9. The rule is filed
under the one of them that is rarest among the URLs at hand; a URL's own tokens fetch the candidate rules, and only those
run: regular expressions over the lower-cased URL, or comparisons of host and path. Host and path rules are filed in the
same index, under a token of their host.

Defined results: a null URL or one without `://` has empty host and path and fits no host rule; null fits no rule at all.
What no rule fits is allowed. Repeated rows are judged alike, one row out for each row in; a URL is judged whole, however
long. Of equally long host rules, and of pattern rules, the greatest name is reported. An empty table gives an empty
result. Columns of `pages` other than page_id and url, of whatever name, aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: More rules than this are joined to URL tokens as a table; up to it they are a literal in each task's plan.
LITERAL_RULES = 2000
#: Host and path rules with their verdicts.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Pattern rules (name, pattern over the lower-cased URL, tokens that a match contains as whole runs).
PATTERN_RULES = (
    ("binary", r"^[^?#]*\.(exe)(\?|#|\z)", ("exe",)),
    ("archive", r"^[^?#]*\.(zip)(\?|#|\z)", ("zip",)),
    ("login", r"/wp-login\.php", ("wp", "login")),
    ("admin", r"/wp-admin/", ("wp", "admin")),
    ("ad-server", r"://([^/?#]*\.)?doubleclick\.", ("doubleclick",)),
    ("casino", r"://([^/?#]*[^a-z0-9_/?#])?casino([^a-z0-9_]|\z)", ("casino",)),
    ("adult", r"://([^/?#]*[^a-z0-9_/?#])?porn([^a-z0-9_]|\z)", ("porn",)),
)
RULE = "struct<name: string, verdict: string, weight: int, pattern: string, host: string, path: string>"


@dataclass(frozen=True)
class Rule:
    """name is what a match reports; tokens are runs of a-z and 0-9 that any match contains, weight orders the winners.

    A rule has a pattern, or a host (which stands for its subdomains as well) and the begin of a path.
    """

    name: str
    verdict: str
    tokens: tuple[str, ...]
    pattern: str | None = None
    host: str | None = None
    path: str | None = None
    weight: int = 0


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains whose path starts with the given one; the longest rule wins."""
    return Rule(host + path, verdict, tuple(re.findall("[a-z0-9]+", host)), host=host, path=path, weight=len(host + path))


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [Rule(n, "block", t, p) for n, p, t in PATTERN_RULES]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(low: Column) -> Column:
    """The distinct runs of a-z and 0-9 of a lower-cased URL."""
    return F.array_distinct(F.split(low, "[^a-z0-9]+"))


def fits(rule: Column, low: Column, host: Column, path: Column) -> Column:
    of_host = ((host == rule["host"]) | F.endswith(host, F.concat(F.lit("."), rule["host"]))) & F.startswith(path, rule["path"])
    return F.when(rule["host"].isNotNull(), of_host).otherwise(F.rlike(low, rule["pattern"]))


def token_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs; as many rows as the rules have tokens, whatever the input."""
    wanted = sorted({t for r in rules for t in r.tokens})
    found = urls.select(F.explode(F.array_intersect(tokens_of(F.col("low")), F.lit(wanted))).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()} if wanted else {}


def judge(pages: DataFrame, rules: list[Rule] | None = None, literal_rules: int = LITERAL_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern_rule for each row of pages."""
    rules = default_rules() if rules is None else rules
    url = F.col("url")
    low, host, path = F.col("low"), F.col("host"), F.col("path")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), ascii_lower(F.coalesce(url, F.lit(""))).alias("low"))
    counts = token_counts(base, rules)
    filed = [(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), r) for r in rules]
    # a rule whose token no URL has can match none
    filed = [(t, r) for t, r in filed if counts.get(t, 0)]

    def best(of_host: bool) -> Column:
        own = F.filter("matches", lambda r: r["host"].isNotNull() == F.lit(of_host))
        return F.array_max(F.transform(own, lambda r: F.struct(r["weight"], r["name"], r["verdict"])))

    if not filed:
        hit = base.withColumn("matches", F.lit(None).cast(f"array<{RULE}>"))
    elif len(filed) <= literal_rules:
        by_token: dict[str, list[Rule]] = {}
        for token, rule in filed:
            by_token.setdefault(token, []).append(rule)

        def literal(r: Rule) -> Column:
            values = {"name": r.name, "verdict": r.verdict, "weight": r.weight, "pattern": r.pattern, "host": r.host, "path": r.path}
            return F.struct(*[F.lit(v).cast("int" if k == "weight" else "string").alias(k) for k, v in values.items()])

        index = F.create_map(*[x for t, rs in by_token.items() for x in (F.lit(t), F.array(*map(literal, rs)))])
        fetched = F.array_intersect(tokens_of(low), F.lit(sorted(by_token)))
        candidates = F.flatten(F.transform(fetched, lambda t: F.element_at(index, t)))
        hit = base.withColumn("matches", F.filter(candidates, lambda r: fits(r, low, host, path)))
    else:
        rows = [(t, (r.name, r.verdict, r.weight, r.pattern, r.host, r.path)) for t, r in filed]
        table = pages.sparkSession.createDataFrame(rows, f"token string, rule {RULE}")
        seen = base.select("low", "host", "path").distinct().select("low", "host", "path", F.explode(tokens_of(low)).alias("token"))
        matched = seen.join(table, "token").where(fits(F.col("rule"), low, host, path))
        matched = matched.groupBy("low", "host", "path").agg(F.collect_set("rule").alias("matches"))
        hit = base.join(matched, ["low", "host", "path"], "left")
    hit = hit.withColumn("by_host", best(True)).withColumn("by_pattern", best(False))
    return hit.select(
        "page_id", "host", "path", F.col("by_host.name").alias("rule"),
        F.coalesce(F.col("by_host.verdict"), F.col("by_pattern.verdict"), F.lit("allow")).alias("verdict"),
        F.col("by_pattern.name").alias("pattern_rule"),
    )
