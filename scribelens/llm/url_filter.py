"""URL filtering by pattern rules, indexed by their rarest literal token; built-in functions only.

A rule is a regular expression together with the literal tokens (host labels, whole path
segments) that every matching URL must contain. Token frequencies are counted over all URLs,
and each rule is filed under its rarest token. The tokens of a URL fetch the rules filed under
them, and only these run their expression. Of the rules that fit, the longest wins.

The index of a rule list is a constant hash table inside the plan: URLs are judged where they
are read, without any exchange. `judge_by_table` is the other way, for rule tables too large to
be a constant: the index is a table there and candidates come from a join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelens.llm.tables import LOWER, UPPER, read

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ANY = "*"


class Rule(NamedTuple):
    """``rule`` is the name reported, ``tokens`` are the literals every match contains."""

    rule: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains if the path starts with ``/path``."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    tail = re.escape(path) if path else "(?:/|$)"
    labels = [f".{x}" for x in host.split(".") if x]
    segments = [f"/{x}" for x in path.split("/")[1:-1] if x]  # the last one may be a prefix
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{tail}", tuple(labels + segments))


RULES = (
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), PARTS, i), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels as ``.label`` and path segments as ``/segment``, and `ANY`."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("."), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("/"), x))
    return F.array_distinct(F.concat(F.array(F.lit(ANY)), labels, segments))


def rarest_tokens(pages: DataFrame, rules: Sequence[Rule]) -> dict[str, str]:
    """Rule name to the token it is filed under.

    ``pages`` has host and path. Only tokens that occur in rules are counted, over all rows; as
    many counts come back as there are such tokens.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {r.rule: ANY for r in rules}
    found = F.array_intersect(tokens(F.col("host"), F.col("path")), F.array(*map(F.lit, wanted)))
    seen = pages.select(F.explode(found).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}
    return {r.rule: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=ANY) for r in rules}


def _index(rules: Sequence[Rule], filed: dict[str, str], size: int) -> Column:
    """Hash table of the rules by token, as one constant."""
    buckets: list[list[Column]] = [[] for _ in range(size)]
    for r in rules:
        token = filed[r.rule]
        entry = {"token": token, "rule": r.rule, "verdict": r.verdict, "pattern": r.pattern}
        buckets[zlib.crc32(token.encode()) % size].append(F.struct(*[F.lit(v).alias(k) for k, v in entry.items()]))
    empty = F.array().cast("array<struct<token:string,rule:string,verdict:string,pattern:string>>")
    return F.array(*[F.array(*b) if b else empty for b in buckets])


def _best(candidates: Column) -> Column:
    """The longest rule; of equally long ones the last by name."""
    return F.array_max(
        F.transform(candidates, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    )


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to ``pages`` (columns of these names are replaced).

    URLs that no rule fits have a null rule and the verdict ``default``. Null, empty and
    malformed URLs have an empty host and path and can only meet rules without tokens. Repeated
    rows are judged alike; an empty table or rule list is fine.
    """
    parted = with_parts(pages, url)
    if not rules:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    index = _index(rules, rarest_tokens(parted, rules), 2 * len(rules) + 1)
    size = 2 * len(rules) + 1
    subject = F.concat("host", "path")
    fetched = F.flatten(
        F.transform(
            tokens(F.col("host"), F.col("path")),
            lambda t: F.filter(F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int")), lambda r: r["token"] == t),
        )
    )
    fitting = F.filter(fetched, lambda r: F.regexp_like(subject, r["pattern"]))
    return (
        parted.withColumn("__best__", _best(fitting))
        .withColumns({"rule": F.col("__best__.rule"), "verdict": F.coalesce(F.col("__best__.verdict"), F.lit(default))})
        .drop("__best__")
    )


def judge_by_table(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """As `judge`, for a table of rules (rule, verdict, pattern, tokens array<string>).

    Each distinct host and path is judged once, so a very common URL is one row before the join
    with the index; Spark broadcasts the index if its size allows.
    """
    parted = with_parts(pages, url)
    subjects = parted.select("host", "path").distinct()
    has = subjects.select("host", "path", F.explode(tokens(F.col("host"), F.col("path"))).alias("token"))
    literals = rules.select("rule", F.explode("tokens").alias("token"))
    seen = has.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = (
        literals.join(seen, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    index = rules.select("rule", "verdict", "pattern").join(rarest, "rule", "left").fillna(ANY, "token")
    best = (
        has.join(index, "token")
        .where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("__best__"))
    )
    return (
        parted.drop("rule", "verdict").join(best, ["host", "path"], "left")
        .withColumns({"rule": F.col("__best__.rule"), "verdict": F.coalesce(F.col("__best__.verdict"), F.lit(default))})
        .drop("__best__")
    )


def _oracle() -> str:
    fits = [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")]
    verdicts = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    test = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ordered = sorted(fits, key=lambda x: -len(x[0] + x[1]))
    rule = " ".join(f"WHEN {test(h, p)} THEN '{h}{p}'" for h, p in ordered)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in verdicts.items())
    return f"""
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE 'allow' END AS verdict FROM (
    SELECT page_id, host, path, CASE {rule} END AS rule FROM (
        SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
               regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM (
            SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages)))"""


ORACLE = _oracle()


def op2_url_filter(spark, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
