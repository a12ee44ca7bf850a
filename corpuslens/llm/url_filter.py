"""URL filters: rules found through their rarest literal token.

A rule is indexed under one token that every URL it fits must contain.  The
index is a hash table held in a literal, an array of buckets, so a URL fetches
the rules of its tokens by array access, without a join or a shuffle; only the
fetched rules run their regular expressions.  Everything is a built-in SQL
expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules in one literal index; more rules are judged by several indexes, and the best finding of all wins.
RULES_PER_INDEX = 20_000
BUCKET = "array<array<struct<token:string,regex:string,site:boolean,size:int,rule:string,verdict:string>>>"


@dataclass(frozen=True)
class Rule:
    """``site`` rules are host/path: the host with all its subdomains, and a path prefix (case counts).

    Other rules are patterns over host and path in lower case: ``*`` is any
    run of characters, ``^`` a separator (neither letter nor digit) or either
    end, ``||`` at the start the start of the host or of one of its labels.
    """

    text: str
    verdict: str
    site: bool = False

    def regex(self) -> str:
        if self.site:
            host, slash, path = self.text.partition("/")
            return r"^([^/]*\.)?" + _literal(host) + (_literal(slash + path) if slash else "(/|$)")
        body, start = self.text.lower(), ""
        if body.startswith("||"):
            body, start = body[2:], r"^([^/]*\.)?"
        return start + "".join({"*": ".*", "^": "([^a-z0-9]|^|$)"}.get(c) or _literal(c) for c in body)

    def tokens(self) -> list[str]:
        """Literal tokens: runs of letters and digits that end inside the rule at something that bounds a URL's token too."""
        if self.site:
            text = self.text.lower()
            # behind the last sign of the path the URL may go on with the same token; a host's end is a bound
            return re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])" if "/" in text else r"[a-z0-9]+", text)
        text = self.text.lower()
        text = "|" + text[2:] if text.startswith("||") else "*" + text
        return [m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", text)]


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


#: The rules that every result is held against: host and path of the contract.
SITE_RULES = (Rule("org/", "allow", True), Rule("example.org/es/", "block", True), Rule("example.org/en/1", "block", True), Rule("com/fr/", "allow", True), Rule("com/de/", "block", True))
#: Patterns for hosts and paths that sell drugs, bets, adult content, counterfeits, loans or links.
PATTERN_RULES = tuple(
    Rule(text, "block")
    for text in (
        "^cheap-pills^", "^free-bets^", "^spam^", "^ads^", "^link-farm^", "^casino^", "^online-casino^", "^poker^", "^slots^", "^viagra^", "^cialis^", "^pharmacy^", "^pills^", "^porn^", "^xxx^", "^adult^", "^sex^", "^escort^", "^payday^loans^",
        "^replica^watches^", "^betting^", "^jackpot^", "^lottery^", "^crypto^giveaway^", "^buy^followers^", "||ads.", "||adserver.", "||doubleclick.", "||tracker.", "^/wp-login^", "^/cgi-bin^", "^malware^", "^phishing^", "^warez^", "^torrent^", "^keygen^",
    )
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def with_parts(df: DataFrame, url_col: str, keep: Iterable[Column]) -> DataFrame:
    part = lambda group: F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)\A.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return df.select(*keep, ascii_lower(part(1)).alias("host"), part(2).alias("path"))


def url_tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(subject), F.lit("[a-z0-9]+"), F.lit(0)))


def token_counts(df: DataFrame, url_col: str, tokens: list[str]) -> dict[str, int]:
    """URLs with each of the tokens, over the whole table; what comes back is no longer than ``tokens``."""
    parts = with_parts(df, url_col, [])
    found = parts.select(F.explode(F.array_intersect(url_tokens(F.concat("host", "path")), F.lit(tokens))).alias("token"))
    return {r.token: r["count"] for r in found.groupBy("token").count().collect()}


def literal_index(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int, Column]:
    """The hash table, its number of buckets, and the rules without a token, which every URL runs."""
    n = 1 << max(4, (2 * len(rules)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(n)]
    always = []
    for r in rules:
        entry = {"regex": r.regex(), "site": r.site, "size": len(r.text), "rule": r.text, "verdict": r.verdict}
        if tokens := r.tokens():
            rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            buckets[xxhash.xxh64_intdigest(rarest.encode(), seed=42) % n].append(entry | {"token": rarest})
        else:
            always.append(entry | {"token": ""})
    return F.from_json(F.lit(json.dumps(buckets)), BUCKET), n, F.element_at(F.from_json(F.lit(json.dumps([always])), BUCKET), 1)


def judge(df: DataFrame, rules: Iterable[Rule] = (*SITE_RULES, *PATTERN_RULES), id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, pattern), in the order and number of the input rows.

    Of the site rules that fit, the longest (then the least text) gives
    ``rule`` and ``verdict``; without one, ``rule`` is null and the verdict is
    that of the longest fitting pattern, named in ``pattern``, else
    ``default``.  A null URL, or one without ``://``, has an empty host and
    path, which no rule fits.  Repeated rows are judged alike; other columns
    are not looked at.  Before the plan is made, one aggregation counts the
    URLs with each of the rules' own tokens.
    """
    rules = list(dict.fromkeys(rules))
    counts = token_counts(df, url_col, sorted({t for r in rules for t in r.tokens()})) if rules else {}
    parts = with_parts(df, url_col, [F.col(id_col).alias("page_id")])
    parts = parts.select("*", F.concat("host", "path").alias("subject"))
    parts = parts.select("*", url_tokens(F.col("subject")).alias("tokens"))
    site, pattern = F.lit(None), F.lit(None)
    for at in range(0, len(rules), RULES_PER_INDEX):
        table, n, always = literal_index(rules[at : at + RULES_PER_INDEX], counts)
        fetched = F.flatten(F.transform("tokens", lambda t: F.filter(F.get(table, F.pmod(F.xxhash64(t), F.lit(n)).cast("int")), lambda c: c["token"] == t)))  # noqa: B023
        lowered = ascii_lower(F.col("subject"))
        fits = F.filter(F.concat(fetched, always), lambda c: F.regexp_like(F.when(c["site"], F.col("subject")).otherwise(lowered), c["regex"]))  # noqa: B023
        best = lambda kind, fits=fits: F.array_min(F.transform(F.filter(fits, kind), lambda c: F.struct((-c["size"]).alias("order"), c["rule"].alias("rule"), c["verdict"].alias("verdict"))))
        parts = parts.withColumns({f"site{at}": best(lambda c: c["site"]), f"pattern{at}": best(lambda c: ~c["site"])})
    chosen = list(range(0, len(rules), RULES_PER_INDEX))
    if not chosen:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    site, pattern = (F.array_min(F.array(*(F.col(f"{kind}{at}") for at in chosen))) for kind in ("site", "pattern"))
    return parts.select("page_id", "host", "path", site["rule"].alias("rule"), F.coalesce(site["verdict"], pattern["verdict"], F.lit(default)).alias("verdict"), F.when(site.isNull(), pattern["rule"]).alias("pattern"))


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a text file, one a line; ``#`` or ``!`` begins a comment.

    ``allow`` or ``block`` and a host with a path (``block com/de/``) is a site
    rule; other lines are patterns that block, or allow behind ``@@``.  Rules
    are judged from literals, so a list must fit the driver; repeated ones
    count once.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT line RLIKE '^[#!]'").distinct().orderBy("line").collect()
    out = []
    for r in lines:
        verdict, _, rest = r.line.partition(" ")
        if verdict in ("allow", "block") and rest.strip():
            out.append(Rule(rest.strip(), verdict, True))
        else:
            out.append(Rule(r.line.removeprefix("@@"), "allow" if r.line.startswith("@@") else "block"))
    return out


def sql(rules: Iterable[Rule] = (*SITE_RULES, *PATTERN_RULES), default: str = "allow") -> str:
    """The same judgement as DuckDB SQL over the table pages: every rule against every URL.

    Shares no expression with the operator: site rules are tested by their
    host's end and their path's beginning, patterns are translated in SQL.
    """
    rules = list(dict.fromkeys(rules))
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(r.text)}, {quote(r.verdict)}, {str(r.site).lower()})" for r in rules)
    return f"""
    WITH cut AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    ends AS (SELECT r, page_id, rest, least(nullif(instr(rest, '/'), 0), nullif(instr(rest, '?'), 0), nullif(instr(rest, '#'), 0)) AS e FROM cut),
    halves AS (SELECT r, page_id, CASE WHEN e IS NULL THEN coalesce(rest, '') ELSE substr(rest, 1, e - 1) END AS host, CASE WHEN e IS NULL THEN '' ELSE substr(rest, e) END AS tail FROM ends),
    parts AS (SELECT r, page_id, translate(host, '{UPPER}', '{LOWER}') AS host, string_split(string_split(tail, '?')[1], '#')[1] AS path FROM halves),
    rules(rule, verdict, site) AS (VALUES {values}),
    known AS (SELECT rule, verdict, site, CASE WHEN contains(rule, '/') THEN substr(rule, 1, instr(rule, '/') - 1) ELSE rule END AS h, CASE WHEN contains(rule, '/') THEN substr(rule, instr(rule, '/')) ELSE '' END AS p,
      CASE WHEN starts_with(rule, '||') THEN '(?s)^([^/]*[.])?' ELSE '(?s)' END || replace(replace(regexp_escape(lower(ltrim(rule, '|'))), '\\^', '([^a-z0-9]|^|$)'), '\\*', '.*') AS pattern FROM rules),
    fits AS (
      SELECT r, site, rule, verdict, row_number() OVER (PARTITION BY r, site ORDER BY length(rule) DESC, rule) AS k
      FROM parts JOIN known ON CASE WHEN site THEN (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ELSE regexp_matches(translate(host || path, '{UPPER}', '{LOWER}'), pattern) END)
    SELECT page_id, host, path, s.rule AS rule, coalesce(s.verdict, p.verdict, {quote(default)}) AS verdict, CASE WHEN s.rule IS NULL THEN p.rule END AS pattern
    FROM parts LEFT JOIN (SELECT * FROM fits WHERE site AND k = 1) s USING (r) LEFT JOIN (SELECT * FROM fits WHERE NOT site AND k = 1) p USING (r)"""
