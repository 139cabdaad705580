"""URL filter: pattern rules behind an index by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwright.llm.common import prepare, table

_TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """`pattern` in the usual block-list notation: `||` anchors at a domain, `*` stands for anything,
    `^` for a separator or the end, all else is literal. Site rules decide before the others."""

    pattern: str
    action: str
    site: bool = False

    @property
    def label(self) -> str:
        return self.pattern.removeprefix("||")

    def expression(self) -> str:
        """The regular expression over host and path. Only the host is free of case; it is lower-cased before."""
        body = self.pattern.removeprefix("||")
        parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
        text = "".join(parts.get(c, re.escape(c)) for c in body)
        return (r"^(?:[^/]*\.)?" if body != self.pattern else "") + text

    def tokens(self) -> set[str]:
        """Literal tokens that a fitting URL holds whole: runs of letters and digits with a literal border on
        each side. Under `||` the start is a border as well, as a host label starts there."""
        body = self.pattern
        borders = {"/", ".", "-", "_", "=", "?", "&", ":", "^", "|"}
        found = set()
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            before = body[m.start() - 1] if m.start() else ""
            after = body[m.end()] if m.end() < len(body) else ""
            if before in borders and after in borders:
                found.add(m.group().lower())
        return found


#: The rules of the contract (fixed values).
SITE_RULES = (
    Rule("||com/", "allow", True),
    Rule("||example.com/en/", "block", True),
    Rule("||www.example.com/en/", "allow", True),
    Rule("||net/es/", "block", True),
    Rule("||net/fr/", "block", True),
)
#: General rules for URLs that no site rule settles.
PATTERN_RULES = (
    Rule("/ads/", "block"), Rule("/adserver/", "block"), Rule("/banner^", "block"), Rule("/tracking^", "block"),
    Rule("/casino^", "block"), Rule("/porn^", "block"), Rule("/xxx^", "block"), Rule("/login^", "block"),
    Rule("/cart^", "block"), Rule("/wp-admin^", "block"), Rule("/ads/help^", "allow"),
)


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add `host` and `path` (both empty for a null URL or one without `://`); columns of these names are replaced."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substr(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    ascii_lower = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": F.coalesce(ascii_lower, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def token_counts(located: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs. At most one row per rule token reaches the driver."""
    wanted = sorted(set().union(*(r.tokens() for r in rules)))
    if not wanted:
        return {}
    tokens = F.array_distinct(F.transform(
        F.regexp_extract_all(F.concat("host", "path"), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower))
    held = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    rows = located.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {w: 0 for w in wanted} | {r["token"]: r["count"] for r in rows}


class RuleIndex:
    """Rules by their rarest literal token. Rules without any are tried on every URL."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = [(re.compile(r.expression(), re.DOTALL), r.label, r.action, r.site) for r in rules]
        for number, rule in enumerate(rules):
            rarest = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=None)
            (self.always if rarest is None else self.by_token.setdefault(rarest, [])).append(number)

    def candidates(self, key: str) -> list[int]:
        get = self.by_token.get
        return self.always + [n for token in {t.lower() for t in _TOKEN.findall(key)} for n in get(token, ())]

    def judge(self, host: str, path: str, default: str) -> tuple[str | None, str | None, str, int]:
        key, tried = host + path, 0
        best: dict[bool, tuple] = {}
        for n in self.candidates(key):
            expression, label, action, site = self.rules[n]
            tried += 1
            if expression.search(key):
                # Longest wins; of equal length an allowing rule, then the first in the alphabet.
                rank = (-len(label), action != "allow", label, action)
                best[site] = min(best.get(site, rank), rank)
        site, other = best.get(True), best.get(False)
        verdict = site[3] if site else other[3] if other else default
        return site[2] if site else None, other[2] if other else None, verdict, tried


def judge_urls(pages: DataFrame, url: str = "url", site_rules: Sequence[Rule] = SITE_RULES,
               pattern_rules: Sequence[Rule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """Add `host`, `path`, `rule`, `pattern`, `verdict` and `rules_tried` to every row of `pages`.

    `rule` is the longest fitting site rule and `pattern` the longest fitting general rule, else null.
    The verdict is that of the site rule, else of the general rule, else `default`. The tokens of a URL
    fetch the rules indexed under them; only those run their expression. The rule list is an argument
    of the driver and as large as the caller makes it; the tables never go there. Null and broken URLs
    have empty host and path and get the default unless a rule fits the empty text. Repeated rows are
    judged alike; an empty table gives an empty result; input columns named like the results are replaced.
    """
    prepare(pages.sparkSession)
    rules = [*site_rules, *pattern_rules]
    located = with_host_and_path(pages, url)
    counts = token_counts(located, rules)

    @F.pandas_udf("rule string, pattern string, verdict string, rules_tried int")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = RuleIndex(rules, counts)
        for hosts, paths in parts:
            yield pd.DataFrame([index.judge(h, p, default) for h, p in zip(hosts, paths)],
                               columns=["rule", "pattern", "verdict", "rules_tried"])

    kept = [c for c in located.columns if c not in ("rule", "pattern", "verdict", "rules_tried")]
    return located.select(*kept, judged("host", "path").alias("_judged")).select(*kept, "_judged.*")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "pattern")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), site(h, p, rule, action) AS (VALUES
  ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
  ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')
), general(pattern, expression, action) AS (VALUES
  ('/ads/', '/ads/', 'block'), ('/adserver/', '/adserver/', 'block'),
  ('/banner^', '/banner([^A-Za-z0-9_.%-]|$)', 'block'), ('/tracking^', '/tracking([^A-Za-z0-9_.%-]|$)', 'block'),
  ('/casino^', '/casino([^A-Za-z0-9_.%-]|$)', 'block'), ('/porn^', '/porn([^A-Za-z0-9_.%-]|$)', 'block'),
  ('/xxx^', '/xxx([^A-Za-z0-9_.%-]|$)', 'block'), ('/login^', '/login([^A-Za-z0-9_.%-]|$)', 'block'),
  ('/cart^', '/cart([^A-Za-z0-9_.%-]|$)', 'block'), ('/wp-admin^', '/wp-admin([^A-Za-z0-9_.%-]|$)', 'block'),
  ('/ads/help^', '/ads/help([^A-Za-z0-9_.%-]|$)', 'allow')
), chosen AS (
  SELECT p.*,
    (SELECT max_by(struct_pack(rule := s.rule, action := s.action), length(s.rule)) FROM site s
      WHERE (p.host = s.h OR ends_with(p.host, '.' || s.h)) AND starts_with(p.path, s.p)) AS s,
    (SELECT min_by(struct_pack(pattern := g.pattern, action := g.action), (-length(g.pattern), g.action <> 'allow', g.pattern)) FROM general g
      WHERE regexp_matches(p.host || p.path, g.expression)) AS g
  FROM parts p)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, s.rule AS rule,
       coalesce(s.action, g.action, 'allow') AS verdict, g.pattern AS pattern FROM chosen
"""
