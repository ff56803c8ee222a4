"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host + path. A rule's pattern is split into literal tokens; of those that any matching
URL must hold as a whole token, the one that fewest rules hold is the rule's index entry. A URL's own tokens fetch
the candidate rules, and only those run their regular expressions; of the rules that match, those of the lowest tier come
first, and of them the longest wins (ties: the smaller text). Rules without such a token are tried on every URL.

Defined results: a null URL and one without ``://`` have empty host and path; no rule matches an empty host; equal
rows are judged alike, each giving its own row; an empty table gives an empty result; columns of the input other
than those kept don't matter, so names that clash do no harm. Texts of any length are judged whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dagql.llm.common import ascii_lower

TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Rules are shipped to the executors in blocks of at most so many; each block is one pass without a shuffle.
RULES_PER_BLOCK = 50_000
#: The last tier that there can be; a rule's rank is its length, and over a million more for each tier that comes after its own.
LOWEST = 1000


@dataclass(frozen=True)
class UrlRule:
    """action: any verdict word. pattern: a literal text over host + path, with these signs: a leading ``||`` fits the
    start of the host or of any parent domain, a leading or trailing ``|`` fits the start or end, ``*`` any run of
    characters, ``^`` one character that is none of letters, digits and ``_ . % -``, or the end."""

    name: str
    action: str
    pattern: str
    tier: int = 0

    @staticmethod
    def domain(name: str, action: str) -> UrlRule:
        """``host/path``: the host and all its subdomains, where the URL's path starts with the path."""
        return UrlRule(name, action, "||" + name)

    def parts(self) -> tuple[str, str, str]:
        p = self.pattern
        head = "||" if p.startswith("||") else "|" if p.startswith("|") else ""
        p = p[len(head) :]
        tail = "|" if p.endswith("|") else ""
        return head, p[: len(p) - len(tail)], tail

    def regex(self) -> str:
        head, body, tail = self.parts()
        start = {"||": r"\A(?:[^/]*\.)?", "|": r"\A", "": r""}[head]
        signs = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%-]|\Z)"}
        return start + "".join(signs.get(c) or re.escape(c) for c in body) + (r"\Z" if tail else "")

    def tokens(self) -> set[str]:
        """The tokens that every matching URL holds whole: bounded on both sides by an anchor or a literal sign."""
        head, body, tail = self.parts()
        found = set()
        for m in TOKEN.finditer(body):
            left = bool(head) if m.start() == 0 else body[m.start() - 1] != "*"
            right = bool(tail) if m.end() == len(body) else body[m.end()] != "*"
            if left and right:
                found.add(m[0])
        return found


class RuleIndex:
    """Candidate rules by token; of a rule's tokens, the rarest among the rules stands for it (ties: longer, then first)."""

    def __init__(self, rules: list[UrlRule]):
        held = Counter(t for r in rules for t in r.tokens())
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for r in rules:
            entry = (re.compile(r.regex()), (LOWEST - r.tier << 20) + len(r.pattern.lstrip("|")), r.name, r.action)
            tokens = sorted(r.tokens(), key=lambda t: (held[t], -len(t), t))
            (self.by_token.setdefault(tokens[0], []) if tokens else self.always).append(entry)

    def candidates(self, url: str) -> list:
        found = list(self.always)
        for t in set(TOKEN.findall(url)):
            found += self.by_token.get(t, ())
        return found

    def best(self, url: str) -> tuple[int, str, str] | None:
        hits = [(n, name, action) for rx, n, name, action in self.candidates(url) if rx.search(url)]
        return min(hits, key=lambda h: (-h[0], h[1])) if hits else None


def filter_urls(df: DataFrame, rules: list[UrlRule], url: str = "url", keep: list[str] | None = None, otherwise: str = "allow") -> DataFrame:
    """keep, host, path, rule, verdict and tier (the rule's) of each row; ``otherwise`` is the verdict where no rule matches."""
    keep = list(keep or [])
    before = F.char_length(F.substring_index(F.col(url), "://", 1))  # of what stands before the first ://
    after = F.when(F.instr(F.col(url), "://") > 0, F.substr(F.col(url), before + 4)).otherwise(F.lit(""))
    host = F.regexp_extract(F.col("__after"), r"\A[^/?#]*", 0)
    d = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.coalesce(after, F.lit("")).alias("__after"))
    d = d.withColumn("__raw", host)
    d = d.withColumn("__path", F.regexp_extract(F.expr("substr(__after, char_length(__raw) + 1)"), r"\A[^?#]*", 0))
    d = d.select(*[f"__k{i}" for i in range(len(keep))], ascii_lower(F.col("__raw")).alias("__host"), "__path", F.lit(0).alias("__n"), F.lit(None).cast("string").alias("__rule"), F.lit(None).cast("string").alias("__verdict"))
    for i in range(0, len(rules), RULES_PER_BLOCK):
        d = d.mapInArrow(_judge(RuleIndex(rules[i : i + RULES_PER_BLOCK])), d.schema)
    return d.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(otherwise)).alias("verdict"), F.when(F.col("__rule").isNotNull(), LOWEST - F.shiftright("__n", 20)).alias("tier"))


def _judge(index: RuleIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rule, verdict = (b.column(c).to_pylist() for c in ("__n", "__rule", "__verdict"))
            for i, (host, path) in enumerate(zip(b.column("__host").to_pylist(), b.column("__path").to_pylist(), strict=True)):
                best = index.best(host + path) if host else None
                if best and (rule[i] is None or (-best[0], best[1]) < (-n[i], rule[i])):
                    n[i], rule[i], verdict[i] = best
            columns = {"__n": pa.array(n, pa.int32()), "__rule": pa.array(rule, pa.string()), "__verdict": pa.array(verdict, pa.string())}
            yield pa.RecordBatch.from_arrays([columns.get(c, b.column(c)) for c in b.schema.names], schema=b.schema)

    return run


#: Fixed values of the query's contract.
DOMAIN_RULES = [UrlRule.domain("net/", "block"), UrlRule.domain("example.net/en/", "allow"), UrlRule.domain("example.com/de/", "block"), UrlRule.domain("org/fr/", "allow")]


#: The method's own rules, for URLs that none of those fits: pages that give a corpus no prose of their own. Longer
#: ones are exceptions from shorter ones.
PATTERN_RULES = [
    UrlRule(p, action, p, 1)
    for action, patterns in {
        "block": [
            # advertising and counting hosts and paths
            "||ad.", "||ads.", "||adserver.", "||banner.", "||click.", "||counter.", "||pixel.", "||stats.", "||track.", "||tracking.",
            "/ads/", "/adframe", "/banners/", "/popup", "/sponsored/", "^affiliate^",
            # copies for small screens, print and syndication
            "||m.", "||mobile.", "||wap.", "/amp|", "/print|", "/print/", "/feed|", "/feed/|", "/rss|", ".rss|", ".xml|",
            # accounts, shops and search results
            "||login.", "||accounts.", "/login", "/signin", "/signup", "/register|", "/logout", "/cart|", "/cart/", "/checkout", "/basket/", "/search|", "/search/", "/wp-admin/", "/wp-login.php", "/cgi-bin/",
            # files that are no pages
            ".exe|", ".zip|", ".gz|", ".rar|", ".iso|", ".apk|", ".mp3|", ".mp4|", ".avi|", ".jpg|", ".png|", ".gif|", ".css|", ".js|",
            # adult and gambling
            "||porn", "||xxx.", "^casino^", "^porn^", "^escort^", "^poker^",
        ],
        "allow": ["||m.*.example.org/en/", "||ads.*/policy", "/search/help", "/login/help", "/ads/policy", "/signup/terms"],
    }.items()
    for p in patterns
]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule (of the contract's) and verdict of every page; pattern: the rule of the method that gave the
    verdict where none of the contract's fits. Where none fits at all, the verdict is allow."""
    d = filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), DOMAIN_RULES + PATTERN_RULES, "url", ["page_id"])
    return d.select("page_id", "host", "path", F.when(F.col("tier") == 0, F.col("rule")).alias("rule"), "verdict", F.when(F.col("tier") == 1, F.col("rule")).alias("pattern"))


def _sql_pattern() -> str:
    order = sorted(PATTERN_RULES, key=lambda r: (-len(r.pattern.lstrip("|")), r.name))
    return "\n".join(f"  WHEN regexp_matches(host || path, '{r.regex().replace(chr(92) + 'Z', chr(92) + 'z')}') THEN '{r.name}'" for r in order)


_ALLOWED = ", ".join(f"'{r.name}'" for r in PATTERN_RULES if r.action == "allow")
SQL = rf"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS r FROM pages),
h AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM a),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM h),
j AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule, CASE WHEN host = '' THEN NULL
{_sql_pattern()} END AS fits FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL OR fits IS NULL OR fits IN ({_ALLOWED}) THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN fits END AS pattern FROM j
"""
