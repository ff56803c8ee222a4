"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are matches of credential patterns. Each candidate's value is hashed, and over the whole corpus the
distinct owners (sources) and repositories (documents) of a hash are counted: a value that many owners hold is a
widely copied example, one that stays with few owners looks live. The base patterns give spans in either case, with
their verdict; the patterns of the kind ``owned`` give spans only for values that look live.

Positions are those of code points: the pieces between a pattern's matches and the matches themselves are measured,
and a running sum over them, within the document, places each match.

Defined results: a null text counts as empty; null sources are one owner; repeated rows each give their row, and count
once as repositories if their ids are equal; texts of any length are scanned whole; of matches of several kinds at one
place all count; an empty table gives an empty result; other columns don't matter, and those kept come back as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dagql.llm.common import cut, table

# Fixed values of the query's contract: kind, pattern, group that holds the value, least length of that group. Runs too
# short to count are left out by the pattern itself where that can't move later matches.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Public formats of credentials: code host, chat, payment and cloud tokens, signed web tokens.
OWNED = ("owned", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 0, 1)
KINDS = [*BASE, OWNED]


def _matches(text: Column, no: int) -> Column:
    """Number of the kind, lengths of the pieces around the matches, and the matches."""
    rx = F.lit(KINDS[no][1])
    found = F.regexp_extract_all(text, rx, F.lit(0))
    pieces = F.when(F.size(found) > 0, F.transform(F.split(text, KINDS[no][1], -1), F.char_length))
    return F.struct(F.lit(no).alias("kind"), pieces.alias("pieces"), found.alias("found"))


def find_secrets(df: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", keep: list[str] | None = None, example_owners: int = 4) -> DataFrame:
    """keep and ``spans`` of each row: an array of (start, no, end, sha256, owners, repos, live) by start, then kind.

    A value is live if fewer than ``example_owners`` owners hold it."""
    keep = list(df.columns if keep is None else keep)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.monotonically_increasing_id().alias("__row"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(repo).cast("string").alias("__repo"), F.coalesce(F.col(owner).cast("string"), F.lit("\x00")).alias("__owner"),
        F.filter(F.array(*[_matches(t, no) for no in range(len(KINDS))]), lambda x: F.size(x["found"]) > 0).alias("__by_kind"),
    )
    rows = cut(rows)  # row numbers hold from here on; what is kept of the texts is their matches
    each = rows.select("__row", "__repo", "__owner", F.explode("__by_kind").alias("k"))
    each = each.select("__row", "__repo", "__owner", "k.kind", F.posexplode(F.arrays_zip(F.slice("k.pieces", F.lit(1), F.size("k.found")).alias("piece"), F.col("k.found").alias("match"))).alias("i", "m"))
    upto = W.partitionBy("__row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.char_length("m.match")
    each = each.select("__row", "__repo", "__owner", "kind", F.col("m.match").alias("match"), F.sum((F.col("m.piece") + size).cast("long")).over(upto).alias("end"), size.cast("long").alias("size"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", BASE[0][1], 2)).otherwise(F.col("match"))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    each = each.withColumn("value", value).where(F.char_length("value") >= least)
    each = each.select("__row", "__repo", "__owner", "kind", (F.col("end") - F.col("size")).alias("start"), "end", F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))
    held = each.groupBy("sha256", "__owner", "__repo").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("sha256", "__owner").agg(F.count("__repo").alias("repos"))  # of one id under two owners, two repositories
    known = by_owner.groupBy("sha256").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")).withColumn("live", F.col("owners") < example_owners)
    known = cut(known)  # so that a join on a value that a third of the rows hold can be split
    judged = each.join(known, "sha256").where((F.col("kind") < len(BASE)) | F.col("live"))
    spans = judged.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", F.col("kind").alias("no"), "end", "sha256", "owners", "repos", "live"))).alias("__spans"))
    out = rows.drop("__by_kind", "__repo", "__owner").join(spans, "__row", "left")
    empty = F.expr("array()").cast(spans.schema["__spans"].dataType)
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.coalesce("__spans", empty).alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"], s["end"])), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document, and how many of the base spans look live or are widely copied."""
    d = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["no"] < len(BASE))

    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(no: int) -> Column:
        return count(lambda s: s["no"] == no)

    return d.select(
        "doc_id", *[of_kind(no).alias(f"n_{k[0]}") for no, k in enumerate(BASE)],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        count(lambda s: (s["no"] < len(BASE)) & s["live"]).alias("n_live"), count(lambda s: (s["no"] < len(BASE)) & ~s["live"]).alias("n_copied"),
    )


def _sql_kinds() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, source, {no} AS no, '{k[0]}' AS kind, regexp_extract_all(t, '{k[1].replace(chr(39), chr(39) * 2)}', 0) AS m, string_split_regex(t, '{k[1].replace(chr(39), chr(39) * 2)}') AS p, {k[3]} AS least FROM d" for no, k in enumerate(KINDS))


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({_sql_kinds()}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (SELECT doc_id, source, no, kind, least, m[i] AS match, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM e),
v AS (SELECT *, CASE WHEN no = 0 THEN regexp_extract(match, '{BASE[0][1].replace(chr(39), chr(39) * 2)}', 2) ELSE match END AS value FROM s),
c AS (SELECT * FROM v WHERE length(value) >= least),
k AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) < 4 AS live FROM c GROUP BY value),
j AS (SELECT doc_id, no, start, live, kind || ':' || start || ':' || (start + length(match)) AS x FROM c JOIN k ON k.value = c.value WHERE no < 3 OR live),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  string_agg(x, ',' ORDER BY start, no) FILTER (no < 3) AS base, string_agg(x, ',' ORDER BY start, no) AS spans,
  count(*) FILTER (no < 3 AND live) AS n_live, count(*) FILTER (no < 3 AND NOT live) AS n_copied FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
