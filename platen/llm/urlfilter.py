"""URL verdicts: explicit host and path rules, then mined association rules.

Pages that an explicit rule decides are the labelled ones. FP-growth mines the
frequent combinations of their URL tokens with the verdict; combinations of any
size whose support and confidence reach the limits become rules. A rule that a part of its
own tokens beats (by confidence, or by support at equal confidence) never decides and is pruned.
Other pages get the verdict of their best rule (confidence, then
support, then more tokens, then text), found through an inverted index that lists a rule
under its rarest token; without one they get DEFAULT. Matching works on the distinct
token sets, so a hot host is matched once, and all of it is DataFrame code.

A URL has at most nine tokens (scheme, whole host, registered name, the labels
around it, first path part, file ending, first query key, fragment), so a labelled page has at most
511 combinations, and at a support of MIN_SUPPORT there are at most 511 / MIN_SUPPORT frequent ones:
the index has that bound and is broadcast.

Defined cases: a null URL or one without `://` has an empty host and path, no
token and the verdict DEFAULT; repeated rows count as often as they stand and
are all returned; without labelled pages there are no mined rules; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.tables import salted, stored

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
DEFAULT = "allow"
BLOCK, ALLOW = "block", "allow"

# The explicit rules (verdict, host, path).
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """page_id with host, path and URL tokens."""
    url = F.col("url").cast("string")
    at = F.locate("://", url)
    has = at > 0
    rest = F.when(has, F.expr("substring(cast(url as string), locate('://', cast(url as string)) + 3)"))
    none = F.lit("")
    out = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), none).alias("host"),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), none).alias("path"),
        F.when(has, F.expr("substring(cast(url as string), 1, locate('://', cast(url as string)) - 1)")).alias("scheme"),
        F.coalesce(F.regexp_extract(rest, r"^[^?#]*\?([^=&#]*)", 1), none).alias("key"),
        F.coalesce(F.instr(rest, "#") > 0, F.lit(False)).alias("fragment"),
    ).withColumn("labels", F.split("host", r"\."))
    n = F.size("labels")
    filled = F.col("host") != ""
    token = lambda name, value, when: F.when(when & (value != ""), F.concat(F.lit(f"{name}="), value))
    tokens = F.array(
        token("scheme", F.col("scheme"), filled),
        token("host", F.col("host"), filled),
        token("name", F.try_element_at("labels", n - 1), n >= 2),
        token("label", F.try_element_at("labels", n - 2), n >= 3),
        token("first", F.try_element_at("labels", F.lit(1)), n >= 3),
        token("part", F.regexp_extract("path", r"^/([^/]+)", 1), filled),
        token("ending", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1), filled),
        token("key", F.col("key"), filled),
        F.when(filled & F.col("fragment"), F.lit("fragment")),
    )
    return out.select("page_id", "host", "path", F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("tokens"))


def explicit(rows: DataFrame) -> DataFrame:
    """Adds rule and its verdict: of the rules that fit, the longest."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(r, ((F.col("host") == r[1]) | F.col("host").endswith("." + r[1])) & F.col("path").startswith(r[2])) for r in ordered]
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (kind, host, path), fit in reversed(fits):
        rule, verdict = F.when(fit, F.lit(host + path)).otherwise(rule), F.when(fit, F.lit(kind)).otherwise(verdict)
    return rows.withColumn("rule", rule).withColumn("verdict", verdict)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, size, verdict, hits, confidence) of the mined rules, from (tokens, verdict)."""
    classes = F.array(F.lit(f"verdict={BLOCK}"), F.lit(f"verdict={ALLOW}"))
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).freqItemsets
    sized = found.withColumn("tokens", F.array_sort(F.array_except("items", classes))).filter(F.size("tokens") >= 1)
    whole = sized.filter(F.size("items") == F.size("tokens")).select("tokens", F.col("freq").alias("seen"))
    with_class = sized.filter(F.size("items") > F.size("tokens")).select("tokens", F.col("freq").alias("hits"), F.regexp_replace(F.array_intersect("items", classes)[0], "^verdict=", "").alias("verdict"))
    rules = with_class.join(whole, "tokens").withColumn("confidence", F.col("hits").cast("double") / F.col("seen").cast("double"))
    return rules.filter(F.col("confidence") >= min_confidence).select("tokens", F.size("tokens").alias("size"), "verdict", "hits", "confidence")


def pruned(rules: DataFrame) -> DataFrame:
    """rules without those that a rule of one token less, of the same verdict, always beats."""
    parts_of = rules.select("tokens", "verdict", "hits", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), "verdict", F.col("hits").alias("part_hits"), F.col("confidence").alias("part_confidence"))
    better = F.expr("part_confidence > confidence or (part_confidence = confidence and part_hits > hits)")
    beaten = parts_of.join(shorter, ["part", "verdict"]).filter(better).select("tokens", "verdict").distinct()
    return rules.join(beaten, ["tokens", "verdict"], "left_anti")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined) of the token sets that a rule fits, through the inverted index."""
    listed = rules.select(F.col("tokens").alias("rule_tokens"), "verdict", "size", "hits", "confidence", F.explode("tokens").alias("token"))
    lengths = listed.groupBy("token").agg(F.count("*").alias("length"))
    keys = ["rule_tokens", "verdict", "size", "hits", "confidence"]
    index = listed.join(lengths, "token").groupBy(*keys).agg(F.min(F.struct("length", "token")).alias("rarest")).select(*keys, F.col("rarest.token").alias("token"))
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(index), "token")
    fitting = hits.filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    order = F.struct((-F.col("confidence")).alias("a"), (-F.col("hits")).alias("b"), (-F.col("size")).alias("c"), F.array_join("rule_tokens", " ").alias("d"), F.col("verdict").alias("verdict"))
    return fitting.groupBy("tokens").agg(F.min(order).alias("best")).select("tokens", F.col("best.verdict").alias("mined"))


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url)."""
    rows = explicit(parts(pages))
    labelled = rows.filter("rule is not null").select("tokens", "verdict")
    if labelled.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))
    # The rows of a hot token set are dealt by a salt: each salt that has some gets the set's verdict once.
    dealt = salted(rows, "page_id")
    sets = dealt.filter("rule is null").select("tokens", "_salt").distinct()
    rules, _ = stored(mine(labelled), "url-rules")
    mined = sets.join(matched(sets.select("tokens").distinct(), pruned(rules)), "tokens")
    return dealt.join(mined, ["tokens", "_salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit(DEFAULT)).alias("verdict"))


ORACLE = f"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, 1, strpos(url, '://') - 1) END AS scheme
  FROM pages),
split AS (
  SELECT page_id, id, scheme, rest, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
labelled_parts AS (SELECT *, string_split(host, '.') AS labels FROM split),
tokens AS (
  SELECT page_id, id, host, path, list_sort(list_distinct(list_filter([
    CASE WHEN host <> '' AND scheme <> '' THEN 'scheme=' || scheme END,
    CASE WHEN host <> '' THEN 'host=' || host END,
    CASE WHEN len(labels) >= 2 AND labels[len(labels) - 1] <> '' THEN 'name=' || labels[len(labels) - 1] END,
    CASE WHEN len(labels) >= 3 AND labels[len(labels) - 2] <> '' THEN 'label=' || labels[len(labels) - 2] END,
    CASE WHEN len(labels) >= 3 AND labels[1] <> '' THEN 'first=' || labels[1] END,
    CASE WHEN host <> '' AND regexp_extract(path, '^/([^/]+)', 1) <> '' THEN 'part=' || regexp_extract(path, '^/([^/]+)', 1) END,
    CASE WHEN host <> '' AND regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) <> '' THEN 'ending=' || regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) END,
    CASE WHEN host <> '' AND regexp_extract(rest, '^[^?#]*\\?([^=&#]*)', 1) <> '' THEN 'key=' || regexp_extract(rest, '^[^?#]*\\?([^=&#]*)', 1) END,
    CASE WHEN host <> '' AND strpos(rest, '#') > 0 THEN 'fragment' END], lambda x: x IS NOT NULL))) AS tokens FROM labelled_parts),
fitting AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM tokens),
ruled AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM fitting),
labelled AS (SELECT tokens, count(*) FILTER (verdict = 'block') AS blocked, count(*) FILTER (verdict = 'allow') AS allowed FROM ruled WHERE rule IS NOT NULL GROUP BY tokens),
chosen AS (SELECT *, unnest(range(1, (1 << len(tokens))::BIGINT)) AS m FROM labelled),
sets AS (SELECT list_filter(tokens, lambda x, i: (m & (1 << (i - 1))) <> 0) AS s, blocked, allowed FROM chosen),
counted AS (SELECT s, sum(blocked + allowed) AS seen, sum(blocked) AS blocked, sum(allowed) AS allowed FROM sets GROUP BY s),
least AS (SELECT ceil({MIN_SUPPORT}::DOUBLE * count(*)) AS n FROM ruled WHERE rule IS NOT NULL),
mined AS (
  SELECT s, 'block' AS verdict, blocked AS hits, blocked::DOUBLE / seen AS confidence FROM counted, least WHERE blocked >= n AND blocked > 0
  UNION ALL SELECT s, 'allow', allowed, allowed::DOUBLE / seen FROM counted, least WHERE allowed >= n AND allowed > 0),
kept AS (SELECT * FROM mined WHERE confidence >= {MIN_CONFIDENCE}::DOUBLE),
open_sets AS (SELECT DISTINCT tokens FROM ruled WHERE rule IS NULL),
best AS (
  SELECT tokens, k.verdict AS verdict, row_number() OVER (PARTITION BY tokens ORDER BY confidence DESC, hits DESC, len(s) DESC, array_to_string(s, ' '), k.verdict) AS place
  FROM open_sets JOIN kept k ON list_has_all(tokens, s))
SELECT page_id, host, path, rule, coalesce(r.verdict, b.verdict, '{DEFAULT}') AS verdict
FROM ruled r LEFT JOIN best b ON r.rule IS NULL AND r.tokens = b.tokens AND b.place = 1
"""
