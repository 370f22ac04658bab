"""Url filters by association rules, in DataFrame functions only.

1. A url's tokens are its scheme, the labels of its host, the segments of its
   path, the keys of its query and its fragment, each with a letter for the part
   that it stands in; digits in a segment become one ``#``, so that numbers of
   pages do not make tokens of their own.
2. Urls that are labelled as unwanted are transactions. Spark's FP-growth mines
   the sets of tokens that stand together in at least ``least`` of them and
   ``share`` of them (support).
3. Each mined set of at most ``longest`` tokens is counted over all labelled urls.
   It becomes a rule if ``confidence`` of the urls that hold it are unwanted, and
   if no part of it is a rule already, as that would block the same urls.
4. Rules are matched by an inverted index: a rule is posted under the rarest of
   its tokens, a url looks its tokens up, and what is found is compared with all
   tokens of the url.

Before the mined rules stand the fixed ones, of a host and the start of a path;
the longest that fits decides.

Fitting: transactions are the distinct urls with their label. FP-growth gets at
most ``per_url`` tokens of a url (those that are most telling, the share among
unwanted urls against that among all), as it makes sets of every size and long
urls that many rows share would make them without number. The rest goes an exact
way: in urls that have more such tokens sets are grown by one token at a time up
to ``longest``, and only those go on that enough unwanted urls hold and that are
no rule yet, as what holds a rule is none. So no set is lost. Judging reads all
tokens of all urls and has no bound.

Defined cases: a null url, or one without ``://``, has an empty host and path and
no tokens, fits no rule and is allowed; repeated rows each get their verdict;
without labels, or with too few unwanted ones, nothing is mined and what no fixed
rule blocks is allowed; a url with labels that differ is unwanted; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amplispark.llm.common import Workspace, table

# The rules of host and path, with what they decide.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Mining:
    """Least support as a count and as a share of the unwanted urls, least confidence, tokens of a rule and of a transaction."""

    least: int = 20
    share: float = 0.001
    confidence: float = 0.5
    longest: int = 3
    per_url: int = 12


def lowered(c: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return lowered(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url as a sorted array."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z", k), F.lit(""))
    named = lambda letter, c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.concat(F.lit(letter + ":"), x))
    keys = F.transform(F.split(part(4), "[&;]"), lambda x: F.substring_index(x, "=", 1))
    every = F.concat(
        named("scheme", F.array(lowered(part(1)))),
        named("host", F.split(lowered(part(2)), r"\.")),
        named("path", F.transform(F.split(part(3), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))),
        named("key", keys),
        named("fragment", F.array(F.regexp_replace(part(5), "[0-9]+", "#"))),
    )
    return F.array_sort(F.array_distinct(every))


def written(host: str, path: str) -> str:
    return f"{host}{path}"


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest fixed rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(written(r[1], r[2])), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(written(h, p)).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _holding(held: DataFrame, sets: DataFrame, id_col: str) -> DataFrame:
    """(id, tokens of the set) of all (id, tokens) rows and (tokens, post) sets where the row holds the whole set: looked up by ``post``."""
    looked = held.select(id_col, F.col("tokens").alias("_all"), F.explode("tokens").alias("post"))
    # A set is posted once and a row holds a token once, so no pair comes twice.
    return looked.join(sets.select("tokens", "post"), "post").where(F.size(F.array_except("tokens", "_all")) == 0).select(id_col, "tokens")


def posted(sets: DataFrame, totals: DataFrame) -> DataFrame:
    """(tokens, post) of ``tokens`` sets: each under the rarest of its tokens by the ``n`` of (token, n), ties to the first."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(totals, "token")
    return each.groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("post"))


def parts_of(tokens: Column) -> Column:
    """The non-empty proper parts of a small set of sorted tokens, sorted as well."""
    # One more token at a time: subsets of the tokens so far, and each of them with the next one.
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate(tokens, none, lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(t)))))
    return F.filter(every, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(tokens)))


def _counted(held: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(tokens, n, support) of posted sets over all labelled urls, those with at least ``least`` unwanted ones."""
    counts = _holding(held, sets, "unwanted").groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("unwanted").alias("support"))
    return counts.where(F.col("support") >= least)


def grown_sets(long: DataFrame, held: DataFrame, totals: DataFrame, ws: Workspace, m: Mining, least: int) -> DataFrame:
    """(tokens): the sets of two to ``longest`` tokens in the ``long`` (tokens) transactions that ``least`` unwanted urls hold and that extend no rule."""
    # Level by level: a set that is frequent and no rule has only such parts.
    found, base = [], totals.where(F.col("bad") < m.confidence * F.col("n")).select(F.array("token").alias("tokens"), F.col("token").alias("post"))
    for _ in range(2, m.longest + 1):
        looked = long.select(F.col("tokens").alias("_all"), F.explode("tokens").alias("post"))
        meets = looked.join(base, "post").where(F.size(F.array_except("tokens", "_all")) == 0)
        later = meets.select("tokens", F.explode(F.filter("_all", lambda x: x > F.element_at("tokens", -1))).alias("_next"))
        sets = ws.save(later.select(F.concat("tokens", F.array("_next")).alias("tokens")).distinct())
        counted = ws.save(_counted(held, posted(sets, totals.select("token", "n")), least))
        found.append(counted.select("tokens"))
        base = posted(counted.where(F.col("support") < m.confidence * F.col("n")).select("tokens"), totals.select("token", "n"))
    return reduce(DataFrame.union, found)


def mined_rules(labelled: DataFrame, ws: Workspace, m: Mining = Mining(), whole: bool = False) -> DataFrame:
    """(tokens, support, n, post): the rules of (url, unwanted boolean) rows; n counts the labelled urls that hold the tokens.

    With ``whole`` also those that the bound of ``per_url`` tokens would lose.
    """
    urls = labelled.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("unwanted").alias("unwanted"))
    held = ws.save(urls.withColumn("tokens", tokens_of(F.col("url"))).where(F.size("tokens") > 0))
    n = held.agg(F.count("*").alias("all"), F.count_if("unwanted").alias("bad")).first()
    least = max(m.least, int(-(-m.share * n["bad"] // 1)))
    totals = held.select(F.explode("tokens").alias("token"), "unwanted").groupBy("token").agg(F.count("*").alias("n"), F.count_if("unwanted").alias("bad"))
    totals = ws.save(totals.where(F.col("bad") >= least))
    empty = held.select("tokens", F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("n"), F.lit("").alias("post")).where(F.lit(False))
    if n["bad"] < least:
        return ws.save(empty)
    telling = held.where("unwanted").select("url", F.explode("tokens").alias("token")).join(totals, "token")
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("bad") / F.col("n")).alias("order"), "token"))), 1, m.per_url)
    transactions = telling.groupBy("url").agg(F.array_sort(F.transform(first, lambda x: x["token"])).alias("tokens"))
    transactions = ws.save(transactions.select("tokens"))
    count = transactions.count()
    if not count:
        return ws.save(empty)
    # Half a row less than asked, as the library rounds share * count up.
    found = FPGrowth(itemsCol="tokens", minSupport=min(1.0, (least - 0.5) / count)).fit(transactions).freqItemsets
    sets = found.where(F.size("items") <= m.longest).select(F.array_sort("items").alias("tokens"))
    if whole:
        # A token that is a rule by itself is of no use in a larger one.
        useful = F.array_sort(F.collect_list(F.when(F.col("bad") < m.confidence * F.col("n"), F.col("token"))))
        long = telling.groupBy("url").agg(F.count("*").alias("_n"), useful.alias("tokens")).where(F.col("_n") > m.per_url)
        long = ws.save(long.select("tokens").distinct())
        sets = sets.union(totals.select(F.array("token").alias("tokens")))
        if m.longest > 1 and not long.isEmpty():
            sets = sets.union(grown_sets(long, held, totals, ws, m, least))
        sets = sets.distinct()
    sets = ws.save(posted(sets, totals.select("token", "n")))
    sure = _counted(held, sets, least)
    sure = ws.save(sure.where(F.col("support") >= m.confidence * F.col("n")).join(sets, "tokens"))
    within = sure.select("tokens", F.explode(parts_of(F.col("tokens"))).alias("part"))
    covered = within.join(sure.select(F.col("tokens").alias("part")), "part", "left_semi").select("tokens").distinct()
    return ws.save(sure.join(covered, "tokens", "left_anti").select("tokens", "support", "n", "post"))


def judged(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, m: Mining = Mining(), url_col: str = "url", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns of every page with (host, path, rule, verdict, mined): the fixed rule's verdict, else block where a mined rule fits, else allow.

    ``mined`` has the tokens of the mined rules that fit, written as a+b and
    joined by |; null where none does.
    """
    ws = Workspace(pages.sparkSession, "url-filters")
    index = mined_rules(labelled, ws, m, whole=True)
    urls = pages.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    hits = _holding(urls.withColumn("tokens", tokens_of(F.col("_url"))), index, "_url")
    hits = hits.groupBy("_url").agg(F.array_join(F.array_sort(F.collect_list(F.array_join("tokens", "+"))), "|").alias("mined"))
    parts = pages.select(*(carry or ["page_id"]), F.col(url_col).alias("_url")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    found = parts.join(hits, "_url", "left").withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_fixed.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return found.select(*(carry or ["page_id"]), "host", "path", F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"), "mined")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, unwanted): urls whose last number in the path is a labelled document's id; unwanted are toxic documents and those of low quality."""
    number = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*/(?:[^?#]*/)?([0-9]+)[^0-9/?#]*/?(?:[?#].*)?\z", 1).try_cast("bigint")
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", number.alias("doc_id")).where(F.col("doc_id").isNotNull())
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    known = known.groupBy("doc_id").agg(F.max(bad).alias("unwanted"))
    return urls.join(known, "doc_id").select("url", "unwanted")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return judged(pages, labelled_urls(pages, labels))


def oracle(m: Mining = Mining()) -> str:
    """DuckDB SQL for :func:`op12_url_filters`: the same rules by counting sets of up to three tokens."""
    az = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    whole = r"'(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z'"
    part = lambda k: f"coalesce(regexp_extract(url, {whole}, {k}), '')"
    named = lambda letter, c: f"list_transform(list_filter({c}, lambda x: x <> ''), lambda x: '{letter}:' || x)"
    tokens = f"""list_sort(list_distinct({named("scheme", f"[translate({part(1)}, {az})]")} || {named("host", f"string_split(translate({part(2)}, {az}), '.')")}
      || {named("path", f"list_transform(string_split({part(3)}, '/'), lambda x: regexp_replace(x, '[0-9]+', '#', 'g'))")}
      || {named("key", f"list_transform(regexp_split_to_array({part(4)}, '[&;]'), lambda x: split_part(x, '=', 1))")}
      || {named("fragment", f"[regexp_replace({part(5)}, '[0-9]+', '#', 'g')]")}))"""
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", written(h, p), v) for v, h, p in sorted(RULES, key=lambda r: -len(written(r[1], r[2])))]
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits) + " END"
    return f"""
WITH u AS (SELECT url, {tokens} AS tokens FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)),
n AS (
  SELECT url, tokens, try_cast(regexp_extract(url, '(?s)^.*?://[^/?#]*/(?:[^?#]*/)?([0-9]+)[^0-9/?#]*/?(?:[?#].*)?\\z', 1) AS BIGINT) AS doc_id FROM u
), l AS (
  SELECT doc_id, bool_or(coalesce(toxic = 1, false) OR coalesce(quality = 0, false)) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id
), h AS (SELECT url, tokens, bad FROM n JOIN l USING (doc_id) WHERE len(tokens) > 0),
least AS (SELECT greatest({m.least}, ceil({m.share} * count(*) FILTER (bad))) AS c FROM h),
e AS (SELECT url, bad, unnest(tokens) AS t FROM h),
f AS (SELECT t, count(*) AS n, count(*) FILTER (bad) AS b FROM e GROUP BY t HAVING count(*) FILTER (bad) >= (SELECT c FROM least)),
k AS (SELECT url, t FROM (SELECT url, t, row_number() OVER (PARTITION BY url ORDER BY -b / n, t) AS r FROM e JOIN f USING (t) WHERE bad) WHERE r <= {m.per_url}),
s AS (
  SELECT [a.t] AS set, count(*) AS c FROM k a GROUP BY 1
  UNION ALL SELECT [a.t, b.t], count(*) FROM k a JOIN k b ON a.url = b.url AND a.t < b.t GROUP BY 1
  UNION ALL SELECT [a.t, b.t, d.t], count(*) FROM k a JOIN k b ON a.url = b.url AND a.t < b.t JOIN k d ON a.url = d.url AND b.t < d.t GROUP BY 1
), r AS (
  SELECT set FROM (SELECT set FROM s WHERE c >= (SELECT c FROM least)) JOIN h ON list_has_all(tokens, set)
  GROUP BY set HAVING count(*) FILTER (bad) >= (SELECT c FROM least) AND count(*) FILTER (bad) >= {m.confidence} * count(*)
), q AS (SELECT set FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS o WHERE len(o.set) < len(r.set) AND list_has_all(r.set, o.set))),
b AS (SELECT url, string_agg(array_to_string(set, '+'), '|' ORDER BY array_to_string(set, '+')) AS mined FROM u JOIN q ON list_has_all(tokens, set) GROUP BY url),
p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {az}) AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN mined IS NULL THEN 'allow' ELSE 'block' END) AS verdict, mined
FROM p LEFT JOIN b USING (url)
"""


QUERIES = {"op12_url_filters": op12_url_filters}
ORACLES = {"op12_url_filters": oracle()}
