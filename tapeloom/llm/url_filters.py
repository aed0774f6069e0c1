"""URL filters by a path-template tree.

Rules. A rule is a host and a path prefix with a verdict; it fits its host and all subdomains where the path starts with
the prefix, and the longest rule (host and path together) decides.

Templates. Where no rule fits, the method decides, taught by the URLs that have one. Per host, a path's segments are masked
(runs of 16 and more hex digits and runs of digits become `#`) and the distinct masked paths are counted. Then the tree grows from the host
down, one segment at a time, to any depth:
  * a segment is variable, and becomes `*`, unless at least `min_count` URLs and `min_share` of its node's have it, labelled or not;
    a node holds 1 / min_share such branches at most, and `*`;
  * sibling branches with labels are put in the order of their blocked shares, and neighbours whose shares don't differ by more
    than `z` standard deviations merge: `{de|es}`, or `*` if that is one of them. Branches without labels stay as they are;
  * below a node of fewer than `min_count` URLs no segment can be frequent, so all the rest is `*`.
A path's shape is its template with nothing merged and without the host. A template's purity is its blocked share, smoothed by
`smooth` labels at the purity of its shape on all hosts; that is smoothed by the purity of the nearest node above the template that has
labels, and that by the base rate of all labels. From `reject` on a template is rejected; where none of the three has a label, the URL is
allowed.

Only counts are shuffled before the last join, which brings each page its template's verdict: a hot host or template is
pre-aggregated, each level is stored once, and adaptive execution splits a host's pages in that join. Everything is native SQL.

Cases: a null URL, or one without `://`, has an empty host and path (its template is that of the empty host); repeated
rows and null ids stay rows of their own; very long URLs are read whole, a level for each segment that frequent paths share; ties
of shares go by the segment; without any label nothing is rejected; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, if_small, load, stored

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_COUNT, MIN_SHARE, Z, SMOOTH = 5, 0.02, 2.0, 10.0
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SUMS = ("n", "labelled", "blocked")


def split_url(url: Column) -> tuple[Column, Column]:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruled(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def masked(path: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(path, "[0-9a-f]{16,}", "#"), "[0-9]+", "#")
    return F.regexp_replace(plain, "^/", "")


def branches(kids: DataFrame, totals: DataFrame, min_count: int, min_share: float, z: float) -> DataFrame:
    """node, seg, branch: the frequent segments of each node and the branches that they fall into.

    kids: node, seg and their sums; totals: the same by node, as all_n and so on. A node has 1 / min_share rows at most.
    """
    frequent = kids.where(F.col("n") >= min_count).join(if_small(totals), "node").where(F.col("n") >= F.col("all_n") * F.lit(min_share)).select("node", "seg", *SUMS)
    rest = totals.select("node", F.lit(None).cast("string").alias("seg"), *(F.col(f"all_{c}").alias(c) for c in SUMS))
    minus = frequent.select("node", F.lit(None).cast("string").alias("seg"), *((-F.col(c)).alias(c) for c in SUMS))
    star = rest.union(minus).groupBy("node", "seg").agg(*(F.sum(c).alias(c) for c in SUMS)).where("n > 0")
    known = frequent.union(star).withColumn("known", F.col("labelled") > 0)
    order = W.partitionBy("node", "known").orderBy(F.col("blocked") / F.nullif("labelled", F.lit(0)), F.col("seg").asc_nulls_first())
    b, n = F.col("blocked").cast("double"), F.col("labelled").cast("double")
    b0, n0 = F.lag(b).over(order), F.lag(n).over(order)
    apart = F.pow(b0 * n - b * n0, F.lit(2.0)) * (n + n0) > F.lit(z * z) * n * n0 * (b + b0) * (n + n0 - b - b0)
    known = known.withColumn("apart", F.when(apart, 1).otherwise(0)).withColumn("run", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    alike = W.partitionBy("node", "known", "run")
    members = F.sort_array(F.collect_set(F.coalesce("seg", F.lit("*"))).over(alike))
    merged = F.when(F.max(F.col("seg").isNull()).over(alike), "*").otherwise(F.concat(F.lit("{"), F.array_join(members, "|"), F.lit("}")))
    name = F.when(~F.col("known") | (F.size(members) == 1), F.coalesce("seg", F.lit("*"))).otherwise(merged)
    return known.select("node", "seg", name.alias("branch")).where("seg is not null")


def grown(paths: DataFrame, base: float = 0.0, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, z: float = Z, smooth: float = SMOOTH) -> DataFrame:
    """paths with node, the template, shape, and up, the smoothed purity of the nearest labelled node above (null if none).
    paths: host, mask and SUMS, one row per distinct masked path of a host."""
    paths, done, i = paths.select("*", F.col("host").alias("node"), F.lit("").alias("shape"), F.lit(None).cast("double").alias("up"), F.lit(True).alias("open")), [], 0
    while True:
        paths = stored(paths, "paths")
        done.append(paths.where("not open"))
        here = paths.where("open").withColumn("seg", F.element_at(F.split("mask", "/"), i + 1))
        kids = here.groupBy("node", "seg").agg(*(F.sum(c).alias(c) for c in SUMS))
        totals = cut(kids.groupBy("node").agg(*(F.sum(c).alias(f"all_{c}") for c in SUMS)).where(F.col("all_n") >= min_count))
        rest = F.repeat(F.lit("/*"), F.size(F.split("mask", "/")) - i)
        if totals.isEmpty():
            done.append(paths.where("open").withColumns({"node": F.concat("node", rest), "shape": F.concat("shape", rest)}))
            return reduce(DataFrame.union, done).drop("open")
        found = if_small(cut(branches(kids, totals, min_count, min_share, z)))
        above = F.when(F.col("all_labelled") > 0, (F.col("all_blocked") + F.lit(smooth * base)) / (F.col("all_labelled") + F.lit(smooth)))
        here = here.join(if_small(totals.select("node", F.lit(True).alias("split"), above.alias("above"))), "node", "left").join(found, ["node", "seg"], "left")
        node = F.concat("node", F.when(F.col("split"), F.concat(F.lit("/"), F.coalesce("branch", F.lit("*")))).otherwise(rest))
        shape = F.concat("shape", F.when(F.col("split"), F.concat(F.lit("/"), F.when(F.col("branch").isNotNull(), F.col("seg")).otherwise("*"))).otherwise(rest))
        more = F.coalesce("split", F.lit(False)) & (F.size(F.split("mask", "/")) > i + 1)
        paths = here.select("host", "mask", *SUMS, node.alias("node"), shape.alias("shape"), F.coalesce("above", "up").alias("up"), more.alias("open"))
        i += 1


def templates(urls: DataFrame, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, z: float = Z, smooth: float = SMOOTH) -> DataFrame:
    """host, mask, template, purity: for each distinct masked path of a host; purity is null where nothing is known.
    urls: host, mask, verdict (null where there is no label)."""
    paths = urls.groupBy("host", "mask").agg(F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    paths = cut(paths)
    labelled, blocked = paths.agg(F.sum("labelled"), F.sum("blocked")).first()
    base = (blocked or 0) / (labelled or 1)
    paths = stored(grown(paths, base, min_count, min_share, z, smooth), "templates")

    def pool(by: str, to: str) -> DataFrame:
        return if_small(cut(paths.groupBy(F.col(by).alias(f"_{by}")).agg(F.sum("labelled").alias(f"{to}_n"), F.sum("blocked").alias(f"{to}_b")).where(F.col(f"{to}_n") > 0)))

    paths = paths.join(pool("node", "own"), F.col("node") == F.col("_node"), "left").join(pool("shape", "all"), F.col("shape") == F.col("_shape"), "left")
    own_n, own_b, all_n, all_b = (F.coalesce(c, F.lit(0)) for c in ("own_n", "own_b", "all_n", "all_b"))
    like = (all_b + F.lit(smooth) * F.coalesce("up", F.lit(base))) / (all_n + F.lit(smooth))
    purity = F.when((own_n + all_n > 0) | F.col("up").isNotNull(), (own_b + F.lit(smooth) * like) / (own_n + F.lit(smooth)))
    return paths.select("host", "mask", F.col("node").alias("template"), purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", key: str = "page_id", reject: float = 0.5) -> DataFrame:
    """Per page: key, host, path, rule, verdict, template, purity."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"), masked(F.col("path")).alias("mask"))
    known = stored(templates(rows).select(F.col("host").alias("_host"), F.col("mask").alias("_mask"), "template", "purity"), "known")
    said = F.coalesce("verdict", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return rows.join(if_small(known), (F.col("host") == F.col("_host")) & (F.col("mask") == F.col("_mask")), "left").select(F.col("key").alias(key), "host", "path", "rule", said.alias("verdict"), "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


SQL = r"""
WITH RECURSIVE u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(kind, h, p)),
hp AS (SELECT DISTINCT host, path FROM u),
fit AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(kind, length(h || p)) AS kind
        FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path),
r AS (SELECT u.*, fit.rule, fit.kind, regexp_replace(regexp_replace(regexp_replace(u.path, '[0-9a-f]{16,}', '#', 'g'), '[0-9]+', '#', 'g'), '^/', '') AS mask FROM u LEFT JOIN fit USING (host, path)),
p0 AS (SELECT host, mask, count(*) AS n, count(kind) AS labelled, count(*) FILTER (kind = 'block') AS blocked FROM r GROUP BY ALL),
base AS (SELECT coalesce(sum(blocked) / nullif(sum(labelled), 0), 0.0) AS base FROM p0),
walk AS (
  SELECT 0 AS i, host, mask, string_split(mask, '/') AS segs, n, labelled, blocked, host AS node, '' AS shape, CAST(NULL AS DOUBLE) AS up, base FROM p0, base
  UNION ALL
  SELECT i, host, mask, segs, n, labelled, blocked,
         node || '/' || CASE WHEN NOT frequent THEN '*' WHEN NOT known OR len(members) = 1 THEN seg WHEN holds_rest THEN '*' ELSE '{' || array_to_string(list_sort(members), '|') || '}' END,
         shape || '/' || CASE WHEN frequent THEN seg ELSE '*' END, coalesce(CASE WHEN all_n >= 5 AND all_labelled > 0 THEN (all_blocked + 10.0 * base) / (all_labelled + 10.0) END, up), base
  FROM (
    SELECT *, list_distinct(list(coalesce(sib, '*')) OVER alike) AS members, bool_or(sib IS NULL) OVER alike AS holds_rest
    FROM (
      SELECT *, sum(CASE WHEN pow(b0 * sl - sb * l0, 2.0) * (sl + l0) > 4.0 * sl * l0 * (sb + b0) * (sl + l0 - sb - b0) AND one THEN 1 ELSE 0 END)
                OVER (PARTITION BY node, known ORDER BY share, sib NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
      FROM (
        SELECT *, row_number() OVER (PARTITION BY node, sib) = 1 AS one,
               last_value(sb) OVER before AS b0, last_value(sl) OVER before AS l0
        FROM (
          SELECT *, sl > 0 AS known, sb / nullif(sl, 0) AS share FROM (
            SELECT *, CASE WHEN frequent THEN seg END AS sib,
                   CAST(sum(labelled) OVER (PARTITION BY node, CASE WHEN frequent THEN seg END) AS DOUBLE) AS sl,
                   CAST(sum(blocked) OVER (PARTITION BY node, CASE WHEN frequent THEN seg END) AS DOUBLE) AS sb
            FROM (
              SELECT i + 1 AS i, host, mask, segs, n, labelled, blocked, node, shape, up, base, segs[i + 1] AS seg,
                     sum(n) OVER (PARTITION BY node) AS all_n, sum(labelled) OVER (PARTITION BY node) AS all_labelled, sum(blocked) OVER (PARTITION BY node) AS all_blocked,
                     sum(n) OVER (PARTITION BY node, segs[i + 1]) >= 5 AND sum(n) OVER (PARTITION BY node, segs[i + 1]) >= 0.02 * sum(n) OVER (PARTITION BY node) AS frequent
              FROM walk WHERE len(segs) > i)))
        WINDOW before AS (PARTITION BY node, known ORDER BY share, sib NULLS FIRST GROUPS BETWEEN 1 PRECEDING AND 1 PRECEDING)))
    WINDOW alike AS (PARTITION BY node, known, run))
),
t AS (SELECT host, mask, labelled, blocked, node AS template, shape, up, base FROM walk WHERE len(segs) = i),
f AS (SELECT host, mask, template, sum(labelled) OVER own + sum(labelled) OVER alike > 0 OR up IS NOT NULL AS known,
             (sum(blocked) OVER own + 10.0 * ((sum(blocked) OVER alike + 10.0 * coalesce(up, base)) / (sum(labelled) OVER alike + 10.0))) / (sum(labelled) OVER own + 10.0) AS purity
      FROM t WINDOW own AS (PARTITION BY template), alike AS (PARTITION BY shape))
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN known AND purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template
FROM r JOIN f USING (host, mask)
"""

QUERIES = {"op2_url_filters": query}
ORACLE = {"op2_url_filters": SQL}
