"""URL filters by a path-template tree for each host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import ascii_lower, discard, join_once, table, written

#: Verdict, host and path of each rule; a rule holds for its host and all subdomains.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Different values under one parent from which rare ones become a wildcard, and the share of the parent that is not rare.
MAX_CHILDREN, KEPT_SHARE = 8, 0.02
#: Standard errors that a branch's share may differ from that of the branches before it, in the order of shares, and still be merged with them.
MERGE_Z = 2.0
#: Weight, in labelled urls, of a parent's share for its children, of a host's for its first segments and of the overall share for a host.
PRIOR_WEIGHT = 4.0
BLOCK_SHARE = 0.5
#: Segments that have a level of the tree each; what stands behind them is one segment.
LEVELS = 32


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does. The rules become one expression: for some hundreds of them."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda x: len(x[1] + x[2])):  # a longer one stands outside and wins
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape_of(segment: Column) -> Column:
    """Numbers, with or without an ending, and long ids become wildcards; other segments stay."""
    return (
        F.when(segment.rlike(r"\A[0-9]+\z"), F.lit("{n}"))
        .when(segment.rlike(r"\A[0-9]+\.[a-zA-Z0-9]+\z"), F.concat(F.lit("{n}"), F.regexp_extract(segment, r"(\.[a-zA-Z0-9]+)\z", 1)))
        .when((F.length(segment) >= 16) & segment.rlike("[0-9]"), F.lit("{id}"))
        .otherwise(segment)
    )


def _children(paths: DataFrame, level: int, max_children: int, merge_z: float) -> DataFrame:
    """(host, node, branches, n) for each node with children at `level`: a map from a child's segment to its branch (node, share), {w} for those not in it.

    A child is kept if its node has few of them or it has KEPT_SHARE of the node's urls, so a node keeps 50 at most and its map is small.
    """
    keys = ["host", "node"]
    heads = written(
        paths.groupBy(*keys, "share", F.get("s", F.lit(level)).alias("seg"))
        .agg(F.sum("n").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count("*").alias("paths"))
    )
    nodes = heads.groupBy(*keys).agg(
        F.max("share").alias("share"), F.count("*").alias("n"), F.sum("urls").alias("all_urls"), F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"), F.sum("paths").alias("paths")
    )
    nodes = written(nodes)
    limits = nodes.select(*keys, "n", F.col("n").alias("children"), "all_urls")
    kept = join_once(heads.drop("share"), limits, keys).where((F.col("children") <= max_children) | (F.col("urls") >= F.col("all_urls") * KEPT_SHARE))
    kept = kept.groupBy(*keys).agg(F.collect_list(F.struct("seg", "labelled", "blocked")).alias("kept"), F.sum("labelled").alias("kept_labelled"), F.sum("blocked").alias("kept_blocked"), F.count("*").alias("n_kept"))
    zero = F.lit(0).cast("long")
    own = nodes.join(kept, keys, "left")
    rest = F.when(F.col("n") > F.coalesce("n_kept", zero), F.array(F.struct(F.lit("{w}").alias("seg"), (F.col("all_labelled") - F.coalesce("kept_labelled", zero)).alias("labelled"), (F.col("all_blocked") - F.coalesce("kept_blocked", zero)).alias("blocked"))))
    none = F.array().cast("array<struct<seg:string,labelled:bigint,blocked:bigint>>")
    own = own.withColumn("c", F.concat(F.coalesce("kept", none), F.coalesce(rest, none))).withColumn("rows", _grouped("c", merge_z))
    group = lambda g: F.filter("rows", lambda x: x["g"] == g)
    total = lambda rows, field: F.aggregate(rows, zero, lambda a, x: a + x[field])
    last = F.coalesce(F.array_max(F.transform("rows", lambda x: x["g"])), F.lit(0))
    sums = F.transform(F.sequence(F.lit(0), last), lambda g: F.struct(F.size(group(g)).alias("n"), total(group(g), "labelled").alias("labelled"), total(group(g), "blocked").alias("blocked")))
    own = own.withColumn("groups", sums)
    # numbers of the groups of several, in their order: the first is *, the next *2
    own = own.withColumn("several", F.filter(F.sequence(F.lit(0), last), lambda g: F.get("groups", g)["n"] > 1))

    def branch(x: Column) -> Column:
        g = F.get(F.transform(F.filter("rows", lambda y: y["seg"] == x["seg"]), lambda y: y["g"]), F.lit(0))
        number = F.coalesce(F.array_position("several", g), F.lit(0))
        name = F.when(number == 0, x["seg"]).when(number == 1, "*").otherwise(F.concat(F.lit("*"), number.cast("string")))
        labelled, blocked = (F.when(number > 0, F.get("groups", g)[c]).otherwise(x[c]) for c in ("labelled", "blocked"))
        return F.struct(F.concat(F.col("node"), F.lit("/"), name).alias("node"), ((blocked + PRIOR_WEIGHT * F.col("share")) / (labelled + PRIOR_WEIGHT)).alias("share"))

    branches = written(own.select(*keys, F.map_from_entries(F.transform("c", lambda x: F.struct(x["seg"], branch(x)))).alias("branches"), F.col("paths").alias("n")))
    discard(heads, nodes)
    return branches


def _grouped(children: str, merge_z: float) -> Column:
    """Children with labels in the order of their shares of blocked urls (then by name), each with the number g of its group.

    One joins the group before it if both shares come from one by the usual test of two shares, the group's being that of all its urls; else it begins the next.
    """
    share = lambda blocked, labelled: F.try_divide(blocked.cast("double"), labelled)
    known = F.filter(children, lambda x: x["labelled"] > 0)
    ordered = F.array_sort(F.transform(known, lambda x: F.struct(share(x["blocked"], x["labelled"]).alias("share"), x["seg"].alias("seg"), x["labelled"].alias("labelled"), x["blocked"].alias("blocked"))))
    zero = F.lit(0).cast("long")
    start = F.struct(F.array().cast("array<struct<seg:string,labelled:bigint,blocked:bigint,g:int>>").alias("rows"), zero.alias("labelled"), zero.alias("blocked"), F.lit(-1).alias("g"))

    def step(a: Column, x: Column) -> Column:
        p = share(a["blocked"] + x["blocked"], a["labelled"] + x["labelled"])
        error = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), x["labelled"]) + F.try_divide(F.lit(1.0), a["labelled"])))
        same = (a["labelled"] > 0) & (F.abs(x["share"] - share(a["blocked"], a["labelled"])) <= merge_z * error)
        g = F.when(same, a["g"]).otherwise(a["g"] + 1)
        row = F.struct(x["seg"].alias("seg"), x["labelled"].alias("labelled"), x["blocked"].alias("blocked"), g.alias("g"))
        so_far = lambda c: F.when(same, a[c]).otherwise(zero) + x[c]
        return F.struct(F.concat(a["rows"], F.array(row)).alias("rows"), so_far("labelled").alias("labelled"), so_far("blocked").alias("blocked"), g.alias("g"))

    return F.aggregate(ordered, start, step)["rows"]


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, max_children: int = MAX_CHILDREN, merge_z: float = MERGE_Z, levels: int = LEVELS) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, block_share) for each row of `pages`.

    Urls that a rule fits are labelled. Each host has a tree of its paths' segments, in which numbers and long ids are wildcards at once. Level by
    level, from the host down: where a node has more than `max_children` different segments, those with less than KEPT_SHARE of its urls
    become one wildcard {w}; then siblings stand in the order of their shares of blocked urls, and neighbours whose shares are within `merge_z` standard errors of
    each other merge and go on as one node: *, or *2 and so on where a node has several such groups. A branch without labels is left as it is. Each node's share is
    smoothed towards its parent's, the host's towards that of all urls; a template, the node where a path ends, is rejected from BLOCK_SHARE on.

    Null urls and urls without :// have an empty host and path, and are judged as one host; a path without segments ends at its host's node. Without
    labels the share is 0.5. Segments from the `levels`-th on count as one. Empty segments do not count; one that is itself written {w} or * (or *2) is that
    wildcard. Repeated rows and ids stay, each judged alike; an empty table gives an empty one; other columns are not read. A host or
    a node with very many paths is not brought together: its children are counted first, and its map of branches is sent to where its paths are.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, label = rule_of(F.col("host"), F.col("path"), rules)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    tail = F.array_join(F.slice(segments, levels, 1_000_000), "/")
    segments = F.when(F.size(segments) < levels, segments).otherwise(F.concat(F.slice(segments, 1, levels - 1), F.array(tail)))
    rows = rows.withColumns({"rule": rule, "label": label, "s": F.transform(segments, shape_of)})
    counts = written(rows.groupBy("host", "s").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")))
    hosts = written(counts.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count("*").alias("n"), F.max(F.size("s")).alias("depth")))
    overall = hosts.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.max("depth"), F.lit(0))).first()
    prior = float(overall[1] + 1) / float(overall[0] + 2)
    shares = hosts.select("host", ((F.col("blocked") + PRIOR_WEIGHT * prior) / (F.col("labelled") + PRIOR_WEIGHT)).alias("share"), "n")
    paths = written(join_once(counts, shares, ["host"]).withColumn("node", F.lit("")))
    ended = paths.where(F.size("s") == 0)
    for level in range(overall[2]):
        going = paths.where(F.size("s") > level)
        branches = _children(going, level, max_children, merge_z)
        found = F.coalesce(F.try_element_at("branches", F.get("s", F.lit(level))), F.try_element_at("branches", F.lit("{w}")))
        paths = written(join_once(going.drop("share"), branches, ["host", "node"]).withColumn("to", found).select("host", "s", "n", "labelled", "blocked", F.col("to.share").alias("share"), F.col("to.node").alias("node")))
        discard(branches)
        ended = ended.unionByName(paths.where(F.size("s") == level + 1))
    # every path with its template; as many rows as there are different paths
    templates = ended.select("host", "s", "n", F.when(F.col("node") == "", "/").otherwise(F.col("node")).alias("template"), F.col("share").alias("block_share"))
    verdict = F.coalesce("label", F.when(F.col("block_share") >= BLOCK_SHARE, "block").otherwise("allow"))
    return join_once(rows, templates, ["host", "s"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("block_share", 6).alias("block_share"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, block_share) of every page; see `judge_urls` for null urls, repeated rows and empty tables."""
    return judge_urls(table(spark, sf_dir, "pages"))


OP7_SQL = rf"""
WITH RECURSIVE u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), ru AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{h}', '{p}')" for k, h, p in RULES)}) v(kind, at_host, start)),
m AS (
  SELECT u.host, u.path, arg_max(at_host || start, length(at_host || start)) AS rule, arg_max(kind, length(at_host || start)) AS label
  FROM (SELECT DISTINCT host, path FROM u) u JOIN ru ON (u.host = at_host OR ends_with(u.host, '.' || at_host)) AND starts_with(u.path, start)
  GROUP BY ALL
), r AS (
  SELECT u.page_id, u.host, u.path, m.rule, m.label,
    list_transform(list_filter(string_split(u.path, '/'), lambda x: x <> ''), lambda s:
      CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{n}}'
        WHEN regexp_full_match(s, '[0-9]+\.[a-zA-Z0-9]+') THEN '{{n}}' || regexp_extract(s, '(\.[a-zA-Z0-9]+)$', 1)
        WHEN length(s) >= 16 AND regexp_matches(s, '[0-9]') THEN '{{id}}' ELSE s END) AS s
  FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
), c AS (SELECT host, s, count(*) AS n, count(label) AS l, count(*) FILTER (WHERE label = 'block') AS b FROM r GROUP BY 1, 2),
pr AS (SELECT (sum(b) + 1)::DOUBLE / (sum(l) + 2)::DOUBLE AS prior FROM c),
t(host, s, n, l, b, node, share, d) AS (
  SELECT host, s, n, l, b, '', (sum(b) OVER (PARTITION BY host) + {PRIOR_WEIGHT}::DOUBLE * prior) / (sum(l) OVER (PARTITION BY host) + {PRIOR_WEIGHT}::DOUBLE), 0 FROM c, pr
  UNION ALL
  SELECT host, s, n, l, b, node || '/' || CASE WHEN key NOT LIKE '*%' OR list_position(several, key) IS NULL THEN general WHEN list_position(several, key) = 1 THEN '*' ELSE '*' || list_position(several, key) END,
    (sum(b) OVER k + {PRIOR_WEIGHT}::DOUBLE * share) / (sum(l) OVER k + {PRIOR_WEIGHT}::DOUBLE), d + 1
  FROM (
    SELECT *, CASE WHEN gl > 0 THEN '*' || list_extract(list_filter(grouped, lambda x: x.seg = general), 1).g ELSE general END AS key,
      list_transform(list_filter(range(len(grouped)), lambda g: len(list_filter(grouped, lambda x: x.g = g)) > 1), lambda g: '*' || g) AS several
    FROM (
      SELECT *, list_reduce(list_sort(list_distinct(list_filter(kids, lambda x: x.l > 0))), lambda a, x: CASE
          WHEN a.l > 0 AND abs(x.share - a.b::DOUBLE / a.l) <= {MERGE_Z}::DOUBLE * sqrt((a.b + x.b)::DOUBLE / (a.l + x.l) * (1 - (a.b + x.b)::DOUBLE / (a.l + x.l)) * (1.0::DOUBLE / x.l + 1.0::DOUBLE / a.l))
          THEN {{'done': list_append(a.done, {{'seg': x.seg, 'g': a.g}}), 'l': a.l + x.l, 'b': a.b + x.b, 'g': a.g}}
          ELSE {{'done': list_append(a.done, {{'seg': x.seg, 'g': a.g + 1}}), 'l': x.l, 'b': x.b, 'g': a.g + 1}} END, {{'done': []::STRUCT(seg VARCHAR, g BIGINT)[], 'l': 0::HUGEINT, 'b': 0::HUGEINT, 'g': -1::BIGINT}}).done AS grouped
      FROM (SELECT *, list({{'share': CASE WHEN gl > 0 THEN gb::DOUBLE / gl ELSE 0 END, 'seg': general, 'l': gl, 'b': gb}}) OVER (PARTITION BY host, node) AS kids FROM (SELECT *, sum(l) OVER g AS gl, sum(b) OVER g AS gb
      FROM (
        SELECT *, CASE WHEN max(rank) OVER (PARTITION BY host, node) > {MAX_CHILDREN} AND sum(n) OVER (PARTITION BY host, node, seg) < sum(n) OVER (PARTITION BY host, node) * {KEPT_SHARE}::DOUBLE THEN '{{w}}' ELSE seg END AS general
        FROM (SELECT *, s[d + 1] AS seg, dense_rank() OVER (PARTITION BY host, node ORDER BY s[d + 1]) AS rank FROM t WHERE len(s) > d)
      ) WINDOW g AS (PARTITION BY host, node, general)))
    )
  ) WINDOW k AS (PARTITION BY host, node, key)
)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN share >= {BLOCK_SHARE} THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN node = '' THEN '/' ELSE node END AS template, round(share, 6) AS block_share
FROM r JOIN t USING (host, s) WHERE t.d = len(s)
"""
