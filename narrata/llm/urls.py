"""URL filters: host and path rules, and a path-template tree for the urls that no rule decides. DataFrame functions only.

Rules label urls. The tree is built over the different urls of each host (copies of one url count once). From the root
down, level by level until no two urls share a node, the next segment of a node's urls names its children. A segment that
holds a digit is an id, a wildcard. Where a node has LEAST or more other children and they are about equally common
(their effective number, (sum c)^2 / sum c^2, is VARIED of their number or more), the segment is a variable, and its
children become one wildcard child, but for those whose labels differ from their siblings'. What is left of a path that
is alone below its node is one leaf.

From the leaves up, a child whose share of blocked labels does not differ from its siblings' (all else below the same
parent; two-proportion test at Z standard errors) is merged into the parent, which then stands against its own siblings;
one that differs stays a branch. A url belongs to the deepest branch above it, at last to its host. It is rejected if the
smoothed purity (blocked + STRENGTH * prior) / (labelled + STRENGTH) of that branch reaches REJECT, where the prior is the
share of blocked labels, smoothed alike, of the url's whole template over all hosts.

All that is counted is summed before it is shuffled, and joins split hot keys, so neither a host with a third of all urls
nor one url in a third of the rows lands in one task.

Defined cases: null urls, or urls without "://", have an empty host and path (and are judged by that branch); repeated
rows get equal results; other columns are ignored, or kept by filter_urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.llm.common import BROADCAST_LIMIT, hot_join, hot_keys, stage, table

# Fixed values of the contract: rule (host/path) and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
VARIED, LEAST = 0.5, 8
Z, STRENGTH, REJECT = 1.96, 2.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_PARTS = "cast(array() as array<string>)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """struct<rule, verdict> of the longest rule that fits the host, or a parent of it, and begins the path; or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, under = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + under)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("verdict"))).otherwise(out)
    return out


def fetched(rows: DataFrame, lookup: DataFrame, key: str, by: str) -> DataFrame:
    """rows left-joined with lookup (staged, one row for each key), broadcast if its strings are small, else by hot_join."""
    n = lookup.agg(F.sum(F.length(F.to_json(F.struct("*"))) + 64)).head()[0] or 0
    if n <= BROADCAST_LIMIT:
        return rows.join(F.broadcast(lookup), key, "left")
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return hot_join(rows, lookup, key, by, stage(hot_keys(counts, key, rows.count()), "hot"), "left")


def differs(n: Column, blocked: Column, all_n: Column, all_blocked: Column) -> Column:
    """Whether the share of blocked among a child's labels is not that of its siblings (all without the child)."""
    rest, share = all_n - n, F.try_divide(all_blocked, all_n)
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), rest)))
    apart = F.abs(F.try_divide(blocked, n) - F.try_divide(all_blocked - blocked, rest))
    return F.coalesce(apart > Z * error + 1e-9, F.lit(False))


total = lambda *columns: [F.sum(c).alias(c) for c in columns]
plain = lambda seg: F.when(seg.rlike("[0-9]"), F.lit("*")).otherwise(seg)


def templates(urls: DataFrame) -> tuple[DataFrame, int]:
    """urls with parts, the segments of the path's template; and the depth down to which urls share nodes.

    urls: one row for each host and path, with n and blocked, its labels.
    """
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    out = stage(urls.withColumn("left", parts).withColumn("parts", F.expr(NO_PARTS)), "url-level")
    depth = 0
    while True:
        seg = F.get("left", F.lit(0))
        out = out.withColumn("node", F.struct("host", "parts")).withColumn("seg", plain(seg))
        values = stage(out.where("seg is not null").groupBy("node", "seg").agg(F.count("*").alias("c"), *total("n", "blocked")), "url-values")
        if (values.agg(F.max("c")).head()[0] or 0) <= 1:
            return out.withColumn("parts", F.concat("parts", F.transform("left", plain))).drop("left", "node", "seg"), depth + 1
        named = F.when(F.col("seg") != "*", F.col("c").cast("double"))
        nodes = values.groupBy("node").agg(F.count(named).alias("d"), F.sum(named).alias("c"), F.sum(named * named).alias("c2"), *total("n", "blocked"))
        varied = stage(nodes.where((F.col("d") >= LEAST) & (F.col("c") * F.col("c") >= VARIED * F.col("d") * F.col("c2"))).select("node", F.col("n").alias("all_n"), F.col("blocked").alias("all_blocked")), "url-varied")
        apart = fetched(values.where("seg <> '*' and n > 0"), varied, "node", "seg").where(differs(*map(F.col, ("n", "blocked", "all_n", "all_blocked"))))
        apart = stage(apart.select(F.struct("node", "seg").alias("child"), F.lit(True).alias("apart")), "url-apart")
        out = fetched(out, varied.select("node", F.lit(True).alias("varied")), "node", "path").withColumn("child", F.struct("node", "seg"))
        out = fetched(out, apart, "child", "path")
        seg = F.when(F.coalesce("varied", F.lit(False)) & F.col("apart").isNull(), F.lit("*")).otherwise(F.col("seg"))
        out = out.withColumn("parts", F.when(F.col("seg").isNotNull(), F.concat("parts", F.array(seg))).otherwise(F.col("parts")))
        out = stage(out.withColumn("left", F.expr("slice(left, 2, size(left))")).drop("node", "seg", "child", "varied", "apart"), "url-level")
        depth += 1


def branches(leaves: DataFrame, depth: int) -> DataFrame:
    """host, parts, n, blocked of the branches that differ from their siblings, and of every host (no parts) for the rest.

    leaves: host, parts, n, blocked; nodes below `depth` hold one url each.
    """
    at = lambda k: F.slice("parts", 1, k)
    open_ = leaves.where("n > 0").groupBy("host", at(depth).alias("parts")).agg(*total("n", "blocked"))
    open_ = stage(open_, "url-open")
    done = []
    for k in range(depth, 0, -1):
        deep = open_.where(F.size("parts") == k)
        around = open_.where(F.size("parts") >= k - 1).groupBy("host", at(k - 1).alias("parent")).agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
        around = stage(around.select(F.struct("host", "parent").alias("above"), "all_n", "all_blocked"), "url-around")
        deep = fetched(deep.withColumn("above", F.struct("host", at(k - 1).alias("parent"))), around, "above", "parts")
        deep = stage(deep.withColumn("apart", differs(*map(F.col, ("n", "blocked", "all_n", "all_blocked")))).select("host", "parts", "n", "blocked", "apart"), "url-deep")
        done.append(deep.where("apart").drop("apart"))
        merged = deep.where("not apart").select("host", at(k - 1).alias("parts"), "n", "blocked")
        open_ = stage(open_.where(F.size("parts") < k).unionByName(merged).groupBy("host", "parts").agg(*total("n", "blocked")), "url-open")
    for more in done:
        open_ = open_.unionByName(more)
    return open_


def judged(leaves: DataFrame, depth: int) -> DataFrame:
    """leaf (host, parts), template, branch, reject of every template. leaves: host, parts, n, blocked."""
    found = branches(leaves, depth).select(F.struct("host", "parts").alias("above"), F.size("parts").alias("k"), F.col("n").alias("b_n"), F.col("blocked").alias("b_blocked"))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size("parts"), F.lit(depth))), lambda i: F.slice("parts", F.lit(1), i))
    each = leaves.select("host", "parts", F.explode(prefixes).alias("prefix")).select(F.struct("host", "parts").alias("leaf"), F.struct("host", F.col("prefix").alias("parts")).alias("above"))
    of = fetched(each, stage(found, "url-branches"), "above", "leaf").where("k is not null").groupBy("leaf").agg(F.max(F.struct("k", "b_n", "b_blocked")).alias("b"))
    everywhere = stage(leaves.groupBy("parts").agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked")), "url-everywhere")
    out = leaves.select(F.struct("host", "parts").alias("leaf"), "parts").join(of, "leaf", "left")
    out = fetched(out, everywhere, "parts", "leaf")
    prior = F.col("all_blocked") / (F.col("all_n") + STRENGTH)
    purity = (F.coalesce("b.b_blocked", F.lit(0)) + STRENGTH * prior) / (F.coalesce("b.b_n", F.lit(0)) + STRENGTH)
    spelled = lambda x: F.array_join(F.transform(x, lambda y: F.concat(F.lit("/"), y)), "")
    return out.select("leaf", spelled(F.col("parts")).alias("template"), spelled(F.slice("parts", F.lit(1), F.coalesce("b.k", F.lit(0)))).alias("branch"), (purity >= REJECT).alias("reject"))


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, branch for each row; the verdict is the rule's or else the branch's."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    paths = pages.groupBy("host", "path").agg(F.count("*").alias("rows")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    paths = paths.withColumn("n", F.col("rule").isNotNull().cast("long")).withColumn("blocked", F.coalesce(F.col("rule.verdict") == "block", F.lit(False)).cast("long"))
    known, depth = templates(paths)
    known = stage(known, "url-templates")
    leaves = stage(known.groupBy("host", "parts").agg(*total("n", "blocked")), "url-leaves")
    decided = fetched(known.withColumn("leaf", F.struct("host", "parts")), stage(judged(leaves, depth), "url-verdicts"), "leaf", "path")
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow")))
    decided = stage(decided.select(F.struct("host", "path").alias("url"), "rows", F.col("rule.rule").alias("rule"), verdict.alias("verdict"), "template", "branch"), "url-decided")
    hot = hot_keys(decided.select("url", F.col("rows").alias("n")), "url", known.agg(F.sum("rows")).head()[0] or 0)
    out = hot_join(pages.withColumn("url", F.struct("host", "path")), decided.drop("rows"), "url", "page_id", hot)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "branch")


def filter_urls(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """The rows of pages whose url is not blocked, with all their columns."""
    columns = pages.columns
    pages = pages.withColumn("_url_key", F.struct(host_of(F.col("url")), path_of(F.col("url"))))
    blocked = judge_urls(pages.select(F.lit(0).alias("page_id"), "url").distinct(), rules).where("verdict = 'block'")
    blocked = stage(blocked.select(F.struct("host", "path").alias("_url_key"), F.lit(True).alias("_url_blocked")).distinct(), "url-blocked")
    pages = pages.withColumn("_url_row", F.monotonically_increasing_id())
    return fetched(pages, blocked, "_url_key", "_url_row").where("_url_blocked is null").select(columns)


def op9_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
