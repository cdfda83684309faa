"""Operator 2: URL filters by a tree of path templates, with DataFrame functions only.

Per host a tree of path segments grows level by level. A segment that holds too small a share of its parent's URLs
is variable and becomes ``*``; frequent segments stay literal, and literal siblings whose labelled block rates do
not differ by more than Hoeffding's bound are merged into one branch ``{a|b}``, each compared with all that its branch
holds. The rules label the URLs they fit. A template's purity is the block share of its labels, smoothed down the tree:
from the table to the host, from the host to its first branch and on to the template, so that a branch without labels
is judged by the one it grows from. A template is rejected from the purity on that puts the fewest held-out labelled
URLs wrong, if its host has labels at all. A rule's verdict on a URL it fits goes before its template's.

Levels count distinct paths, pre-aggregated before they move; at most 1/``literal_share`` siblings are literal, so
only that many of a parent meet in a list. Below ``depth`` levels the rest of a path is one ``**``.

Defined results: a null URL, or one without ``://``, has an empty host and path and is judged like any other;
repeated rows are judged alike, an empty table gives no rows; other columns are not read. With no labels at all
nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citegrain.llm.common import stored

DEPTH = 6
LITERAL_SHARE = 0.05
MIN_SUPPORT = 2
CONFIDENCE = 0.05
PRIOR_STRENGTH = 4.0
# One labelled path of so many is kept from the purities when the threshold is chosen.
HELD_OUT = 4

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; empty if there is no ``://``."""
    c = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(c, "://")
    rest = F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule (verdict, ``host/path``) that fits, as a struct of rule and verdict; null if none does.

    Rules are configuration: a short list becomes one expression.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + start))
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _similar(one: Column, other: Column) -> Column:
    """Whether the label rates of two branches differ by no more than Hoeffding's bound; both must be labelled."""
    rate = lambda s: F.try_divide(s["blocked"], s["labelled"])
    width = lambda s: 1 / F.sqrt(F.greatest(s["labelled"], F.lit(1)))
    bound = F.sqrt(F.lit(0.5) * F.log(F.lit(2.0 / CONFIDENCE))) * (width(one) + width(other))
    return (one["labelled"] > 0) & (other["labelled"] > 0) & (F.abs(rate(one) - rate(other)) <= bound)


def _branches(children: Column) -> Column:
    """Children in order of their rates, merged one after the other into the last branch if they are like all of it."""
    kind = "array<struct<members:array<string>,labelled:bigint,blocked:bigint>>"
    own = lambda c: F.struct(F.array(c["segment"]).alias("members"), c["labelled"].alias("labelled"), c["blocked"].alias("blocked"))

    def add(done: Column, child: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = F.struct(
            F.concat(last["members"], F.array(child["segment"])).alias("members"), (last["labelled"] + child["labelled"]).alias("labelled"),
            (last["blocked"] + child["blocked"]).alias("blocked"),
        )
        merged = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))
        return F.when((F.size(done) > 0) & _similar(last, child), merged).otherwise(F.concat(done, F.array(own(child)))).cast(kind)

    return F.aggregate(children, F.array().cast(kind), add)


def _literals(rows: DataFrame, literal_share: float, min_support: int) -> DataFrame:
    """Branch names of the literal segments of a level: template, segment and name."""
    child = rows.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    parent = rows.groupBy(F.col("host").alias("h"), F.col("template").alias("t")).agg(F.sum("n").alias("total"))
    frequent = child.join(parent, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t"))).where(
        (F.col("n") >= min_support) & (F.col("n") >= literal_share * F.col("total"))
    )
    # at most 1 / literal_share children of a parent are frequent
    rate = F.coalesce(F.try_divide("blocked", "labelled"), F.lit(-1.0)).alias("rate")
    lists = frequent.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct(rate, "segment", "labelled", "blocked"))).alias("children"))
    branch = lists.select("host", "template", F.explode(_branches(F.col("children"))["members"]).alias("members"))
    escaped = F.array_sort(F.transform("members", lambda m: F.replace(m, F.lit("*"), F.lit("%2A"))))
    name = F.when(F.size("members") > 1, F.concat(F.lit("{"), F.array_join(escaped, "|"), F.lit("}"))).otherwise(escaped[0])
    return branch.select(F.col("host").alias("h"), F.col("template").alias("t"), F.explode("members").alias("s"), name.alias("name"))


def templates(paths: DataFrame, depth: int = DEPTH, literal_share: float = LITERAL_SHARE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Template of each distinct path: ``paths`` has host, path, n, labelled and blocked."""
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("path", 2, 1 << 30), "/"))
    rows = stored(paths.withColumn("segments", segments).withColumn("template", F.lit("")), "url-paths")
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for at in range(min(depth, deepest)):
        open_rows = rows.where(F.size("segments") > at).withColumn("segment", F.col("segments")[at])
        names = _literals(open_rows, literal_share, min_support)
        named = open_rows.join(names, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("segment") == F.col("s")), "left")
        grown = named.withColumn("template", F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*")))).select(*rows.columns)
        rows = stored(grown.unionByName(rows.where(F.size("segments") <= at)), f"url-level-{at}")
    rest = F.when(F.size("segments") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return rows.withColumn("template", rest).drop("segments")


def purities(tree: DataFrame, prior_strength: float) -> DataFrame:
    """Smoothed block share of each template, and the labels of its whole host: host, template, purity, evidence.

    Shares are smoothed down the tree: the table's share towards the host's, the host's towards that of its first
    segment, and so on, each by the labels it has itself, so a template without labels has the share of its branch.
    """
    counts = stored(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), "url-counts")
    labels = counts.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).first()
    prior = labels["b"] / labels["n"] if labels["n"] else 0.0
    parts = F.split("template", "/")
    nodes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("node")))
    spread = counts.select("host", "template", "labelled", "blocked", F.explode(nodes).alias("at")).select("host", "template", "labelled", "blocked", "at.*")
    # sums of prefixes are few rows a host; both sides are stored, so that Spark can split a frequent one
    sums = stored(spread.groupBy(F.col("host").alias("h"), F.col("node").alias("t")).agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")), "url-nodes")
    spread = stored(spread.select("host", "template", "depth", "node"), "url-prefixes")
    path = spread.join(sums, (F.col("host") == F.col("h")) & (F.col("node") == F.col("t"))).groupBy("host", "template").agg(
        F.array_sort(F.collect_list(F.struct("depth", "n", "b"))).alias("path")
    )
    smoothed = lambda share, at: (at["b"] + prior_strength * share) / (at["n"] + prior_strength)
    return path.select("host", "template", F.aggregate("path", F.lit(float(prior)), smoothed).alias("purity"), F.col("path")[0]["n"].alias("evidence"))


def threshold(tree: DataFrame, held: Column, prior_strength: float) -> float | None:
    """The purity from which on a template is best rejected, judged by labels that the purities have not seen.

    Of the steps of 0.05 from 0.5 to 0.95 the one that puts the fewest held-out labelled URLs wrong, the highest of equal
    ones; null without labels. A row per step goes to the driver.
    """
    seen = tree.withColumns({c: F.when(held, 0).otherwise(F.col(c)) for c in ("labelled", "blocked")})
    step = F.floor(F.round(F.col("purity") * 20, 6)).cast("int").alias("step")
    judged = tree.where(held & (F.col("labelled") > 0)).join(purities(seen, prior_strength), ["host", "template"])
    found = judged.groupBy(step).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")).collect()
    wrong = {t: sum(r["n"] - r["b"] if r["step"] >= t else r["b"] for r in found) for t in range(10, 20)}
    return max(t for t in wrong if wrong[t] == min(wrong.values())) / 20 if found else None


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    depth: int = DEPTH, prior_strength: float = PRIOR_STRENGTH, min_purity: float | None = None,
) -> DataFrame:
    """Host, path, rule, verdict, template and smoothed purity of each URL; ``min_purity`` stands for the chosen threshold."""
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    found = F.col("found")
    rows = stored(rows.withColumn("found", rule_of(rules, F.col("host"), F.col("path"))), "url-rows")
    paths = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count(found).alias("labelled"), F.count_if(found["verdict"] == "block").alias("blocked"),
    )
    tree = templates(paths, depth)
    if min_purity is None:
        held = F.crc32(F.concat("host", "path").cast("binary")) % HELD_OUT == 0
        min_purity = threshold(tree.select("host", "path", "template", "labelled", "blocked"), held, prior_strength)
    # a host without labels has nothing but the table's share, which is no evidence against it
    reject = F.lit(False) if min_purity is None else (F.col("evidence") > 0) & (F.round(F.col("purity"), 6) >= min_purity)
    judged = stored(purities(tree, prior_strength).withColumn("reject", reject).drop("evidence"), "url-purities")
    verdicts = tree.select("host", "path", "template").join(judged, ["host", "template"])
    return rows.join(verdicts, ["host", "path"]).select(
        F.col("__id").alias(id_col), "host", "path", found["rule"].alias("rule"),
        F.coalesce(found["verdict"], F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"), "template", "purity",
    )
