"""Operator 10: mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources in code-point order (null last) carry repeating weights and share a percentage of all words; a
target stops at ``cap`` times its source's words, and the excess is shared again by weight.

Copies: within a source a document expects e = min(cap, μ·w) copies, where w grows with its length level and μ makes
the expected words meet the target. floor(e) copies are certain; the fraction π = e − floor(e) is an inclusion
probability. Documents are ranked by Pareto's statistic, their random odds u/(1−u) divided by the inclusion odds
π/(1−π), and taken in that order until the words that certain copies leave open are filled. The rank is used as
t = q/(1+q), which orders alike and stays within 0 and 1.

The place where the order is cut is found without ranking a source in one task: words are summed per source and
rank cell, the cell that crosses the remainder is cut into cells again, and only the ranks of one cell of a cell
(1/16,777,216 of a source on average) are compared singly. A decision then is an expression on a document and its
source's cut, so nothing is joined by document and a source may hold any share of the rows.

Randomness is an MD5 of id and text, so reruns agree. Defined results: a null text has size 0, takes 0 words and
keeps its source's target; rows equal in id, text and source are peers, taken together or not at all; an empty table
gives no rows; a null source is a source of its own; other columns are neither read nor renamed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from citegrain.llm.common import WORD_PATTERN, stored

WEIGHTS = (5, 2, 1)
PERCENT = 150
CAP = 2
CELLS = 4096
LEVEL_STEP = 16


def words(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(id_col: str, text_col: str) -> Column:
    """A number inside (0, 1) from the MD5 of id and text."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def level(size: Column) -> Column:
    """Length level: binary digits of the size."""
    return F.length(F.bin(size)).cast("int")


def level_weight(level_col: str | Column) -> Column:
    """Weight of a document by its length level."""
    return F.lit(1.0) + (F.col(level_col) if isinstance(level_col, str) else level_col) / F.lit(float(LEVEL_STEP))


def source_targets(sizes: DataFrame, weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> DataFrame:
    """Target words per source, from a table of ``source`` and ``source_size``: one row per source, so one task does.

    Sources in order of the ratio size ÷ weight are capped one after the other; the first that stays below its cap
    when all before it are capped sets the level for the rest.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    filling = Window.orderBy(cap * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    open_words = F.lit(percent / 100.0) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
    share = open_words / F.sum("w").over(after)
    ranked = ranked.withColumn("share", share).withColumn("at", F.row_number().over(filling))
    ranked = ranked.withColumn("full", cap * F.col("source_size") <= F.col("w") * F.col("share"))
    first_share = F.min_by("share", F.when(~F.col("full"), F.col("at"))).over(everything)
    return ranked.withColumn("first_share", first_share).select(
        "source", "source_size", F.when(F.col("full"), cap * F.col("source_size").cast("double")).otherwise(F.col("w") * F.col("first_share")).alias("target"),
    )


def expected_copies(levels: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Certain copies, inclusion probability and open words per source and length level.

    ``levels`` has ``source``, ``level`` and ``level_size``; a source has at most 64 levels. The highest levels meet
    the cap first; the first level below it sets the factor for the rest.
    """
    down = Window.partitionBy("source").orderBy(F.desc("level"))
    before, after = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("source")
    rows = levels.join(targets, levels["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    weight = level_weight("level")
    mass = F.sum(F.col("level_size") * weight).over(after)
    factor = F.try_divide(F.col("target") - cap * F.coalesce(F.sum("level_size").over(before), F.lit(0)), mass)
    rows = rows.withColumn("factor", F.coalesce(factor, F.lit(0.0)))
    rows = rows.withColumn("full", F.col("factor") * weight >= cap)
    rows = rows.withColumn("mu", F.max_by("factor", F.when(~F.col("full"), F.col("level"))).over(whole))
    copies = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.col("mu") * weight)))
    rows = rows.withColumn("copies", copies).withColumn("certain", F.floor("copies"))
    return rows.select(
        "source", "level", "source_size", "target", "certain", (F.col("copies") - F.col("certain")).alias("pi"),
        (F.col("target") - F.sum(F.col("certain") * F.col("level_size")).over(whole)).alias("open"),
    )


def rank_statistic(u: Column, pi: Column) -> Column:
    """Pareto's q = (u/(1−u)) ÷ (π/(1−π)) as q/(1+q); 1 where π is 0."""
    return u * (1 - pi) / (u * (1 - pi) + (1 - u) * pi)


def plan(sized: DataFrame, weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP, cells: int = CELLS) -> DataFrame:
    """Per source and level: sizes, target, certain copies, π and the rank at which the order is cut.

    ``sized`` has ``source``, ``size``, ``level`` and ``u``, and is read several times.
    """
    levels = sized.groupBy("source", "level").agg(F.sum("size").alias("level_size"))
    sizes = levels.groupBy("source").agg(F.sum("level_size").alias("source_size"))
    state = stored(expected_copies(levels, source_targets(sizes, weights, percent, cap), cap), "mix-state")
    ranked = joined(sized, state, "source", "level").where((F.col("pi") > 0) & (F.col("size") > 0))
    ranked = ranked.select("source", "size", "open", rank_statistic(F.col("u"), F.col("pi")).alias("t"))
    first = ranked.withColumn("cell", F.floor(F.col("t") * cells))
    cut = crossing(first, "cell", None)
    within = joined(first, cut.select("source", F.col("at").alias("at1"), F.col("before").alias("before1")), "source").where(F.col("cell") == F.col("at1"))
    second = within.withColumn("sub", F.floor((F.col("t") * cells - F.col("cell")) * cells))
    cut2 = crossing(second, "sub", "before1")
    last = joined(second, cut2.select("source", F.col("at").alias("at2"), F.col("before").alias("before2")), "source").where(F.col("sub") == F.col("at2"))
    peers = last.groupBy("source", "t").agg(F.sum("size").alias("size"), F.first("open").alias("open"), F.first("before2").alias("before2"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("t"))
    single = peers.withColumn("upto", upto + F.col("before2")).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("open"))
    single = single.groupBy("source").agg(F.max("t").alias("single_t"))
    # without a single rank taken, everything below the crossing cell of the cell is
    edge1 = cut.select("source", "at")
    edge2 = cut2.select("source", F.col("at").alias("at2"))
    edges = joined(edge1, edge2, "source", how="left")
    edges = joined(edges, single, "source", how="left").select(
        "source", "single_t", F.when(F.col("at2").isNotNull(), (F.col("at") + F.col("at2") / cells) / cells).otherwise(F.col("at") / cells).alias("edge_t"),
    )
    return stored(joined(state, edges, "source", how="left"), "mix-plan")


def crossing(rows: DataFrame, cell: str, before: str | None) -> DataFrame:
    """Per source the first cell whose words, added to those of earlier cells, exceed the open words."""
    keys = [F.first("open").alias("open"), (F.first(before) if before else F.lit(0)).alias("start")]
    sums = rows.groupBy("source", cell).agg(F.sum("size").alias("words"), *keys)
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(cell)) + F.col("start")
    over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("open"))
    return over.groupBy("source").agg(F.min(cell).alias("at"), F.min(F.col("upto") - F.col("words")).alias("before"))


def joined(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Equi-join in which null meets null, with the left side's keys."""
    condition = None
    for key in keys:
        same = left[key].eqNullSafe(right[key])
        condition = same if condition is None else condition & same
    return left.join(right, condition, how).drop(*[right[key] for key in keys])


def taken_copies() -> Column:
    """Copies of a document, from the columns of its plan row, ``u`` and ``size``."""
    t = rank_statistic(F.col("u"), F.col("pi"))
    # every rank is below an edge of 1 if no cell crosses, that is if all of the fraction is taken
    sampled = (F.col("pi") > 0) & (F.col("edge_t").isNull() | (t < F.col("edge_t")) | (t <= F.col("single_t")))
    return F.col("certain") + F.when(F.coalesce(sampled, F.lit(False)), 1).otherwise(0)


def sized(docs: DataFrame, carried: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Source, size, level and random number of documents beside one carried column, ``__kept``."""
    rows = docs.select(
        carried.alias("__kept"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), uniform(id_col, text_col).alias("u"),
    )
    return rows.withColumn("level", level(F.col("size")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP,
) -> DataFrame:
    """Size, source size, target and taken words of each document."""
    rows = stored(sized(docs, F.col(id_col), id_col, text_col, source_col), "mix-sizes")
    found = joined(rows, plan(rows, weights, percent, cap), "source", "level")
    taken = F.col("size") * taken_copies()
    return found.select(F.col("__kept").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP,
) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns. Documents without words go."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(sized(docs, F.lit(None).cast("string"), id_col, text_col, source_col).drop("__kept"), "mix-sizes")
    found = joined(sized(docs, whole, id_col, text_col, source_col), plan(rows, weights, percent, cap), "source", "level")
    copies = F.when(F.col("size") > 0, taken_copies()).otherwise(0).cast("int")
    return found.select(F.explode(F.array_repeat("__kept", copies)).alias("__kept")).select("__kept.*")
