"""Query → page mapping by shared tokens, exact top-k of blocks of queries on shards of URLs, without storing pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from citegrain.functions.text import match_tokens, text_or_empty
from citegrain.operators.frames import first_n
from citegrain.operators.ordinals import first_or_all
from citegrain.session import checkpointed

# Fixed values: (term in the query, terms in the URL), each worth BOOST points.
BOOST = 3
BOOST_RULES = (
    ("ev", ("ev", "ariya", "leaf")),
    ("service", ("service", "support")),
    ("dealer", ("dealer", "shop")),
    ("safety", ("safety",)),
    ("finance", ("finance", "price")),
)
# A run's bit pattern has a place for so many words, and BOOST places for each boost.
PATTERN_WORDS = 63 - BOOST * len(BOOST_RULES)
# Words in at most one of so many URLs are rare.
RARE_SHARE = 64
# URLs of a shard; query sets of a block: at least so many and, from BLOCKS blocks on, at most so many.
URLS_PER_SHARD = 250_000
BLOCKS, LEAST_SETS, SETS_PER_BLOCK = 16, 500, 32_000
MOST_TASKS = 10_000
REASON = "Sitemap lexical match against query, topic and recommended page type."


def _boosts(low: Column, side: int) -> Column:
    hits = []
    for query_term, url_terms in BOOST_RULES:
        terms = (query_term,) if side == 0 else url_terms
        test = F.lit(False)
        for term in terms:
            test = test | F.contains(low, F.lit(term))
        hits.append(F.when(test, F.lit(f"boost:{query_term}")))
    return F.array_compact(F.array(*hits))


def query_tokens(queries: DataFrame, run: str = "run_id") -> DataFrame:
    parts = [text_or_empty(c) for c in ("query", "topic", "recommended_page_type") if c in queries.columns]
    text = F.concat_ws(" ", *parts)
    return queries.select(run, F.col("pos").alias("qpos"), F.explode(F.concat(match_tokens(text), _boosts(F.lower(text), 0))).alias("token"))


def url_token_rows(urls: DataFrame, run: str = "run_id") -> DataFrame:
    tokens = match_tokens(F.translate("url", "-_/", "   "))
    return urls.select(run, F.col("pos").alias("upos"), F.explode(
        F.concat(tokens, _boosts(F.lower("url"), 1))
    ).alias("token"))


def _weight(token: Column) -> Column:
    """What a token shared by a query and a URL is worth."""
    return F.when(token.startswith("boost:"), BOOST).otherwise(1)


def _told_apart(sets: DataFrame, urls: DataFrame, run: str, frequent: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens of query sets and of URLs, and what each set gains on all URLs of its run alike.

    Tokens that no query asks for are left out, and those that every URL of a run has only shift a set's scores. Boosts
    and the ``frequent`` most common tokens of a run, by default those in more than one of ``RARE_SHARE`` URLs, are
    told by ``bits``, the places they take in the run's bit patterns: as many as the token is worth.
    """
    u_tokens = url_token_rows(urls, run)
    sizes = urls.groupBy(run).agg(F.count("*").alias("n_urls"))
    q_tokens = sets.select(run, "qset", F.explode("tokens").alias("token"))
    counted = u_tokens.groupBy(run, "token").agg(F.count("*").alias("n")).join(q_tokens.select(run, "token").distinct(), [run, "token"], "left_semi")
    counted = counted.join(sizes, run).withColumn("everywhere", F.col("n") == F.col("n_urls"))
    words = counted.where(~F.col("everywhere") & ~F.col("token").startswith("boost:"))
    places = first_n(words, run, [F.desc("n"), "token"], PATTERN_WORDS if frequent is None else max(min(frequent, PATTERN_WORDS), 1), rank="place")
    is_common = F.col("n") * RARE_SHARE > F.col("n_urls") if frequent is None else F.col("place") <= frequent
    common = places.where(is_common).select(run, "token", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place") - 1).alias("bit"))
    boosts = F.coalesce(*[
        F.when(F.col("token") == f"boost:{term}", F.lit(((1 << BOOST) - 1) << (PATTERN_WORDS + BOOST * i)).cast("bigint"))
        for i, (term, _) in enumerate(BOOST_RULES)
    ])
    kinds = counted.drop("n_urls").join(common, [run, "token"], "left").select(
        run, "token", "n", "everywhere", F.coalesce(boosts, F.col("bit")).alias("bits"), _weight(F.col("token")).alias("weight"))
    # both are read several times: stored once, the plan of each use stays small
    q_kinds, u_kinds = checkpointed(q_tokens.join(kinds, [run, "token"])), checkpointed(u_tokens.join(kinds.where("NOT everywhere").drop("everywhere"), [run, "token"]))
    shift = q_kinds.where("everywhere").groupBy(run, "qset").agg(F.sum("weight").alias("shift"))
    return q_kinds.where("NOT everywhere").drop("everywhere"), u_kinds, shift


class _Shard:
    """URLs of one shard, held in the order of ties: bit patterns of frequent tokens and postings of rare ones."""

    def __init__(self, masks: np.ndarray, rare: np.ndarray, owners: np.ndarray):
        # patterns are numbered by their first URL, so that of equal patterns' scores the earlier one comes first
        masks, first, inverse = np.unique(masks, return_index=True, return_inverse=True)
        by_first = np.argsort(first)
        number = np.empty(len(masks), np.int64)
        number[by_first] = np.arange(len(masks))
        self.masks, self.pattern = masks[by_first], number[inverse]
        self.urls = np.argsort(self.pattern, kind="stable")
        self.ends = np.cumsum(np.bincount(self.pattern, minlength=len(masks)))
        self.starts = np.append(0, self.ends[:-1])
        order = np.argsort(rare, kind="stable")
        self.rare, self.owners = rare[order], owners[order]

    def best(self, mask: np.uint64, rare: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best URLs and their scores, best first; URLs that share nothing are not found.

        A URL among the best shares a rare token, or it is among the k best by its pattern alone.
        """
        exact = np.bitwise_count(self.masks & mask)
        found, have, level = [], 0, int(exact.max(initial=0))
        while level > 0 and have < k:
            for p in np.flatnonzero(exact == level)[:k].tolist():
                found.append(self.urls[self.starts[p]:min(self.ends[p], self.starts[p] + k)])
                have += len(found[-1])
            level -= 1
        cuts = zip(np.searchsorted(self.rare, rare).tolist(), np.searchsorted(self.rare, rare, "right").tolist())
        shared = [self.owners[a:b] for a, b in cuts if a < b]
        urls, times = np.unique(np.concatenate(shared), return_counts=True) if shared else (np.zeros(0, np.int64),) * 2
        # a URL found both ways counts with its rare tokens
        plain = np.setdiff1d(np.concatenate(found), urls) if found else np.zeros(0, np.int64)
        urls, times = np.append(urls, plain), np.append(times, np.zeros(len(plain), np.int64))
        scores = times + exact[self.pattern[urls]]
        at = np.lexsort((urls, -scores))[:k]
        return urls[at], scores[at]


def _profiles(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Bit pattern and rare tokens of each row's tokens."""
    return tokens.groupBy(*keys).agg(
        F.coalesce(F.bit_or("bits"), F.lit(0).cast("bigint")).alias("mask"),
        F.collect_set(F.when(F.col("bits").isNull(), F.xxhash64("token"))).alias("rare"),
    )


def _order_key() -> Column:
    """The length of a URL as it orders, nulls first."""
    return F.coalesce("ulen", F.lit(-1)).cast("bigint").alias("ukey")


def candidate_pairs(q_tokens: DataFrame, u_tokens: DataFrame, keyed: DataFrame, k: int, run: str) -> DataFrame:
    """(set, URL) pairs with their scores that hold every set's best ``k`` URLs: at most ``k`` per set and shard of URLs.

    A run's URLs are dealt to shards and its sets to blocks; one task meets one block with one shard. There, URLs with
    the same frequent tokens are a pattern, scored once per set by the bits it shares; rare tokens lead to their URLs.
    What is shuffled is each URL once per block and each set once per shard, never a pair that is not returned.
    """
    sets = _profiles(q_tokens, [run, "qset"])
    pages = _profiles(u_tokens, [run, "upos"]).join(keyed.select(run, "upos", _order_key()).distinct(), [run, "upos"])
    n_shards = F.ceil(F.col("n_pages") / URLS_PER_SHARD)
    n_blocks = F.least(F.ceil(F.col("n_sets") / LEAST_SETS), F.greatest(F.lit(BLOCKS), F.ceil(F.col("n_sets") / SETS_PER_BLOCK)))
    n_sets = q_tokens.groupBy(run).agg(F.count_distinct("qset").alias("n_sets"))
    n_pages = u_tokens.groupBy(run).agg(F.count_distinct("upos").alias("n_pages"))
    grid = checkpointed(n_sets.join(n_pages, run).select(run, n_shards.cast("int").alias("n_shards"), n_blocks.cast("int").alias("n_blocks")))
    n_cells = grid.agg(F.sum(F.col("n_shards") * F.col("n_blocks"))).first()[0] or 1
    n_tasks = min(n_cells, MOST_TASKS)
    # the cells of a run follow one another, so that they are dealt to different tasks
    cell = F.pmod(F.xxhash64(run) + F.col("shard") * F.col("n_blocks") + F.col("block"), F.lit(n_tasks)).cast("int").alias("task")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_pages = pages.join(grid, run).withColumn("shard", F.pmod(F.xxhash64("upos"), F.col("n_shards")).cast("int")).withColumn("block", numbers("n_blocks"))
    dealt_sets = sets.join(grid, run).withColumn("block", F.pmod(F.xxhash64("qset"), F.col("n_blocks")).cast("int")).withColumn("shard", numbers("n_shards"))
    columns = lambda kind, number, size: (cell, run, "shard", "block", F.lit(kind).alias("kind"), F.col(number).cast("bigint").alias("number"), size.cast("bigint").alias("ukey"), "mask", "rare")
    rows = dealt_pages.select(*columns(0, "upos", F.col("ukey"))).unionByName(dealt_sets.select(*columns(1, "qset", F.lit(0))))
    dealt = rows.repartitionById(n_tasks, "task").sortWithinPartitions(run, "shard", "block", "kind", "ukey", "number").drop("task")
    schema = T.StructType([dealt.schema[run], *(T.StructField(n, T.LongType()) for n in ("qset", "upos", "ukey", "part"))])

    def work(batches):
        cell, held, shard = None, [], None
        for batch in cells_of(batches):
            key, kind = tuple(batch.column(i)[0].as_py() for i in range(3)), batch.column(3)[0].as_py()
            if key != cell:
                cell, held, shard = key, [], None
            numbers, ukeys, masks = (batch.column(i).to_numpy() for i in (4, 5, 6))
            masks, lists = masks.view(np.uint64), batch.column(7)
            if kind == 0:
                held.append((numbers, ukeys, masks, lists.flatten().to_numpy(), lists.value_lengths().to_numpy()))
                continue
            if shard is None and held:
                upos, ukey, u_masks, rare, sizes = map(np.concatenate, zip(*held))
                shard, held = _Shard(u_masks, rare, np.repeat(np.arange(len(upos)), sizes)), []
            if shard is None:
                continue
            ends = np.cumsum(lists.value_lengths().to_numpy())
            rare = np.split(lists.flatten().to_numpy(), ends[:-1])
            found = [shard.best(m, r, k) for m, r in zip(masks, rare)]
            at, scores = (np.concatenate(x).astype(np.int64) for x in zip(*found))
            times = [len(u) for u, _ in found]
            yield pa.RecordBatch.from_pydict({
                run: pa.array([key[0]] * len(at), batch.schema.field(0).type), "qset": np.repeat(numbers, times), "upos": upos[at],
                "ukey": ukey[at], "part": scores})

    return dealt.mapInArrow(work, schema)


def cells_of(batches):
    """Batches cut where run, shard, block or kind changes; rows come sorted by them."""
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield batch.slice(start, i - start)
                start = i


def map_queries(queries: DataFrame, urls: DataFrame, k: int = 3, run: str = "run_id", frequent: int | None = None) -> DataFrame:
    """Best ``k`` URLs per query: score desc, shorter URL, earlier position; ranks 1..k.

    ``queries``: run_id, pos, query_id, query[, topic, recommended_page_type];
    ``urls``: run_id, pos, url — pos unique per run. Queries matching nothing get the k
    shortest URLs of their run with score 0. Exact without storing pairs, see ``candidate_pairs``;
    ``frequent`` moves words between bit patterns and postings and changes no result.
    """
    # queries with the same tokens are mapped once
    asked = query_tokens(queries, run).groupBy(run, "qpos").agg(F.array_sort(F.collect_set("token")).alias("tokens")).withColumn("qset", F.xxhash64("tokens"))
    sets = asked.groupBy(run, "qset").agg(F.first("tokens").alias("tokens"))
    keyed = urls.select(run, F.col("pos").alias("upos"), "url", F.length("url").alias("ulen"))
    q_tokens, u_tokens, shift = _told_apart(sets, urls, run, frequent)
    pairs = candidate_pairs(q_tokens, u_tokens, keyed, k, run)
    # read several times, and at most k rows per set
    found = keyed.withColumn("ukey", _order_key()).join(pairs, [run, "upos", "ukey"]).select(run, "qset", "upos", "url", "ulen", "part")
    ranked = checkpointed(first_n(found, [run, "qset"], [F.desc("part"), "ulen", "upos"], k).drop("rank"))

    # sets that share fewer than k URLs on telling tokens are filled with the shortest of the rest, as all URLs share
    # the tokens of every URL; without such tokens only queries that match nothing are filled
    shortest = first_n(keyed, run, ["ulen", "upos"], 2 * k, rank="at")
    have = ranked.groupBy(run, "qset").agg(F.count("*").alias("have"), F.collect_list("upos").alias("taken"))
    wanted = F.when(F.col("shift").isNotNull(), k).when(F.col("have").isNull(), 1).otherwise(0)
    open_sets = sets.select(run, "qset").join(shift, [run, "qset"], "left").join(have, [run, "qset"], "left").where(F.coalesce("have", F.lit(0)) < wanted)
    fill = open_sets.join(shortest, run).where(F.col("taken").isNull() | ~F.array_contains("taken", F.col("upos"))).select(
        run, "qset", "upos", "url", "ulen", F.lit(0).cast("bigint").alias("part")
    )
    chosen = first_n(ranked.unionByName(fill), [run, "qset"], [F.desc("part"), "ulen", "upos"], k)
    chosen = chosen.join(shift, [run, "qset"], "left").withColumn("score", F.col("part") + F.coalesce("shift", F.lit(0)))
    named = queries.select(run, F.col("pos").alias("qpos"), "query_id", "query").join(asked.select(run, "qpos", "qset"), [run, "qpos"], "left")
    blank = first_n(keyed, run, ["ulen", "upos"], k)
    matched = named.where("qset IS NOT NULL").join(chosen, [run, "qset"]).select(run, "query_id", "query", "qpos", "rank", "url", "upos", "score")
    unasked = named.where("qset IS NULL").join(blank, run).select(run, "query_id", "query", "qpos", "rank", "url", "upos", F.lit(0).cast("bigint").alias("score"))
    return matched.unionByName(unasked).select(
        run, "query_id", "query", "qpos", "rank", "url", "upos",
        F.col("score").alias("mapping_score"), F.lit(REASON).alias("mapping_reason"),
    )


def selected_urls(mappings: DataFrame, n: int | None = None, run: str = "run_id") -> DataFrame:
    """Distinct mapped URLs in mapping order, ranked; with ``n`` the first ``n`` per run."""
    first = mappings.groupBy(run, "url").agg(F.min(F.struct("qpos", "rank")).alias("first_seen"))
    placed = first.select("*", F.col("first_seen.qpos").alias("_qpos"), F.col("first_seen.rank").alias("_at"))
    return first_or_all(placed, run, ["_qpos", "_at"], n).drop("_qpos", "_at")


def mapping_rollup(mappings: DataFrame, queries: DataFrame, run: str = "run_id", seeds: int | None = None) -> DataFrame:
    """Per mapped URL: queries, best score, first topic and the related queries; with ``seeds`` the first so many."""
    topics = queries.select(run, "query_id", *[c for c in ("topic",) if c in queries.columns])
    joined = mappings.join(topics, [run, "query_id"], "left")
    if "topic" not in joined.columns:
        joined = joined.withColumn("topic", F.lit(None).cast("string"))
    order = F.struct("qpos", "rank")
    topic = F.nullif("topic", F.lit(""))
    totals = joined.groupBy(run, "url").agg(
        F.count("*").alias("query_count"),
        F.max("mapping_score").alias("mapping_score"),
        F.min_by(topic, F.when(topic.isNotNull(), order)).alias("brand_topic_category"),
    )
    seed_rows = joined.select(run, "url", "query", "qpos", "rank")
    if seeds is not None:
        seed_rows = first_n(seed_rows, [run, "url"], ["qpos", "rank"], seeds, rank="_n")
    seed_lists = seed_rows.groupBy(run, "url").agg(
        F.array_sort(F.collect_list(F.struct("qpos", "rank", "query"))).alias("_seeds")
    ).select(run, "url", F.transform("_seeds", lambda s: s["query"]).alias("related_queries_seed"))
    return totals.join(seed_lists, [run, "url"]).withColumn("mapping_quality", F.lit("candidate"))
