"""Temperature mixing of sources under a token budget.

Shares p of the sources' tokens are raised to an exponent a in [0, 1] and normalised.
a is bisected to meet a target entropy, then, if a source would be repeated more often
than allowed, bisected upwards to meet the repetition limit. Each source then gets
budget x weight tokens: whole passes over its documents, and for the rest its blocks in
a permuted order, the last block cut document by document. All of it is DataFrame code.
Blocks are put in order by two levels, first their groups, then the blocks of the one
group that the rest ends in, so that no window holds all blocks of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.common import materialise, private

STEPS = 60
BLOCK_TOKENS = 1 << 16
ENTROPY_FRACTION = 0.97
MAX_REPEATS = 4.0
NO_SOURCE = "<none>"
#: Hex digits of a block's turn that make its group: at most 4096 groups a source.
GROUP_DIGITS = 3
#: Rows of a table of sources that are broadcast at most; a row has about 200 bytes.
BROADCAST_SOURCES = 50_000
ADDED = ["n_tokens", "mix_source", "mix_weight", "mix_block", "mix_repeats"]


def word_tokens(text: Column) -> Column:
    """Words of a text as the token measure; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _bisect(start: Column, good) -> Column:
    """Exponent at the edge of ``good``, which holds below it: STEPS halvings of ``start``..1."""
    init = F.struct(start.cast("double").alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        ok = good(mid)
        return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), init, step, lambda acc: acc["lo"])


def source_weights(tokens: DataFrame, entropy_fraction: float, max_repeats: float, budget: float | None) -> DataFrame:
    """(mix_source, source_tokens, alpha, mix_weight, budget) from (mix_source, n_tokens).

    ``budget``: tokens of the mixture as a multiple of the corpus; None: the least with
    which no source is cut, so that every document stays. Sources without tokens have
    weight 0. One array of source totals is folded; it grows with the number of sources.
    """
    sums = tokens.groupBy("mix_source").agg(F.sum("n_tokens").cast("double").alias("t"))
    one = sums.where("t > 0").agg(F.sort_array(F.collect_list(F.struct("t", "mix_source"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["t"])
    one = one.select("s", total.alias("total"), F.size("s").alias("n"))
    one = one.withColumn("p", F.transform("s", lambda x: x["t"] / F.col("total")))
    fold = lambda f: F.aggregate("p", F.lit(0.0), lambda a, x: a + f(x))
    entropy = lambda e: F.log(fold(lambda x: F.pow(x, e))) - e * fold(lambda x: F.pow(x, e) * F.log(x)) / fold(lambda x: F.pow(x, e))
    # the smallest share is repeated most: its weight over its share, times the budget
    tail = lambda e: F.pow(F.array_min("p"), e - 1) / fold(lambda x: F.pow(x, e))
    head = lambda e: F.pow(F.array_max("p"), e - 1) / fold(lambda x: F.pow(x, e))
    passes = (lambda e: tail(e) * F.lit(float(budget))) if budget else (lambda e: tail(e) / head(e))
    goal = F.lit(float(entropy_fraction)) * F.log(F.col("n").cast("double"))
    one = one.withColumn("a0", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(_bisect(F.lit(0.0), lambda m: entropy(m) >= goal)))
    one = one.withColumn("a1", F.when(passes(F.col("a0")) <= max_repeats, F.col("a0")).otherwise(_bisect(F.col("a0"), lambda m: passes(m) > max_repeats)))
    one = one.withColumn("alpha", F.round("a1", 9)).withColumn("z", fold(lambda x: F.pow(x, F.col("alpha"))))
    spend = F.lit(float(budget)) if budget else 1 / head(F.col("alpha"))
    one = one.withColumn("budget", F.floor(F.round(F.col("total") * spend, 3)))
    return one.select("alpha", "z", "total", "budget", F.explode("s").alias("x")).select(
        F.col("x.mix_source").alias("mix_source"),
        F.col("x.t").cast("bigint").alias("source_tokens"),
        "alpha",
        (F.pow(F.col("x.t") / F.col("total"), F.col("alpha")) / F.col("z")).alias("mix_weight"),
        "budget",
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    entropy_fraction: float = ENTROPY_FRACTION,
    max_repeats: float = MAX_REPEATS,
    budget: float | None = 1.0,
    block_tokens: int = BLOCK_TOKENS,
    keep_all: bool = False,
    tokens: str | None = None,
) -> DataFrame:
    """Append n_tokens, mix_source, mix_weight, mix_block and mix_repeats to ``docs``.

    mix_repeats says how often a row is used. A null source is a source of its own,
    ``<none>``. ``tokens``: a column with token counts (null: 0); without one, words are
    counted. Rows without tokens cost nothing: they are used once in each whole pass,
    as is every row with ``keep_all``, which rounds a cut pass up. Rows with one key, or none,
    are told apart by a digest of their text; rows alike in both are used equally often. Input columns named like added ones are replaced;
    an empty table stays empty.
    """
    low = {n.lower() for n in ADDED}
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in low]
    own = private(docs)
    # with the text, so that rows without a key, or with one key, are dealt to many blocks
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", name, F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"))).cast("binary"))
    size = F.coalesce(F.col(f"`{tokens}`").cast("bigint"), F.lit(0)) if tokens else word_tokens(F.col(f"`{text}`"))
    body = docs.select(
        *kept,
        size.alias(f"{own}_n"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(NO_SOURCE)).alias(f"{own}_source"),
        digest.alias(f"{own}_hash"),
        # a row's place in its block: other digits of the digest; equal rows have one place
        F.concat_ws(":", F.substring(digest, 13, 20), digest).alias(f"{own}_place"),
    )
    names = {f"{own}_n": "n_tokens", f"{own}_source": "mix_source", f"{own}_hash": "hash", f"{own}_place": "place"}
    slim = materialise(body.select(*[F.col(c).alias(n) for c, n in names.items()]), "mix-rows")
    plan = materialise(_plan(slim, entropy_fraction, max_repeats, budget, block_tokens), "mix-plan")
    # the plan comes in one column of its own
    plan = _sized(plan.select(F.col("mix_source").alias(f"{own}_source"), F.struct("*").alias(f"{own}_plan")))
    out = body.join(plan, f"{own}_source", "left")
    p = lambda name: F.col(f"{own}_plan.{name}")
    block = _block(F.col(f"{own}_hash"), p("n_blocks"))
    turn = _turn(F.col(f"{own}_source"), block)
    part = F.when(F.col(f"{own}_n") == 0, 0).when(turn <= p("last_turn"), 1).when((block == p("edge_block")) & (F.col(f"{own}_place") <= p("last_place")), 1).otherwise(0)
    repeats = F.coalesce(p("whole"), F.lit(1)) + part
    if keep_all:
        repeats = F.greatest(F.lit(1), repeats)
    return out.select(
        *kept,
        F.col(f"{own}_n").alias("n_tokens"),
        F.col(f"{own}_source").alias("mix_source"),
        F.coalesce(p("mix_weight"), F.lit(0.0)).alias("mix_weight"),
        block.alias("mix_block"),
        repeats.cast("bigint").alias("mix_repeats"),
    )


def _block(digest: Column, n_blocks: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % F.coalesce(n_blocks, F.lit(1))


def _turn(source: Column, block: Column) -> Column:
    """Where a block stands in the permutation of its source's blocks."""
    return F.concat_ws(":", F.md5(F.concat_ws(":", source, block.cast("string"))), block.cast("string"))


def _plan(rows: DataFrame, entropy_fraction: float, max_repeats: float, budget: float | None, block_tokens: int) -> DataFrame:
    """What each source may spend: whole passes, the blocks up to ``last_turn``, and of ``edge_block`` the rows up to ``last_place``.

    ``rows``: (mix_source, n_tokens, hash, place).
    """
    weights = source_weights(rows.select("mix_source", "n_tokens"), entropy_fraction, max_repeats, budget)
    weights = weights.withColumn("allowed", F.floor(F.round(F.col("mix_weight") * F.col("budget"), 3)))
    weights = weights.withColumn("whole", F.expr("allowed div source_tokens")).withColumn("rest", F.col("allowed") - F.col("whole") * F.col("source_tokens"))
    weights = weights.withColumn("n_blocks", F.greatest(F.lit(1), F.expr(f"source_tokens div {int(block_tokens)}")))
    weights = _sized(materialise(weights.select("mix_source", "mix_weight", "whole", "rest", "n_blocks"), "mix-weights"))
    placed = rows.join(weights, "mix_source").withColumn("mix_block", _block(F.col("hash"), F.col("n_blocks")))
    blocks = placed.groupBy("mix_source", "mix_block", "rest").agg(F.sum("n_tokens").alias("size"))
    blocks = blocks.withColumn("turn", _turn(F.col("mix_source"), F.col("mix_block"))).withColumn("group", F.substring("turn", 1, GROUP_DIGITS))
    # first the groups of blocks, 4096 a source at most, then the blocks of the group that the rest ends in
    groups = _running(blocks.groupBy("mix_source", "group", "rest").agg(F.sum("size").alias("size")), "group")
    full = F.max(F.when(F.col("upto") <= F.col("rest"), F.col("group")))
    edge = (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    # "~" comes after every digit: all turns of the last full group are up to it
    starts = groups.groupBy("mix_source").agg(F.concat(full, F.lit("~")).alias("full"), F.max(F.when(edge, F.col("group"))).alias("edge"), F.max(F.when(edge, F.col("before"))).alias("start"))
    starts = _sized(materialise(starts, "mix-groups"))
    inner = blocks.join(starts.where("edge IS NOT NULL").select("mix_source", "edge", "start"), "mix_source").where("group = edge")
    inner = _running(inner, "turn").withColumns({"upto": F.col("upto") + F.col("start"), "before": F.col("before") + F.col("start")})
    cuts = inner.groupBy("mix_source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("turn"))).alias("turn"),
        F.max(F.when(edge, F.col("mix_block"))).alias("edge_block"),
        F.max(F.when(edge, F.col("rest") - F.col("before"))).alias("room"),
    )
    cuts = materialise(cuts, "mix-blocks")
    # only the one block of each source that the rest ends in is put in order
    inside = placed.join(_sized(cuts.where("edge_block IS NOT NULL")), "mix_source").where("mix_block = edge_block")
    # rows of one place are one, however many there are
    inside = inside.groupBy("mix_source", "place", "room").agg(F.sum("n_tokens").alias("n_tokens"))
    by_place = Window.partitionBy("mix_source").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    ends = inside.withColumn("d_upto", F.sum("n_tokens").over(by_place)).where("d_upto <= room").groupBy("mix_source").agg(F.max("place").alias("last_place"))
    out = weights.join(starts.select("mix_source", "full"), "mix_source", "left").join(cuts.drop("room"), "mix_source", "left").join(ends, "mix_source", "left")
    return out.select("mix_source", "mix_weight", "whole", "n_blocks", F.greatest("full", "turn").alias("last_turn"), "edge_block", "last_place")


def _running(df: DataFrame, order: str) -> DataFrame:
    """Append upto and before: the running sum of ``size`` of each source, with and without the row."""
    run = Window.partitionBy("mix_source").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("upto", F.sum("size").over(run)).withColumn("before", F.col("upto") - F.col("size"))


def _sized(table: DataFrame) -> DataFrame:
    """A table with a row for each source: broadcast if it is counted to be small, else joined as it is."""
    return F.broadcast(table) if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else table


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mixture itself: every row mix_repeats times, without the added columns."""
    rows = mixed.where("mix_repeats > 0")
    columns = [f"`{c}`" for c in mixed.columns if c not in ADDED]
    own = private(mixed)
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("mix_repeats").cast("int"))).alias(own)).drop(own)
