"""What filters remove together, in every order, from sorted posting lists.

Rows of a part are numbered in order of id, a range of ids at a time. Each filter has the
sorted list of the numbers that fail it, and each label the list of those that have it. The
union of every set of filters is merged from the lists: the shorter list gallops through the
longer one, by binary search from where the last one was found. What a filter removes after
others is the size of a difference of two unions, so sizes are all that leaves a range; they
are summed over the ranges of a part, and the orders are read off the sums.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import materialise, private

#: Rows of a range of ids at most.
RANGE = 1 << 16
#: Filters at most: their orders are all reported.
MOST_FILTERS = 6
WORD = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sorted lists."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short):
        return long
    at = np.searchsorted(long, short)
    lacks = long[np.minimum(at, len(long) - 1)] != short
    return np.insert(long, at[lacks], short[lacks])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted lists."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short):
        return 0
    return int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())


def union_sizes(fails: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """Sizes of the unions of all sets of ``fails``, by set as bits, then of what each of ``labels`` has in common with them."""
    unions = [np.zeros(0, np.int64)]
    for s in range(1, 1 << len(fails)):
        last = s.bit_length() - 1
        unions.append(merge(unions[s ^ (1 << last)], fails[last]))
    return np.array([[len(u) for u in unions], *[[common(u, own) for u in unions] for own in labels]], np.int64)


def part_sizes(rows: DataFrame, part: str, key: str, fails: list[str], labels: list[str]) -> DataFrame:
    """(part, n, sizes): documents of each part, and for the filters and each label an array of sizes by set of filters.

    Rows stay where they are: ranges of ids are those of a partition, and sizes of any ranges
    add up, so no part and no id has to meet in one task.
    """
    n, kinds = 1 << len(fails), 1 + len(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, count, held, size = None, np.zeros((kinds, n), np.int64), 0, [], 0

        def close() -> None:
            nonlocal total, count, held, size
            if size:
                flags = np.concatenate(held, axis=1)
                lists = [np.flatnonzero(f) for f in flags]
                total = total + union_sizes(lists[: len(fails)], lists[len(fails) :])
                count, held, size = count + size, [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], pa.string()), pa.array([count], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=[part, "n", "sizes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            place = names.indices.to_numpy(zero_copy_only=False)
            flags = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
            for a, z in zip(cuts, cuts[1:]):
                name = names.dictionary[int(place[a])].as_py()
                if name != own:
                    close()
                    if own is not None:
                        yield told()
                    own, total, count = name, np.zeros((kinds, n), np.int64), 0
                while a < z:
                    upto = min(z, a + RANGE - size)
                    held.append(flags[:, a:upto])
                    size += upto - a
                    a = upto
                    if size == RANGE:
                        close()
        close()
        if own is not None:
            yield told()

    flags = [F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)).alias(f"f{i}") for i, c in enumerate([*fails, *labels])]
    sorted_ = rows.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("p"), F.col(f"`{key}`").alias("k"), *flags).sortWithinPartitions("p", "k")
    found = sorted_.drop("k").mapInArrow(run, f"`{part}` string, n bigint, sizes array<bigint>")
    sums = found.groupBy(part).agg(F.sum("n").alias("n"), *[F.sum(F.get("sizes", F.lit(i))).alias(f"s{i}") for i in range(kinds * n)])
    arrays = F.array(*[F.array(*[F.col(f"s{k * n + i}") for i in range(n)]) for k in range(kinds)])
    return sums.select(part, "n", arrays.alias("sizes"))


def _orders(letters: str) -> Column:
    """All orders, step by step, with the sets of filters before and after each step: constants."""
    rows = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            rows.append({"o": "".join(order), "s": step, "b": before, "a": before | bit, "f": letters.index(letter)})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<o:string,s:int,b:int,a:int,f:int>>")


def audit(rows: DataFrame, fails: dict[str, str], part: str, key: str, labels: dict[str, str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, one column a label, shapley).

    ``rows``: part, key, boolean columns of what fails and of the labels; null is false, and a
    null part the empty text. ``fails``: column of each filter's letter; ``labels``: column of
    each output name, counted among what a step removes. Documents that repeat a key, or have
    none, count each. Every order of the filters is told for every part; no rows, no parts.
    """
    letters = "".join(fails)
    if not 1 <= len(letters) <= MOST_FILTERS or len(letters) != len(fails):
        raise ValueError(f"one to {MOST_FILTERS} filters, each of one letter")
    n = 1 << len(letters)
    sizes = part_sizes(rows, part, key, list(fails.values()), list(labels.values()))
    of = lambda kind, i: F.get(F.get("sizes", F.lit(kind)), F.lit(i) if isinstance(i, int) else i)
    shares = []
    for i in range(len(letters)):
        others = [s for s in range(n) if not s >> i & 1]
        weight = {s: factorial(s.bit_count()) * factorial(len(letters) - 1 - s.bit_count()) for s in others}
        shares.append(sum(((of(0, s | 1 << i) - of(0, s)) * weight[s] for s in others), F.lit(0)))
    wide = sizes.withColumns({"__each": F.array(*shares), "__own": F.array(*[of(0, 1 << i) for i in range(len(letters))]), "__unique": F.array(*[of(0, n - 1) - of(0, n - 1 ^ 1 << i) for i in range(len(letters))])})
    long = wide.withColumn("x", F.explode(_orders(letters)))
    removed = of(0, F.col("x.a")) - of(0, F.col("x.b"))
    lost = [(of(k, F.col("x.a")) - of(k, F.col("x.b"))).alias(name) for k, name in enumerate(labels, 1)]
    by = lambda c: F.get(c, F.col("x.f"))
    return long.select(
        part, F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), (F.col("n") - of(0, F.col("x.a"))).alias("kept"), removed.alias("removed"),
        (by("__own") - removed).alias("redundant"), by("__unique").alias("unique_fails"), *lost, by("__each").alias("shapley"),
    )


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text has too few words, too few distinct ones, too many capitals, or marks; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, WORD), "")
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    few = lambda w: 100 * F.size(F.array_distinct(w)).cast("bigint") < LEAST_DISTINCT * F.size(w).cast("bigint")
    # words are split once
    told = F.transform(F.array(words), lambda w: F.struct((F.size(w) < LEAST_WORDS).alias("few"), few(w).alias("same")))[0]
    return {"words": told, "capitals": 100 * capitals.cast("bigint") > MOST_CAPITALS * F.length(t).cast("bigint"), "marks": t.rlike(MARKS)}


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(key, part, A, B, C, D, E) of every row: what it fails.

    A: under 200 words; B: less than half of them distinct; C: capitals are more than 2 % of its
    code points; D: holds a mark; E: a row with a smaller key has the same text. A null text is
    an empty one. A null key is neither smaller nor larger than others. Only digests of texts
    are compared. Texts that are first are joined by their key, of which there is one for each
    text, so copies needn't meet; rows without a key pass by the join.
    """
    own = private(docs)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    told = text_failures(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{part}`").alias(part), told["words"].alias(own), told["capitals"].alias("C"), told["marks"].alias("D"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"))
    rows = materialise(rows.select(key, part, F.col(f"{own}.few").alias("A"), F.col(f"{own}.same").alias("B"), "C", "D", "digest"), "failures")
    named = rows.where(F.col(key).isNotNull())
    # the text that a key is first to have; a key that is repeated may be first to have several
    firsts = named.groupBy("digest").agg(F.min(key).alias(key)).withColumn("first", F.lit(True))
    marked = named.join(firsts, [key, "digest"], "left").withColumn("E", F.col("first").isNull())
    without = rows.where(F.col(key).isNull()).withColumn("E", F.lit(False))
    fields = [key, part, "A", "B", "C", "D", "E"]
    return marked.select(*fields).unionByName(without.select(*fields))


def with_labels(rows: DataFrame, labels: DataFrame, columns: dict[str, str], key: str = "doc_id") -> DataFrame:
    """Append boolean columns: whether any label of the key is 1. ``columns``: label column of each name."""
    by_key = labels.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(key)).agg(*[F.max(F.coalesce(F.col(f"`{c}`") == 1, F.lit(False))).alias(name) for name, c in columns.items()])
    named, rest = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    out = named.join(by_key, key, "left").withColumns({name: F.coalesce(name, F.lit(False)) for name in columns})
    return out.unionByName(rest.withColumns({name: F.lit(False) for name in columns}))
