"""Toxicity classifier with counterfactual regularisation.

A logistic model over word and word-prefix features. Every labelled text that names a
group is compared with itself with the name swapped for each other name of its kind; the
loss adds the squared change of the score under the swap. So a name that only happens to
occur in toxic examples gets no weight of its own, and neutral mentions aren't flagged.

Names are a table by language and kind. Where a language or a made-up vocabulary has no
names that the table knows, the training rows offer stand-ins: words that both classes use
about alike, in kinds of neighbouring frequency, which a label can't depend on either.

Features are chosen in Spark by their association with the label among a bounded sample
of labelled rows; the sample's bound doesn't grow with the data. Swaps are counted in
Spark by what they change, of which there are as many as pairs of names, not of rows.
Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.common import append_columns, chunks, materialise

#: Labelled rows of each class that are fitted at most.
SAMPLE_PER_CLASS = 4000
FEATURES = 1500
#: Chi-square from which a feature counts as associated (one chance in a thousand), whatever the sample's size.
ASSOCIATED = 10.83
PREFIX = 5
PENALTY = 5.0
L2 = 1e-3
ROUNDS = 400
#: Parts of the sample, each of which is scored by a fit to the others to place the threshold.
FOLDS = 3
CACHE_WORDS = 300_000
#: Names of groups by language and kind; a name is swapped within its kind.
IDENTITY_TERMS = {
    "en": (
        ("women", "men", "girls", "boys"),
        ("woman", "man", "girl", "boy"),
        ("gay", "straight", "lesbian", "bisexual", "transgender"),
        ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
        ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
        ("black", "white", "asian", "latino", "african", "european"),
        ("immigrant", "native", "refugee", "citizen"),
        ("deaf", "blind", "disabled", "old", "young"),
    ),
    "de": (("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "hindus"), ("schwule", "lesben", "heterosexuelle"), ("ausländer", "einheimische", "flüchtlinge")),
    "fr": (("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous"), ("gays", "lesbiennes", "hétérosexuels"), ("immigrés", "réfugiés", "citoyens")),
    "es": (("mujeres", "hombres", "niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes"), ("gais", "lesbianas", "heterosexuales"), ("inmigrantes", "refugiados", "ciudadanos")),
}
#: Stand-ins: so many words at most, in kinds of KIND; each in a SUPPORT of the rows of either class, with shares within ALIKE.
STAND_INS = 160
KIND = 4
SUPPORT = 0.02
ALIKE = 2.0
_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None, prefix: int = PREFIX) -> set[str]:
    """Distinct words of a text and their prefixes, which are marked by an asterisk."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:prefix] + "*" for w in words if len(w) > prefix}


def kinds_of(terms=None) -> tuple[tuple[str, ...], ...]:
    """Kinds of names of all languages."""
    return tuple(kind for kinds in (IDENTITY_TERMS if terms is None else terms).values() for kind in kinds)


def swaps(words: set[str], kinds, prefix: int = PREFIX) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
    """What a text's features lose and gain when each name in turn is swapped for each other of its kind.

    A feature that other words of the text have too isn't lost, and one that's there isn't gained.
    """
    both = lambda t: (t, t[:prefix] + "*") if len(t) > prefix else (t,)
    shared = Counter(w[:prefix] for w in words if len(w) > prefix and not w.endswith("*"))
    for kind in kinds:
        for old in kind:
            if old in words:
                lost = tuple(f for f in both(old) if f == old or shared[old[:prefix]] == 1)
                for new in kind:
                    if new != old:
                        fresh = both(new)
                        yield tuple(f for f in lost if f not in fresh), tuple(f for f in fresh if f not in words)


class Model:
    def __init__(self, weights: dict[str, float], bias: float, prefix: int = PREFIX) -> None:
        self.weights, self.bias, self.prefix = weights, bias, prefix
        self.pairs = 0
        self.cache: dict[str, tuple[float, str]] = {}

    def score(self, text: str | None) -> float:
        total, prefixes = self.bias, set()
        cache, weights, k = self.cache, self.weights, self.prefix
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(_WORD.findall(text.lower())) if text else ():
            known = cache.get(w)
            if known is None:
                short = w[:k] + "*" if len(w) > k else ""
                known = cache[w] = (weights.get(w, 0.0), short if short in weights else "")
            total += known[0]
            if known[1]:
                prefixes.add(known[1])
        total += sum(weights[p] for p in prefixes)
        return 1 / (1 + float(np.exp(-np.clip(total, -500, 500))))


def sample_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, the same ones in every run, with their texts: (y, words).

    Of several texts of an id the one with the least list of words is taken.
    """
    k = F.col("k")
    marked = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").distinct()
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        own = marked.where(F.col("y") == y)
        # twice the rows wanted are let through by their hash, then the least hashes are taken: a bounded top list
        share = (2 * per_class + 1000) / max(1, counts.get(y, 0))
        if share < 1:
            own = own.where(F.pmod(F.xxhash64(k, F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
        own = own.orderBy(F.pmod(F.xxhash64(k, F.lit(1)), F.lit(1 << 30)), k).limit(per_class)
        chosen = own if chosen is None else chosen.unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(features_of(t)) for _, part in chunks(batch.column(2)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["k", "y", "words"])

    # at most 2 x per_class ids: a bounded broadcast
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).join(F.broadcast(chosen), "k").select(F.xxhash64("k").alias("k"), "y", "t")
    return texts.mapInArrow(run, "k bigint, y int, words array<string>").groupBy("k", "y").agg(F.min("words").alias("words")).drop("k")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(f, a, b): rows of the sample with a feature, and toxic ones of them; features of one row don't count."""
    return sample.select("y", F.explode("words").alias("f")).groupBy("f").agg(F.count("*").cast("double").alias("a"), F.sum("y").cast("double").alias("b")).where("a >= 2")


def choose_features(counts: DataFrame, docs: int, toxic: int, n: int = FEATURES) -> list[str]:
    """The features with a chi-square of ``ASSOCIATED`` against the label, the highest ``n`` of them, in two rows at least.

    The rule is the same for every size of sample. ``counts``: see :func:`feature_counts`.
    """
    if not docs:
        return []
    expected = F.col("a") * toxic / docs
    spread = expected * (1 - toxic / docs) * (1 - F.col("a") / docs) + 1e-9
    top = counts.withColumn("chi", F.pow(F.col("b") - expected, F.lit(2)) / spread).where(F.col("chi") >= ASSOCIATED).orderBy(F.desc("chi"), "f").limit(n)
    return sorted(r.f for r in top.select("f").collect())


def stand_ins(counts: DataFrame, docs: int, toxic: int, n: int = STAND_INS, kind: int = KIND) -> tuple[tuple[str, ...], ...]:
    """Kinds of words that no label depends on, found in the sample.

    A word counts if a share of SUPPORT of the rows of either class has it and the two shares
    differ by a factor of ALIKE at most. The ``n`` most frequent ones are put in order of
    frequency (ties by the word), and each ``kind`` of them in turn make a kind.
    """
    if not 0 < toxic < docs:
        return ()
    bad, good = F.col("b") / toxic, (F.col("a") - F.col("b")) / (docs - toxic)
    alike = (F.least(bad, good) >= SUPPORT) & (F.greatest(bad, good) <= ALIKE * F.least(bad, good))
    top = counts.where(~F.col("f").endswith("*")).where(alike).orderBy(F.desc("a"), "f").limit(n)
    found = [r.f for r in top.collect()]
    return tuple(tuple(found[i : i + kind]) for i in range(0, len(found) // kind * kind, kind))


def swap_counts(sample: DataFrame, kinds, prefix: int = PREFIX) -> list[tuple[tuple[str, ...], tuple[str, ...], int]]:
    """(lost, gained, n): what the swaps of the sample change, and how many do. It grows with pairs of names, not with rows."""
    kinds = tuple(map(tuple, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for words in batch.column(0).to_pylist():
                found.update(swaps(set(words), kinds, prefix))
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([list(a) for a, _ in found], strings), pa.array([list(b) for _, b in found], strings), pa.array(list(found.values()), pa.int64())], names=["lost", "gained", "n"])

    rows = sample.select("words").mapInArrow(run, "lost array<string>, gained array<string>, n bigint")
    summed = rows.groupBy("lost", "gained").agg(F.sum("n").alias("n")).collect()
    return sorted((tuple(r.lost), tuple(r.gained), r.n) for r in summed)


def fit(rows: list[tuple[int, list[str]]], features: list[str], pairs=(), penalty: float = PENALTY, rounds: int = ROUNDS, cost: float = 1.0, l2: float = L2, folds: int = FOLDS) -> Model:
    """Full-batch Adam on the log loss, the swap penalty and an L2 term. ``pairs``: see :func:`swap_counts`.

    Empty texts, one for every hundred rows, are added as rows that aren't toxic. A score of 0.5
    is where rows that a fit hasn't seen are parted with the fewest errors, those on clean rows
    counting ``cost`` times: so often are there clean rows for one in the sample, to one toxic row.
    """
    if not rows or not features:
        return Model({}, -5.0)
    # a text without words isn't toxic: one row in a hundred says so
    rows = [*rows, *[(0, [])] * -(-len(rows) // 100)]
    place = {f: i for i, f in enumerate(features)}
    y = np.array([r[0] for r in rows], np.float32)
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (_, words) in enumerate(rows):
        x[i, [place[f] for f in words if f in place]] = 1
    change = np.zeros((len(pairs), len(features)), np.float32)
    for i, (lost, gained, _) in enumerate(pairs):
        change[i, [place[f] for f in lost if f in place]] += 1
        change[i, [place[f] for f in gained if f in place]] -= 1
    often = np.array([n for *_, n in pairs], np.float64)
    # the mean squared change is a quadratic form of the weights
    curve = (change.T @ (change * (often / often.sum())[:, None])).astype(np.float32) if len(pairs) else None
    w, b = _weights(x, y, curve, penalty, rounds, l2)
    # where to part the classes is told by rows that the weights haven't seen
    unseen = np.zeros(len(y))
    for k in range(folds):
        own = np.arange(len(y)) % folds == k
        if own.any() and not own.all():
            v, c = _weights(x[~own], y[~own], curve, penalty, rounds, l2)
            unseen[own] = x[own] @ v + c
    b -= _cut(unseen, y, cost)
    model = Model({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-4}, float(b))
    model.pairs = int(often.sum())
    return model


def _weights(x: np.ndarray, y: np.ndarray, curve: np.ndarray | None, penalty: float, rounds: int, l2: float = L2) -> tuple[np.ndarray, np.float32]:
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = (p - y) / len(y)
        g = x.T @ d + l2 * w
        if curve is not None:
            g += penalty * 2 * (curve @ w)
        grad = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _cut(logits: np.ndarray, y: np.ndarray, cost: float = 1.0) -> float:
    """Where to part rows with the fewest errors, clean ones counting ``cost`` times: the middle of the widest such gap."""
    order = np.argsort(logits, kind="stable")
    z, t = logits[order].astype(np.float64), y[order]
    if not 0 < t.sum() < len(t):
        return 0.0
    # errors of a cut after the first i + 1 rows: toxic ones below it, others above it
    errors = np.cumsum(t, dtype=np.float64)[:-1] + cost * (len(t) - t.sum() - np.cumsum(1 - t, dtype=np.float64)[:-1])
    gaps = np.where(np.isclose(errors, errors[z[1:] > z[:-1]].min(initial=np.inf)), z[1:] - z[:-1], -1.0)
    i = int(gaps.argmax())
    return float((z[i] + z[i + 1]) / 2) if gaps[i] > 0 else 0.0


def prepare(sample: DataFrame, features: int = FEATURES, terms=None) -> tuple[list[tuple[int, list[str]]], list[str], list]:
    """(rows, features, swaps) that :func:`fit` takes, from a sample (y, words); all empty if no feature is associated with the label."""
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    counts = materialise(feature_counts(sample), "feature-counts")
    named = kinds_of(terms)
    kinds = (*named, *stand_ins(counts.where(~F.col("f").isin([t for kind in named for t in kind])), totals.n, totals.t))
    chosen = set(choose_features(counts, totals.n, totals.t, features))
    if not chosen:
        return [], [], []
    chosen = sorted(chosen | {t for kind in kinds for t in kind})
    return _rows(sample, chosen), chosen, swap_counts(sample, kinds)


def _rows(sample: DataFrame, chosen: list[str]) -> list[tuple[int, list[str]]]:
    """Rows of the bounded sample with those of their words that are chosen."""
    wanted = sample.select("y", F.array_intersect("words", F.array(*map(F.lit, chosen))).alias("w"))
    return sorted((r.y, r.w) for r in wanted.toLocalIterator())


def share_cost(labels: DataFrame, label: str, rows: list[tuple[int, list[str]]]) -> float:
    """How many clean labelled rows there are for one in the sample, to one toxic row; at least 1."""
    toxic = sum(y for y, _ in rows)
    every = labels.agg(*[F.count(F.when(F.col(f"`{label}`") == y, 1)).alias(f"y{y}") for y in (0, 1)]).first()
    return max(1.0, every.y0 / max(1, len(rows) - toxic) * max(1, toxic) / max(1, every.y1))


def nested_errors(sample: DataFrame, settings: list[dict], cost: float = 1.0, outer: int = 5, features: int = FEATURES, terms=None) -> list[tuple[int, int]]:
    """(toxic rows missed, clean rows rejected) under each of ``settings`` (arguments of :func:`fit`), by nested folds of a sample.

    The sample is parted by its words into ``outer`` parts, and each is scored by fits to the
    others that choose features, stand-ins and threshold without it. So settings can be
    chosen from training rows alone.
    """
    part = F.pmod(F.xxhash64("words"), F.lit(outer))
    errors = np.zeros((len(settings), 2), np.int64)
    for k in range(outer):
        rows, chosen, pairs = prepare(sample.where(part != k), features, terms)
        unseen = _rows(sample.where(part == k), chosen) if chosen else []
        for i, setting in enumerate(settings if rows else []):
            model = fit(rows, chosen, pairs, **({"cost": cost} | setting))
            for y, words in unseen:
                toxic = model.bias + sum(model.weights.get(w, 0.0) for w in words) >= 0
                errors[i] += (y == 1 and not toxic, y == 0 and toxic)
    return [tuple(map(int, e)) for e in errors]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, features: int = FEATURES, penalty: float = PENALTY, terms=None, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``per_class`` labelled ids of each class.

    ``terms``: names by language and kind, IDENTITY_TERMS if None; stand-ins of the rows are
    added to them. Null keys and labels other than 0 and 1 are left out; without labelled rows
    every text gets the same low score. ``pairs`` of the model is the number of swaps.
    """
    sample = materialise(sample_labelled(docs, labels, key, text, label, per_class), "labelled-sample")
    rows, chosen, pairs = prepare(sample, features, terms)
    if not rows:
        return Model({}, -5.0)
    cost = share_cost(labels, label, rows)
    return fit(rows, chosen, pairs, penalty, rounds, cost)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= 0.5) to every row of ``docs``.

    Null and empty texts get the score of a text without features: that of the model's bias.
    Input columns named like the added ones are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.prefix))

    def make():
        own = Model(*shared.value)

        def each(column: pa.Array) -> list[pa.Array]:
            found = np.array([own.score(t) for _, part in chunks(column) for t in part], np.float64)
            return [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]

        return each

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return append_columns(docs, text, fields, make)
