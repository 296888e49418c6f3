"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Items are cut into windows of 13 consecutive words (shorter items are one window). For
containment every shingle of a window is necessary, so one prefix token is enough: the
window's rarest shingle in an order by benchmark frequency. Documents probe the prefix
index with their shingles; a match is a candidate only if the window's position and
length fit into the document, and is then verified word by word.

A benchmark that is counted to be small is indexed once and broadcast. A larger one is
indexed as a table, built in Spark, and joined by equality with the shingles of the
documents in one pass over them; a bitmap of fixed size leaves most shingles in their task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.common import append_columns, chunks, materialise, private, without

WINDOW = 13
SHINGLE = 5
#: Bytes of item texts that are indexed on the driver and broadcast at most.
INDEX_BYTES = 256 << 10
#: Bits of the bitmap over prefix hashes of a larger benchmark: 32 MB, whatever its size.
BITMAP_BITS = 28
#: Windows that are known by one rarest shingle at most; a larger crowd is asked for by the digests of its windows.
CROWD = 16
#: Every byte that isn't a digit, a lower-case letter or part of a longer code point parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BITS = 20
ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _factors(k: int) -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 1 << 63, size=k, dtype=np.uint64) | np.uint64(1)


def _shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word ids from each position on."""
    n = len(ids) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    wide = ids.astype(np.uint64)
    for j, c in enumerate(_factors(k)):
        out += wide[j : j + n] * c
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


class Index:
    """Prefix index over the windows of some items: (item_id, text bytes) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        windows: dict[tuple[int, ...], set[int]] = {}
        for n, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                windows.setdefault(tuple(ids[at : at + size]), set()).add(n)
        keys = list(windows)
        self.owners = [np.array(sorted(windows[k]), np.int64) for k in keys]
        self.classes = []
        for size in sorted({len(k) for k in keys}):
            own = [i for i, k in enumerate(keys) if len(k) == size]
            body = np.array([keys[i] for i in own], np.int64)
            k = min(shingle, size)
            flat = np.stack([_shingles(row, k) for row in body])
            # rarity order: how many windows' shingles of the benchmark are the same, then the hash
            often = Counter(flat.ravel().tolist())
            order = np.array([[often[h] for h in row] for row in flat.tolist()])
            best = np.lexsort((flat, order), axis=-1)[:, 0]
            prefix = flat[np.arange(len(own)), best]
            by = np.argsort(prefix, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[(prefix >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.classes.append((size, k, prefix[by], np.array(own)[by], best[by], body[by], bitmap))

    @classmethod
    def of(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        vars(index).update(state)
        return index

    def match(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(word position, window, size) of the occurrences; starts: where each document begins, and the end."""
        for size, k, prefix, own, offset, body, bitmap in self.classes:
            if len(ids) < size:
                continue
            # only runs of k words that all occur in items can match
            known = ids > 0
            runs = known[: len(ids) - k + 1].copy()
            for j in range(1, k):
                runs &= known[j : len(ids) - k + 1 + j]
            at = np.flatnonzero(runs)
            if not len(at):
                continue
            hashes = np.zeros(len(at), np.uint64)
            for j, c in enumerate(_factors(k)):
                hashes += ids[at + j].astype(np.uint64) * c
            hashes ^= hashes >> np.uint64(29)
            hashes *= np.uint64(0xBF58476D1CE4E5B9)
            hashes ^= hashes >> np.uint64(32)
            hot = bitmap[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]
            at, hashes = at[hot], hashes[hot]
            low, high = np.searchsorted(prefix, hashes, "left"), np.searchsorted(prefix, hashes, "right")
            n = high - low
            at = np.repeat(at, n)
            if not len(at):
                continue
            row = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            begin = at - offset[row]
            doc = np.searchsorted(starts, at, "right") - 1
            fits = (begin >= starts[doc]) & (begin + size <= starts[doc + 1])
            begin, row = begin[fits], row[fits]
            same = (ids[begin[:, None] + np.arange(size)] == body[row]).all(axis=1) if len(begin) else np.zeros(0, bool)
            yield begin[same], own[row[same]], size


def _probe(index: Index, texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, hit runs of words, item ids) of each text."""
    split = [words_of(t) if t else [] for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)
    get = index.vocabulary.get
    ids = np.fromiter(map(get, chain.from_iterable(split), repeat(0)), np.int64, int(starts[-1]))
    edges = np.zeros(len(ids) + 1, np.int64)
    found: dict[int, set[int]] = {}
    for begin, window, size in index.match(ids, starts):
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + size, -1)
        doc = np.searchsorted(starts, begin, "right") - 1
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            found.setdefault(d, set()).update(index.owners[w].tolist())
    hit = np.cumsum(edges)[:-1] > 0
    for d, ws in enumerate(split):
        runs: list[tuple[int, int]] = []
        if d in found:
            mask = np.concatenate(([0], hit[starts[d] : starts[d + 1]].astype(np.int8), [0]))
            turn = np.flatnonzero(np.diff(mask))
            runs = list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))
        yield len(ws), runs, sorted({index.items[i] for i in found.get(d, ())})


def _summary(n: int, runs: list[tuple[int, int]], items: list[str]) -> tuple:
    hit = sum(b - a for a, b in runs)
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n, hit, len(items), digest, hit > 0 and 20 * hit >= n


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, body) of the items that can match anything."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("binary").alias("body"))
    return rows.where("item IS NOT NULL AND body IS NOT NULL")


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Append n_words, n_hit, n_items, items_sha256 and contaminated to every row of ``docs``.

    Null texts have no words and no hits; items without words, null items and null ids
    match nothing; items with the same text are all counted. Input columns named like the
    added ones are replaced; equal rows stay as often as they were; an empty table stays
    empty. ``index_bytes``: bytes of items up to which the index is broadcast, and rows are
    mapped without a shuffle; the result is the same with an index table.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    items = _items(benchmark, item, item_text)
    if (items.agg(F.sum(F.octet_length("body") + F.octet_length("item"))).first()[0] or 0) > index_bytes:
        return _by_table(docs, text, items)
    shared = docs.sparkSession.sparkContext.broadcast(vars(Index([(i, bytes(t)) for i, t in items.distinct().collect()])))

    def make():
        index = Index.of(shared.value)

        def each(column: pa.Array) -> list[pa.Array]:
            rows = [_summary(*x) for _, part in chunks(column) for x in _probe(index, part)]
            return [pa.array(list(c), pa_kind) for c, pa_kind in zip(zip(*rows, strict=True), _KINDS, strict=True)] if rows else [pa.array([], k) for k in _KINDS]

        return each

    return append_columns(docs, text, fields, make, binary=True)


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())


# --- an index table ------------------------------------------------------------------


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _hashed(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; the size is part of it."""
    out = _shingles(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    return out ^ np.uint64(size * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def index_table(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The prefix index (prefix, window, body, size, at, crowd) of distinct windows, and the owners (window, item).

    ``prefix`` is the hash of the window's rarest shingle, ``at`` where in the window that
    shingle stands, ``body`` the window's words, ``window`` their digest, ``crowd`` how many windows have that prefix.
    """
    spread = "item string, window binary, body binary, size int, shingles array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                size = min(window, len(words))
                if not size:
                    continue
                k = min(shingle, size)
                hashes = _hashed(_word_hashes(words), k).view(np.int64)
                n = len(words) - size + 1
                bodies = [b" ".join(words[i : i + size]) for i in range(n)]
                own = [hashes[i : i + size - k + 1].tolist() for i in range(n)]
                arrays = [pa.array([name] * n, pa.string()), pa.array([hashlib.md5(b).digest() for b in bodies], pa.binary()), pa.array(bodies, pa.binary()), pa.array([size] * n, pa.int32()), pa.array(own, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["item", "window", "body", "size", "shingles"])

    windows = materialise(items.distinct().mapInArrow(run, spread), "item-windows")
    owners = materialise(windows.select("window", "item").distinct(), "window-items")
    once = windows.groupBy("window").agg(F.first("body").alias("body"), F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    each = once.select("window", F.posexplode("shingles").alias("at", "prefix"))
    often = each.groupBy("prefix").agg(F.count("*").alias("often"))
    rarest = each.join(often, "prefix").groupBy("window").agg(F.min(F.struct("often", "prefix", "at")).alias("r"))
    rarest = rarest.select("window", "r.prefix", "r.at")
    crowds = rarest.groupBy("prefix").agg(F.count("*").alias("crowd"))
    index = once.join(rarest.join(crowds, "prefix"), "window").select("prefix", "window", "body", "size", "at", "crowd")
    return materialise(index, "window-index"), owners


def _bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """Bits of the prefixes: at most 2^bits / 8 bytes come from each of a few tasks, whatever the index's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(held[used], pa.uint8()).cast(pa.int32())], names=["byte", "bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    found = index.select("prefix").mapInArrow(run, "byte bigint, bits int").groupBy("byte").agg(F.bit_or("bits").alias("bits"))
    for rows in found.mapInArrow(_packed, "at binary, bits binary").toLocalIterator():
        out[np.frombuffer(rows.at, np.int64)] |= np.frombuffer(rows.bits, np.uint8)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int64).tobytes()], pa.binary()), pa.array([bits.astype(np.uint8).tobytes()], pa.binary())], names=["at", "bits"])


def _by_table(docs: DataFrame, text: str, items: DataFrame) -> DataFrame:
    """As :func:`mark_contaminated`, by an equality join of shingles with the index table."""
    index, owners = index_table(items)
    sizes = sorted({min(SHINGLE, r["size"]) for r in index.select("size").distinct().collect()})
    longest = max((r["size"] for r in index.select("size").distinct().collect()), default=1)
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(index, BITMAP_BITS))
    own = private(docs)
    row = F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            names = batch.column(0).to_pylist()
            for start, texts in chunks(batch.column(1)):
                told = []
                for d, body in enumerate(texts):
                    words = words_of(body) if body else []
                    hashes = _word_hashes(words)
                    for k in sizes:
                        h = _hashed(hashes, k)
                        bit = h >> np.uint64(64 - BITMAP_BITS)
                        hit = np.flatnonzero(bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                        for i in hit.tolist():
                            low, high = max(0, i - longest + 1), min(len(words), i + longest)
                            told.append((names[start + d], int(h[i].view(np.int64)), i, i - low, high - low, b" ".join(words[low:high])))
                cols = list(zip(*told, strict=True)) if told else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["row", "prefix", "pos", "off", "n", "around"])

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of the words where a window of a shape would stand."""
        for batch in batches:
            off, around, at, size = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("off", "around", "at", "size"))
            told = [hashlib.md5(b" ".join(a.split()[o - x : o - x + s])).digest() for o, a, x, s in zip(off, around, at, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.binary())], names=[*batch.schema.names, "window"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates whose window has the same words."""
        for batch in batches:
            kept, begins = [], []
            for i, (pos, off, around, body, size, at) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 7)), strict=True)):
                low = off - at
                if b" ".join(around.split()[low : low + size]) == body:
                    kept.append(i)
                    begins.append(pos - at)
            took = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column(0), pa.array(begins, pa.int64()), took.column(5).cast(pa.int32()), took.column(7)], names=["row", "begin", "size", "window"])

    probes = docs.select(row.alias("row"), F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(probe, "row binary, prefix bigint, pos bigint, off bigint, n bigint, around binary")
    # positional and length bounds: the window begins and ends inside the text
    fits = (F.col("off") >= F.col("at")) & (F.col("off") - F.col("at") + F.col("size") <= F.col("n"))
    told = ["row", "pos", "off", "around", "body", "size", "at", "window"]
    few, many = index.where(F.col("crowd") <= CROWD).drop("crowd"), index.where(F.col("crowd") > CROWD).drop("crowd")
    # windows in a crowd around one shingle: a place asks for each of their few shapes, by the digest of its words
    shapes = many.select("prefix", "at", "size").distinct()
    places = probes.join(shapes, "prefix").where(fits)
    places = places.mapInArrow(name_windows, T.StructType([*places.schema.fields, T.StructField("window", T.BinaryType())]))
    pairs = probes.join(few, "prefix").where(fits).select(*told).unionByName(places.join(many, ["window", "prefix", "at", "size"]).select(*told))
    hits = materialise(pairs.mapInArrow(verify, "row binary, begin bigint, size int, window binary").distinct(), "item-hits")
    # words covered: every row's hits are put in order, and what overlaps is counted once
    covered = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("begin", "size"))).alias("runs"))
    init = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).cast("bigint").alias("n"))
    grow = lambda acc, x: F.struct(F.greatest(acc["upto"], x["begin"] + x["size"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), x["begin"] + x["size"] - F.greatest(acc["upto"], x["begin"]))).alias("n"))
    covered = covered.select("row", F.aggregate("runs", init, grow, lambda acc: acc["n"]).alias("hit"))
    named = hits.select("row", "window").distinct().join(owners, "window").select("row", "item").distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = covered.join(named, "row").select(F.col("row").alias(f"{own}_row"), F.struct("hit", F.size("items").cast("bigint").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("digest")).alias(f"{own}_found"))
    kept = [f"`{c}`" for c in without(docs, ADDED).columns]
    n_words = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("bigint")
    rows = docs.select(*kept, row.alias(f"{own}_row"), n_words.alias(f"{own}_n")).join(materialise(found, "marked-rows"), f"{own}_row", "left")
    n, hit = F.col(f"{own}_n"), F.coalesce(F.col(f"{own}_found.hit"), F.lit(0)).cast("bigint")
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        *kept,
        n.alias("n_words"),
        hit.alias("n_hit"),
        F.coalesce(F.col(f"{own}_found.n"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(F.col(f"{own}_found.digest"), F.lit(nothing)).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= n)).alias("contaminated"),
    )
