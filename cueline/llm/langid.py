"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, counted
on all training texts. A word's likelihood is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words. The language
with the highest likelihood is predicted; the score is its posterior probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.common import append_columns, chunks, materialise
from cueline.llm.tokens import tokenizer_path

UNDETERMINED = "und"
#: Runs of more letters than this are scored one by one, by the same sum.
LONG_WORD = 64
CACHE_WORDS = 300_000
SMOOTHING = 0.1
MARK = "▁"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def _words(text: str) -> list[str]:
    """Runs of letters with their combining marks, lower-cased, whatever their length."""
    return _LETTERS(text.lower())


def usable_pieces(model) -> list[tuple[str, int]]:
    """(piece, number) of the vocabulary's pieces that lower-cased words can hold."""
    pieces = ((model.id_to_piece(i), i) for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)))
    return [(p, i) for p, i in pieces if p == p.lower() and MARK not in p[1:]]


def piece_counts(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None) -> DataFrame:
    """(lang, piece, n): how often the vocabulary's tokenizer uses each piece, by language, over all rows.

    Distinct words of a batch are segmented once. Rows with null text or lang don't count.
    """
    path = vocabulary or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        total: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}

        def flush() -> None:
            for name, words in seen.items():
                counts = total.setdefault(name, np.zeros(size, np.int64))
                todo = list(words)
                for i in range(0, len(todo), 20_000):
                    part = todo[i : i + 20_000]
                    ids = model.encode(part, num_threads=1)
                    n = np.repeat([words[w] for w in part], [len(x) for x in ids])
                    counts += np.bincount([p for x in ids for p in x], weights=n, minlength=size).astype(np.int64)
            seen.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, texts in chunks(batch.column(1)):
                for name, t in zip(langs[start:], texts, strict=False):
                    seen.setdefault(name, Counter()).update(_words(t))
                if sum(map(len, seen.values())) > CACHE_WORDS:
                    flush()
        flush()
        for name, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["lang", "piece", "n"])

    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_TABLE_BITS = 20


def _slots(hashes: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """Tables of piece numbers by hash, as many as the fullest slot has pieces."""
    slot = ((hashes[own] * _SPREAD) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, own = slot[order], own[order]
    nth = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
    tables = [np.zeros(1 << _TABLE_BITS, np.int32) for _ in range(int(nth.max(initial=0)) + 1)]
    for i, table in enumerate(tables):
        table[slot[nth == i]] = own[nth == i]
    return tables


class Model:
    """Piece probabilities of each language and the forward algorithm over them."""

    def __init__(self, langs: list[str], counts: np.ndarray, path: str) -> None:
        import sentencepiece

        self.langs = langs
        self.path = path
        own = [i for _, i in usable_pieces(sentencepiece.SentencePieceProcessor(model_file=path))]
        # pieces that no word can hold get no share
        smooth = np.zeros(counts.shape)
        smooth[:, own] = counts[:, own] + SMOOTHING
        self.prob = (smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float64).copy() if len(langs) else np.zeros((0, 0))

    @classmethod
    def of(cls, langs: list[str], prob: np.ndarray, path: str) -> Model:
        """With piece tables, built where they are used: the vocabulary's file is the same everywhere."""
        import sentencepiece

        self = cls.__new__(cls)
        self.langs, self.prob, self.path = langs, prob, path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = usable_pieces(model)
        self.longest = max(len(p) for p, _ in pieces)
        self.hashes = np.zeros(model.vocab_size() + 1, np.uint64)
        for p, i in pieces:
            h = 0
            for c in p:
                h = (h * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.hashes[i + 1] = h
        own = np.array([i + 1 for _, i in pieces], np.int32)
        self.slots = _slots(self.hashes, own)
        if not np.array_equal(self._find(self.hashes[own]), own):
            raise ValueError("pieces of the vocabulary have the same hash")
        if langs:
            # row 0: no piece; for single characters the floor of what isn't in the vocabulary
            self.padded = np.vstack([np.zeros((1, len(langs))), prob])
            self.single = np.vstack([prob[own - 1].min(axis=0, keepdims=True) / 10, prob])
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs)))
        return self

    def _forward(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language, summed over all segmentations.

        Words of equal length go together; pieces are found by a rolling hash of each
        stretch, and a stretch that is no piece has probability zero. A single character
        outside the vocabulary has a floor probability.
        """
        out = np.zeros((len(words), len(self.langs)))
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._forward_long(w)
            else:
                by_len.setdefault(len(w) + 1, []).append(i)
        for n, own in by_len.items():
            marked = "".join([MARK + words[i] for i in own]).encode("utf-32-le", "surrogatepass")
            chars = np.ascontiguousarray(np.frombuffer(marked, np.uint32).reshape(-1, n).T).astype(np.uint64)
            alpha = np.zeros((n + 1, len(own), len(self.langs)))
            alpha[0] = 1.0
            scale = np.zeros((len(own), 1))
            for begin in range(n):
                h = np.zeros(len(own), np.uint64)
                for end in range(begin + 1, min(n, begin + self.longest) + 1):
                    h = h * _STEP + chars[end - 1] + np.uint64(1)
                    ids = self._find(h)
                    if end - begin == 1:
                        alpha[end] += alpha[begin] * self.single[ids]
                        continue
                    has = np.flatnonzero(ids)
                    if len(has) > len(own) // 3:
                        alpha[end] += alpha[begin] * self.padded[ids]
                    elif len(has):
                        alpha[end][has] += alpha[begin][has] * self.padded[ids[has]]
                if begin % 16 == 15:
                    # rescale, so that long words don't underflow
                    top = alpha[begin + 1].max(axis=1, keepdims=True)
                    alpha[begin + 1 : begin + 1 + self.longest] /= top
                    scale += np.log(top)
            out[own] = np.log(np.maximum(alpha[n], 1e-300)) + scale
        return out

    def _forward_long(self, word: str) -> np.ndarray:
        """The same sum for one word, with memory for a stretch of it: pieces are looked up a stretch at a time."""
        chars = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        wide, n = self.longest, len(chars)
        # row j: the sum over segmentations that end j + 1 characters before
        before = np.zeros((wide, len(self.langs)))
        before[0] = 1.0
        scale = np.zeros(len(self.langs))
        for low in range(0, n, 4096):
            ends = np.arange(low + 1, min(n, low + 4096) + 1)
            # pieces by their end and length: column j has those of j + 1 characters
            ids = np.zeros((len(ends), wide), np.int32)
            for size in range(1, wide + 1):
                fits = ends >= size
                h = np.zeros(int(fits.sum()), np.uint64)
                for j in range(size, 0, -1):
                    h = h * _STEP + chars[ends[fits] - j] + np.uint64(1)
                ids[fits, size - 1] = self._find(h)
            for row, end in zip(ids, ends.tolist(), strict=True):
                share = self.padded[row]
                share[0] = self.single[row[0]]
                new = np.einsum("jl,jl->l", before, share)
                before[1:] = before[:-1]
                before[0] = new
                if end % 16 == 0:
                    top = np.maximum(before.max(axis=0), 1e-300)
                    before /= top
                    scale += np.log(top)
        return np.log(np.maximum(before[0], 1e-300)) + scale

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece number plus one of each hash, 0 if it is none."""
        slot = (h * _SPREAD) >> np.uint64(64 - _TABLE_BITS)
        ids = self.slots[0][slot]
        ids *= self.hashes[ids] == h
        hit = None
        for table in self.slots[1:]:
            # a slot that is empty here is empty in the tables after this one
            other = table[slot if hit is None else slot[hit]]
            full = np.flatnonzero(other)
            if not len(full):
                break
            hit, other = full if hit is None else hit[full], other[full]
            same = self.hashes[other] == h[hit]
            ids[hit[same]] = other[same]
        return ids

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        split = [_words(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.table = self.table[:0]
        every = list(chain.from_iterable(split))
        new = [w for w in set(every) if w not in self.cache]
        if new:
            rows = self._forward(new)
            self.cache.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, rows])
        place = np.fromiter(map(self.cache.__getitem__, every), np.int64, len(every))
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.table[place], axis=0)])
        ends = np.cumsum([len(ws) for ws in split])
        for ws, end in zip(split, ends.tolist(), strict=True):
            if not ws:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = sums[end] - sums[end - len(ws)]
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
        return langs, scores


def train(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None) -> Model:
    """Fit on all rows. The model has a number for each language and piece, about 256 kB a language."""
    path = vocabulary or tokenizer_path()
    import sentencepiece

    size = sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    counts = materialise(piece_counts(docs, text, lang, path), "piece-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    table = np.zeros((len(langs), size), np.int64)
    place = {x: i for i, x in enumerate(langs)}
    for r in counts.toLocalIterator():
        table[place[r.lang], r.piece] = r.n
    return Model(langs, table, path)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append lang_pred and score (0 to 1) to every row of ``docs``.

    Null texts and texts without letters, and any text if nothing was learned, are ``und``
    with score 0. Input columns named like the added ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prob, model.path))

    def make():
        own = Model.of(*shared.value)

        def each(column: pa.Array) -> list[pa.Array]:
            langs: list[str] = []
            scores: list[float] = []
            for _, part in chunks(column, 1 << 19):
                a, b = own.score(part)
                langs += a
                scores += b
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return each

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(docs, text, fields, make)
