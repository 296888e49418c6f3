"""Token counts with a digest cache.

A text is known by the SHA-256 of its content, and its count is kept under that digest
and the digest of the tokenizer's file. Texts already in the cache are joined to their
counts; only distinct misses are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.common import chunks, materialise, new_path, private, without

TOKENIZER = "piece_bpe_32k.model"
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
ADDED = ["n_bytes", "n_tokens", "over_limit"]
#: Digests of misses that are broadcast at most, to pick their texts; a digest has 32 bytes.
BROADCAST_MISSES = 500_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Null counts as empty; nothing else is normalised, since it could change the count."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def counter(path: str):
    """Function from a list of texts to their token counts, without added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def encode_misses(texts: DataFrame, path: str, version: str) -> DataFrame:
    """(digest, tokenizer, n_tokens) of the texts among (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = [c for _, part in chunks(batch.column(1)) for c in count(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return texts.mapInArrow(run, CACHE_SCHEMA)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Counts of one tokenizer version in the cache; None for a cache that isn't there yet.

    Two writers may append the same digest; such rows are equal and count once.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def missing_texts(texts: DataFrame, known: DataFrame | None) -> DataFrame:
    """(digest, text), once each, of the texts whose digest isn't ``known``. ``texts``: (digest, text).

    Digests are compared before any text moves. Where the misses are counted to be few, they
    are broadcast and texts that the cache has never leave their task. Where they are many,
    texts are made distinct first, so that a text with very many copies leaves a task once.
    """
    if known is None:
        return texts.dropDuplicates(["digest"])
    misses = materialise(texts.select("digest").distinct().join(known, "digest", "left_anti"), "token-misses")
    n = misses.count()
    if not n:
        return texts.limit(0)
    if n <= BROADCAST_MISSES:
        return texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
    return texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str | None = None, cache: str | None = None, limit: int = 4096) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit to every row of ``docs``.

    ``cache``: a Parquet folder that all executors reach, kept between calls; without one
    a new folder in the shared folder is used. A null text counts as an empty one. Input
    columns named like the added ones are replaced; an empty table stays empty.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    version = tokenizer_digest(path)
    cache = cache or new_path(spark, "tokens")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    texts = docs.select(content_digest(F.col(f"`{text}`")).alias("digest"), whole.alias("text"))
    misses = missing_texts(texts, read_cache(spark, cache, version))
    encode_misses(misses, path, version).write.mode("append").parquet(cache)
    # written, so that the join below can split the rows of a text with very many copies
    counts = materialise(read_cache(spark, cache, version), "token-counts")
    own = private(docs)
    rows = docs.withColumns({f"{own}_bytes": F.octet_length(whole).cast("bigint"), f"{own}_digest": content_digest(F.col(f"`{text}`"))})
    kept = [f"`{c}`" for c in without(docs, ADDED).columns]
    counts = counts.select(F.col("digest").alias(f"{own}_digest"), F.col("n_tokens").alias(f"{own}_tokens"))
    tokens = F.col(f"{own}_tokens")
    rows = rows.select(*kept, f"{own}_bytes", f"{own}_digest").join(counts, f"{own}_digest", "left")
    return rows.select(*kept, F.col(f"{own}_bytes").alias("n_bytes"), tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
