"""One query for each operator, with the parameters of the contract, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm import ann, audit, chat, decontaminate, langid, mixing, resample, secrets, sharding, simhash, substrings, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.assign_shards(docs, "doc_id", sharding.shard_names())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(_crc() % 4 == 2, F.lit(False))
    learned = docs.where(~held_out).select("text", "lang")
    model = langid.train(learned)
    texts = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.predict(texts, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.turns_from_rows(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    turns = rows.unionByName(chat.turns_from_json(extra, "record", "conv_id"))
    read = chat.with_loss(chat.format_turns(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_crc() % 5 != 0)
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    texts = docs.select("doc_id", F.coalesce(_crc() % 5 == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(texts, model).select("doc_id", "held_out", "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", *decontaminate.ADDED)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs).select("doc_id", *tokens.ADDED)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "mix_source", "n_tokens", F.round("mix_weight", 9).alias("mix_weight"), "mix_block", "mix_repeats")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, _table(spark, sf_dir, "benchmark").select("text"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.find_secrets(docs)
    digest = F.sha2(secrets.written_spans("base_spans"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest.alias("base_sha256"), secrets.written_spans("spans").alias("spans"), "n_live", "n_copied")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = audit.with_labels(audit.failures(docs), _table(spark, sf_dir, "labels"), {"good": "quality", "toxic": "toxic"})
    out = audit.audit(rows, {c: c for c in "ABCDE"}, "source", "doc_id", {"good_lost": "good", "toxic_lost": "toxic"})
    return out.withColumnRenamed("source", "part")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_chat_format, op4_toxicity, op5_simhash, op6_ann, op7_decontamination, op8_token_counts, op9_suffix_dedup, op10_mixing, op11_resampling, op12_secret_scan, op13_filter_audit)}
