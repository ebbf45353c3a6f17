"""The registered query of each operator, with its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kith.llm import chat, fm_index, html_extract, jaccard, lexical, manifest, mixing, multi_index, pii, quality, records, sentencepiece, sharding
from kith.llm.common import documents
from kith.llm.oracles import chat_sql, decontamination_sql, manifest_sql, mixing_sql, quality_sql, search_sql, sharding_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query(chat_sql())
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = documents(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text"))
        for i, role in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    return chat.digest(chat.read_back(chat.windows(turns.unionByName(more))))


@query(quality_sql())
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.verdicts(documents(spark, folder), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(mixing_sql())
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


@query()
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text (a literal space mark comes back as a space)."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece.encode(documents(spark, folder).select("doc_id", "text"), model, keep_text=True)
    given = F.translate(F.coalesce("text", F.lit("")), sentencepiece.SPACE, " ").alias("given")
    back = sentencepiece.decode(coded.select("doc_id", "ids", given), model, text="decoded", keep_ids=True)
    return back.select("doc_id", F.size("ids").alias("n_ids"), "ids", (F.col("decoded") == F.col("given")).alias("round_trip"))


@query()
def op10_token_records(spark: SparkSession, folder: str) -> DataFrame:
    opts = records.RecordOptions(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    _, index = records.store(documents(spark, folder).select("doc_id", "text"), opts)
    return records.read_index(spark, index).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(documents(spark, folder).select("doc_id", "text"))


@query()
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.spans(documents(spark, folder), ["doc_id"]))


@query()
def op4_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = documents(spark, folder, "pages").select("page_id", "url", "html")
    texts = html_extract.extract(pages, html_extract.fit(pages))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query()
def op8_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = documents(spark, folder, "embeddings").select("vec_id", "embedding")
    return multi_index.search(vectors, vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding")


@query(sharding_sql(sharding.ShardOptions().limit))
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(documents(spark, folder))


@query(search_sql())
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    index = lexical.build(documents(spark, folder))
    return lexical.search(index, documents(spark, folder, "benchmark"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(manifest_sql())
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents, and what a copy of them with some texts changed folds to."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest.verify(manifest.manifest(documents(spark, folder), F.when(chosen, F.translate("text", UPPER, LOWER))))


@query(decontamination_sql())
def op13_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = fm_index.search(fm_index.build(documents(spark, folder)), documents(spark, folder, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
