"""The thin ``opN_`` queries: each operator on its whole table, returning digest columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from forgeframe.llm import language_id, license_scan, matroska, mixing, ngram_trie, oracles, sentencepiece_bpe, sharding, simhash, url_filter, vector_graph
from forgeframe.llm._common import Scratch, crc_mod


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op2_sharding(spark, sf_dir):
    found = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mixing(spark, sf_dir):
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), docs.filter(crc_mod("doc_id", 5) != 0))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_embedding_dedup(spark, sf_dir):
    found = vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op6_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", crc_mod("doc_id", 7) == 2)
    shape = ngram_trie.train_words(docs.filter("not held_out"))
    numbered = Scratch(spark, "op6").table(ngram_trie.number(docs, shape, keep=["doc_id", "held_out"]), "numbered", "zstd")
    shape = ngram_trie.train_grams(numbered.filter("not held_out"), shape)
    found = ngram_trie.score_numbered(numbered, shape)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(shape["tokens"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_simhash(spark, sf_dir):
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_license_scan(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, own = F.col("base.label"), F.col("matches.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        "score",
    )


def op9_matroska(spark, sf_dir):
    return matroska.digest(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark, sf_dir):
    import public_tokenizers

    return sentencepiece_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_sharding, op3_mixing, op4_language_id, op5_embedding_dedup, op6_lm_score, op7_simhash, op8_license_scan, op9_matroska, op10_sentencepiece)}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
