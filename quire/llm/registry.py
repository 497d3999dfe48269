"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from quire.llm import bpe, embedding_dedup, jaccard_join, language_id, packing, quality_classifier, quality_rules, secrets, sharding, warc


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.round_trip(_read(spark, sf_dir, "documents"), bpe.vocabulary(spark))


def op2_quality_classifier(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return quality_classifier.judged(docs, quality_classifier.train(docs, _read(spark, sf_dir, "labels")))


def op3_quality_rules(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.train(docs, _read(spark, sf_dir, "labels")))


def op4_sharding(spark, sf_dir):
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.groups(_read(spark, sf_dir, "documents"))


def op6_secret_scans(spark, sf_dir):
    return secrets.scanned(_read(spark, sf_dir, "documents"), secrets.scanner())


def op7_warc(spark, sf_dir):
    return warc.normalised_pages(_read(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op8_jittered_copies(spark, sf_dir):
    return embedding_dedup.near_duplicates(embedding_dedup.jittered(_read(spark, sf_dir, "embeddings")))


def op9_packing(spark, sf_dir):
    return packing.packed(_read(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return language_id.labelled(docs, language_id.train(docs))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_secret_scans": op6_secret_scans,
    "op7_warc": op7_warc,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op8_jittered_copies": op8_jittered_copies,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
}
SQL = {
    "op4_sharding": sharding.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_warc": warc.SQL,
    "op8_embedding_dedup": embedding_dedup.SQL,
    "op8_jittered_copies": embedding_dedup.JITTERED_SQL,
}
