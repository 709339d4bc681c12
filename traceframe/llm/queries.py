"""Queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontaminate, fill_in_middle, fingerprint, jaccard_join, langid, lexical_search, packing, paragraph_dedup,
               piece_codec, pii, token_count, url_filter)
from .common import table, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encode_pieces(table(spark, sf_dir, "documents"))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.assign_windows(written(digests))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), [F.col("doc_id")])
    return found.select("doc_id", "contaminated", F.size("matches").alias("n_items"), F.col("matches.item_id").alias("item_ids"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.with_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                        "near_edited", "near_next")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.train(docs), [F.col("doc_id")])
    base = F.filter("spans", lambda s: s["base"])

    def count(k: int, kind: str):
        return F.size(F.filter(base, lambda s: s["k"] == k)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, range(len(pii.KINDS)), pii.KINDS), F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_calls(chat.from_conversations(table(spark, sf_dir, "conversations")))


ORACLES["op7_chat_formatting"] = chat.CONVERSATIONS_SQL


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("spam_mass")


@query
def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return paragraph_dedup.with_passages(paragraph_dedup.paragraph_repeats(docs), docs).drop("th", "removed")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    net = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, net, [F.col("doc_id"), F.col("held_out")])


@query
def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = piece_codec.encode(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")])
    ids = F.col("ids").cast("array<string>")
    return piece_codec.decode(tokens).select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                                             F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep=[F.col("doc_id")])
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(back, 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = fill_in_middle.QUERY_SQL


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_lexical_search"] = lexical_search.QUERY_SQL


def queries() -> dict:
    import corpus_pipeline
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
