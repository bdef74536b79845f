"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table.  ``ORACLE_SQL`` holds DuckDB SQL where SQL can express it."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relfeat.llm import (chat, decontam, embed_dedup, fill_middle, lexical_search, mixing, near_join, quality, suffix_tree, token_counts, toxicity, urlfilter,
                         warc)
from relfeat.llm.oracle import ORACLE_SQL  # noqa: F401
from relfeat.session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a suffix tree learnt from nine tenths of them."""
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain probabilities of every document; ``toxic`` where the last one reaches 0.5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_chain(docs, toxicity.toxic_labels(labels), toxicity.CATEGORIES)
    scored = toxicity.score_chain(docs.select("doc_id", "text"), model, columns=["doc_id"])
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (document, benchmark item) with five-word shingle containment of 0.8 or more."""
    return decontam.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (cosine 0.98 or more, labels equal), component and whether kept of every vector."""
    return embed_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and P(good grade) of every document; ``keep`` where that reaches 0.5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, quality.label_grades(labels), quality.GRADES)
    scored = quality.score_quality(docs.select("doc_id", "text"), model, columns=["doc_id"], tail=quality.GOOD)
    return scored.withColumn("keep", F.col("tail_probability") >= 0.5)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a WARC archive in the shared folder, read back and reassembled."""
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    pages = warc.page_digests(warc.read_warc(spark, path))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return pages.select(number("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and conversation -1 with control strings, as JSON records of several
    layouts, formatted; the result is read back from the formatted texts."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(chat.records_of_rows(rows.unionByName(extra))))


#: The rules of the contract: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest fitting rule and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of sources takes from every document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and component of every document: five-word shingles, Jaccard 0.8."""
    return near_join.near_join(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and byte-level BPE tokens of every document."""
    import public_tokenizers
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, part lengths and digests of every document's fill-in-the-middle output."""
    return fill_middle.transform_middle(table(spark, sf_dir, "documents"), texts=False)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents of every benchmark item."""
    return lexical_search.search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)
    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {q.__name__: _shipped(q) for q in (op1_suffix_tree, op2_toxicity, op3_decontamination, op4_embeddings, op5_quality, op6_warc, op7_chat, op8_urls, op9_mixing,
                                             op10_near_join, op11_token_counts, op12_fill_middle, op13_lexical_search)}


