"""Registered queries of the operators: thin digests of their real outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import bpe, chat, filter_audit, imatch, lexical_search, mixing, ngram_join, pii, quality, simhash, substring_dedup, toxicity, warc
from stockflow.llm.common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Place of the public byte-level tokenizer of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    both = bpe.decode(ids, path, keep=["doc_id", "ids"], out_col="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), found_col="kinds")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_values"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    back = chat.read_chats(chat.format_chats(turns.unionByName(planted)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), out_dir)
    back = warc.read_warc(spark, out_dir, with_payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain, keep=["doc_id"])
    toxic = toxicity.is_in(chain, "toxic")
    return scored.select("doc_id", "p_low_quality", "p_toxic", toxic.alias("toxic"), (~toxic).alias("kept"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.cascade(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ngram_join.JoinSpec(k=4, percent=85)
    docs = _table(spark, sf_dir, "documents")
    return ngram_join.component_ids(ngram_join.count_links(docs, spec, ngram_join.ngram_join(docs, spec)))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_with_edits(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4, bits=4)
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_entropy_mix": op2_entropy_mix,
    "op3_feistel_pii": op3_feistel_pii,
    "op4_chat_format": op4_chat_format,
    "op5_warc": op5_warc,
    "op6_toxicity_chain": op6_toxicity_chain,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_ngram_join": op9_ngram_join,
    "op10_imatch": op10_imatch,
    "op11_filter_audit": op11_filter_audit,
    "op12_lexical_search": op12_lexical_search,
    "op13_simhash": op13_simhash,
}
