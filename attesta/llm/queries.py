"""The operators over the tables, under fixed production parameters.

``QUERIES`` maps a name to ``f(spark, sf_dir)``; ``ORACLES`` holds DuckDB SQL where SQL can say the
same over whole tables in fair time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, decontaminate, embeddings, infill, licenses, lines, packing, quality, simhash, spans, toxicity, tries, urls
from .common import table


def op1_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op2_benchmark_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(documents, min_lines=2).select("doc_id", "n_lines", "n_removed", "text")


def op4_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def _fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def _scored(scored, modulus: int, held: int):
    return scored.select("doc_id", F.coalesce(_fold(modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality_classifier(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(quality.score(documents, quality.train(documents, labels.where(_fold(3) != 1))), 3, 1)


def op10_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(toxicity.score(documents, toxicity.learn(documents, labels.where(_fold(5) != 0))), 5, 0)


def op7_substring_dedup(spark, sf_dir):
    return spans.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_sentences", "first_doc_id")


def op8_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return out.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op11_conversation_trie(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return tries.prefix_trie(tries.share_heads(tries.sequences(conversations), block=100, modulus=6))


def op12_bpe_round_trip(spark, sf_dir):
    coded = bpe.encode(table(spark, sf_dir, "documents"))
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op13_fill_in_middle(spark, sf_dir):
    cut = infill.transform(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50, units="lines")
    back = infill.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES: dict[str, str] = {"op1_url_filters": urls.ORACLE, "op3_line_dedup": lines.ORACLE, "op11_conversation_trie": tries.ORACLE, "op13_fill_in_middle": infill.ORACLE}
