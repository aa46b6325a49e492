"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.llm import exact_dedup, fill_in_middle, fingerprints, html_extraction, jaccard_join, mixing, mixture_packing, packing, prefix_trie, suffix_dedup, token_counts, toxicity, url_reputation
from quarrystone.llm.common import table


def op1(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2(spark, sf_dir):
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "spans")


def op5(spark, sf_dir):
    return url_reputation.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6(spark, sf_dir):
    return html_extraction.extract_text(table(spark, sf_dir, "pages"))


def op7(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op11(spark, sf_dir):
    return prefix_trie.trie_digests(table(spark, sf_dir, "conversations"))


def op12(spark, sf_dir):
    packed = mixture_packing.pack_mixture(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op13(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1,
    "op2_canonical_digest": op2,
    "op3_exact_dedup": op3,
    "op4_suffix_array_dedup": op4,
    "op5_url_reputation": op5,
    "op6_site_templates": op6,
    "op7_fair_mixing": op7,
    "op8_jaccard_components": op8,
    "op9_noisy_channel_toxicity": op9,
    "op10_best_fit_packing": op10,
    "op11_prefix_trie": op11,
    "op12_mixture_packing": op12,
    "op13_fill_in_middle": op13,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_url_reputation": url_reputation.ORACLE,
    "op7_fair_mixing": mixing.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
