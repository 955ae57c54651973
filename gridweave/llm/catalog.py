"""Registered queries of this subpackage: thin applications of its operators."""

from __future__ import annotations

from gridweave.llm import adaptive_rules, itq, langid, mixing, ngram_trie, packing, pii, quality_mil, resampling, simhash_ball, token_files, toxicity, vector_code
from gridweave.llm.common import read


def op1_elias_fano_trie(spark, sf_dir):
    return ngram_trie.score_corpus(read(spark, sf_dir, "documents"), order=3, least=1)


def op2_mix_sources(spark, sf_dir):
    return mixing.mixed_taken(read(spark, sf_dir, "documents"))


def op3_token_planes(spark, sf_dir):
    return token_files.read_documents(spark, token_files.write_tokens(read(spark, sf_dir, "documents")))


def op4_pii(spark, sf_dir):
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op5_itq_near_dups(spark, sf_dir):
    return itq.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_quality_mil(spark, sf_dir):
    return quality_mil.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_simhash_ball(spark, sf_dir):
    return simhash_ball.near_duplicates(read(spark, sf_dir, "documents"))


def op8_language_fusion(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "pages"), *langid.learn_text(read(spark, sf_dir, "documents")))


def op9_adaptive_rules(spark, sf_dir):
    return adaptive_rules.apply_rules(read(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op11_importance_resampling(spark, sf_dir):
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_dual_tree_codes(spark, sf_dir):
    return vector_code.vector_codes(read(spark, sf_dir, "embeddings"))


def op13_compression_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_elias_fano_trie, op2_mix_sources, op3_token_planes, op4_pii, op5_itq_near_dups, op6_quality_mil, op7_simhash_ball, op8_language_fusion, op9_adaptive_rules, op10_best_fit_packing, op11_importance_resampling, op12_dual_tree_codes, op13_compression_toxicity, pipeline)}
ORACLE_SQL: dict[str, str] = {"op9_adaptive_rules": adaptive_rules.ORACLE, "op11_importance_resampling": resampling.ORACLE, "op12_dual_tree_codes": vector_code.ORACLE}
