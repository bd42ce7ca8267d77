"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from pitchlake.llm import centroids, divergence, embeddings, html_text, knn, mixing, near_dup, packing, quality, rule_ledger, sharding, substring_dedup, warc

QUERIES = {
    "op1_warc_archives": warc.op1_warc_archives,
    "op2_kd_sharding": sharding.op2_kd_sharding,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_exact_topk": knn.op4_exact_topk,
    "op5_sentence_span_dedup": substring_dedup.op5_sentence_span_dedup,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_embedding_near_dedup": embeddings.op7_embedding_near_dedup,
    "op8_minhash_near_dedup": near_dup.op8_minhash_near_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_ptolemaic_clusters": centroids.op11_ptolemaic_clusters,
    "op12_rule_ledger": rule_ledger.op12_rule_ledger,
    "op13_source_divergence": divergence.op13_source_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_warc_archives": warc.OP1_SQL,
    "op4_exact_topk": knn.OP4_SQL,
    "op6_source_mixing": mixing.OP6_SQL,
    "op7_embedding_near_dedup": embeddings.OP7_SQL,
    "op11_ptolemaic_clusters": centroids.OP11_SQL,
    "op12_rule_ledger": rule_ledger.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
