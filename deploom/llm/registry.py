"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, embedding_dedup, exact_dedup, hard_negatives, metric_tree, packing, periodic_runs, quality, sharding, simhash, suffix_dedup, url_filter, warc_archive

QUERIES = {
    "op1_temporal_url_filter": url_filter.op1_temporal_url_filter,
    "op2_quality_gam": quality.op2_quality_gam,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_bm25_packing": packing.op4_bm25_packing,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_warc_archive": warc_archive.op6_warc_archive,
    "op7_word_bpe": bpe.op7_word_bpe,
    "op8_itq_near_dedup": embedding_dedup.op8_itq_near_dedup,
    "op9_jump_sharding": sharding.op9_jump_sharding,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_mtree_top_k": metric_tree.op13_mtree_top_k,
}

ORACLE_SQL = {
    "op1_temporal_url_filter": url_filter.ORACLE,
    "op3_simhash_near_dedup": simhash.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op6_warc_archive": warc_archive.ORACLE,
    "op8_itq_near_dedup": embedding_dedup.ORACLE,
    "op9_jump_sharding": sharding.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_mtree_top_k": metric_tree.ORACLE,
}
