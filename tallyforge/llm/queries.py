"""The queries of this subpackage and their SQL; __spark_entry__.py adds them."""

from __future__ import annotations

from . import bpe, hnsw, kd_sharding, language_id, packing, quality_classifier, quality_rules, simhash, substring_dedup, warc_fixity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_warc_merkle_fixity": warc_fixity.op3,
    "op4_bpe_segment_tree": bpe.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_language_id": language_id.op7,
    "op8_hnsw_neighbours": hnsw.op8,
    "op9_kd_tree_sharding": kd_sharding.op9,
    "op10_quality_classifier": quality_classifier.op10,
    "language_id_pages": language_id.pages,
    "quality_base": quality_rules.quality_base,
    "shard_law": kd_sharding.shard_law,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op3_warc_merkle_fixity": warc_fixity.OP3_SQL,
    "op8_hnsw_neighbours": hnsw.OP8_SQL,
    "quality_base": quality_rules.QUALITY_BASE_SQL,
    "shard_law": kd_sharding.SHARD_LAW_SQL,
}
