"""The training-data operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from quoin.llm.decontamination import op2_decontamination
from quoin.llm.divergence import OP13_SQL, op13_divergence_audit
from quoin.llm.license_scan import op1_license_scan
from quoin.llm.lm_scoring import op6_lm_scoring
from quoin.llm.media import op8_media_columns
from quoin.llm.packing import op5_best_fit_packing
from quoin.llm.preferences import OP3_SQL, op3_preference_formatting
from quoin.llm.sharding import OP10_SQL, op10_hash_tree_sharding
from quoin.llm.simhash import op4_simhash_near_dedup
from quoin.llm.token_files import op9_token_files
from quoin.llm.toxicity import op7_toxicity
from quoin.llm.upsert import op11_cow_upsert
from quoin.llm.warc import op12_warc

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op3_preference_formatting": op3_preference_formatting,
    "op2_decontamination": op2_decontamination,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_media_columns": op8_media_columns,
    "op9_token_files": op9_token_files,
    "op10_hash_tree_sharding": op10_hash_tree_sharding,
    "op11_cow_upsert": op11_cow_upsert,
    "op12_warc": op12_warc,
    "op13_divergence_audit": op13_divergence_audit,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op3_preference_formatting": OP3_SQL,
    "op10_hash_tree_sharding": OP10_SQL,
    "op13_divergence_audit": OP13_SQL,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
