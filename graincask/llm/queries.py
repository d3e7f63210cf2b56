"""Queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from graincask.llm import decontam, linededup, ngramjoin, packing, quality, secrets, sharding, substrings, toxicity, warc

QUERIES = {
    "op1_retrieval_packing": packing.op1,
    "op2_warc_index": warc.op2,
    "op3_line_dedup": linededup.op3,
    "op4_quality_rules": quality.op4,
    "op5_vector_sharding": sharding.op5,
    "op6_secret_scan": secrets.op6,
    "op7_ngram_join": ngramjoin.op7,
    "op8_pu_toxicity": toxicity.op8,
    "op9_fm_decontamination": decontam.op9,
    "op10_substring_dedup": substrings.op10,
}
ORACLES = {
    "op2_warc_index": warc.SQL_OP2,
    "op3_line_dedup": linededup.SQL_OP3,
    "op4_quality_rules": quality.SQL_OP4,
    "op6_secret_scan": secrets.SQL_OP6,
    "op7_ngram_join": ngramjoin.SQL_OP7,
    "op9_fm_decontamination": decontam.SQL_OP9,
    "op10_substring_dedup": substrings.SQL_OP10,
}
