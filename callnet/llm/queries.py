"""Queries of this subpackage and their SQL."""

from callnet.llm import chunk_dedup, decontaminate, imatch, license_scan, line_dedup, near_dup, packing, secret_scan, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_gear_chunk_dedup": chunk_dedup.query,
    "op3_string_tiling_decontamination": decontaminate.query,
    "op4_best_fit_packing": packing.query,
    "op5_hyperminhash_near_dup": near_dup.query,
    "op6_warc_bundles": warc.query,
    "op7_toxicity_cnn": toxicity.query,
    "op8_winnowed_license_scan": license_scan.query,
    "op9_imatch_fingerprints": imatch.query,
    "op10_trigram_secret_scan": secret_scan.query,
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op5_hyperminhash_near_dup": near_dup.ORACLE,
    "op6_warc_bundles": warc.ORACLE,
    "op10_trigram_secret_scan": secret_scan.ORACLE,
}
