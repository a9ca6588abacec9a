"""The queries of the ten operators, and their SQL oracles."""

from __future__ import annotations

from tessera.llm import decontamination, jaccard, licenses, packing, pii, quality, secrets, substrings, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_secret_scans": secrets.query,
    "op3_packing": packing.query,
    "op4_license_scans": licenses.query,
    "op5_substring_dedup": substrings.query,
    "op6_toxicity": toxicity.query,
    "op7_ngram_jaccard_join": jaccard.query,
    "op8_benchmark_decontamination": decontamination.query,
    "op9_warc": warc.query,
    "op10_pii": pii.query,
}
ORACLES = {
    "op2_secret_scans": secrets.ORACLE,
    "op5_substring_dedup": substrings.ORACLE,
    "op7_ngram_jaccard_join": jaccard.ORACLE,
    "op8_benchmark_decontamination": decontamination.ORACLE,
    "op9_warc": warc.ORACLE,
}
