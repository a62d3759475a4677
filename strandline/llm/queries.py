"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import audio, decontam, lloyd, merkle, packing, pii, quality, records, secrets, simhash, substring, toxicity, warc

QUERIES = {
    "op1_simhash_bktree": simhash.op1,
    "op2_pii_disclosure": pii.op2,
    "op3_telephony_audio": audio.op3,
    "op4_warc_archive": warc.op4,
    "op5_decontaminate": decontam.op5,
    "op6_sum_of_squares_packing": packing.op6,
    "op7_secret_ledger": secrets.op7,
    "op8_substring_dedup": substring.op8,
    "op9_quality_bayes": quality.op9,
    "op10_toxicity_ordinal": toxicity.op10,
    "op11_delta_lloyd": lloyd.op11,
    "op12_token_records": records.op12,
    "op13_merkle_manifest": merkle.op13,
}

ORACLE_SQL = {
    "op4_warc_archive": warc.ORACLE4,
    "op7_secret_ledger": secrets.oracle_sql(),
    "op8_substring_dedup": substring.ORACLE8,
    "op11_delta_lloyd": lloyd.oracle_sql(),
    "op13_merkle_manifest": merkle.ORACLE13,
}
