"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, license_scan, mixing, near_duplicates, quality_classifier, quality_rules, secret_scan, sharding, token_files, warc_derivatives

QUERIES = {
    "op1_near_duplicates": near_duplicates.op1_near_duplicates,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_files": token_files.op4_token_files,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_warc_derivatives": warc_derivatives.op6_warc_derivatives,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_sharding": sharding.op9_sharding,
    "op10_decontamination": decontamination.op10_decontamination,
}
SQL = {
    "op1_near_duplicates": near_duplicates.OP1_SQL,
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op6_warc_derivatives": warc_derivatives.OP6_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
}
