"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

import importlib

#: name: module with query(spark, sf_dir), and ORACLE_SQL where SQL can express it
MODULES = {
    "op1_byte_bpe": "byte_bpe",
    "op2_posting_ann": "posting_ann",
    "op3_bin_slack_packing": "packing",
    "op4_ppm_language": "ppm_language",
    "op5_weak_pii": "weak_pii",
    "op6_progressive_jpeg": "progressive_jpeg",
    "op7_cnn_toxicity": "cnn_toxicity",
    "op8_tensored_minhash": "tensored_minhash",
    "op9_license_dice": "license_dice",
    "op10_chained_substrings": "chained_substrings",
    "op11_spelling_variants": "spelling_variants",
    "op12_orchard_codes": "orchard_codes",
    "op13_digest_merge": "digest_merge",
}


def module(name: str):
    """The module of a query. It is imported here and not before, so that one that cannot be imported stops no other."""
    return importlib.import_module(f"{__package__}.{MODULES[name]}")
