"""Each registered query over the whole small tables."""

import pytest

from lumiset.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op2_posting_ann": "query_id rank vec_id score",
    "op3_bin_slack_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_ppm_language": "doc_id held_out lang_pred score",
    "op5_weak_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_progressive_jpeg": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op7_cnn_toxicity": "doc_id held_out score predicted",
    "op8_tensored_minhash": "doc_id n_shingles component_id kept",
    "op9_license_dice": "doc_id license n_matches dice",
    "op10_chained_substrings": "doc_id start end source_id source_start source_end n_same",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_orchard_codes": "vec_id code error label_error codebooks_sha256",
    "op13_digest_merge": "doc_id keep_id group_size kept text_sha256",
}
BY_DOCUMENT = {"op1_byte_bpe", "op4_ppm_language", "op5_weak_pii", "op6_progressive_jpeg", "op7_cnn_toxicity", "op8_tensored_minhash", "op13_digest_merge"}


@pytest.mark.parametrize("name", list(registry.MODULES))
def test_query(spark, name):
    rows = registry.module(name).query(spark, DATA)
    assert set(COLUMNS[name].split()) <= set(rows.columns)
    n = rows.count()
    assert n == spark.read.parquet(f"{DATA}/documents.parquet").count() if name in BY_DOCUMENT else n > 0
