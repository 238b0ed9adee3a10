"""Columns and row counts of the operators' queries over a small folder of tables."""

from pathlib import Path

import pytest

from headway.llm.queries import registered

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not there")

COLUMNS = {
    "op1_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_substring_dedup": "doc_id bigint, text string, lang string, source string, n_chars bigint, removed string, kept string",
    "op3_best_fit_packing": (
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    ),
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_sharding": (
        "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"
    ),
    "op7_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_line_quality": (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
        "base_failed boolean, kept boolean, n_kept_words bigint"
    ),
    "op9_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op10_decontamination": "doc_id bigint, item_id bigint, start int, n_words int, similarity double",
    "op11_prefix_trie": (
        "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string"
    ),
    "op12_spelling_groups": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op13_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_documents(spark, name):
    found = registered()[name](spark, FOLDER)
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == COLUMNS[name]
    if name in ("op11_prefix_trie", "op12_spelling_groups"):  # a row per node, per word
        assert found.count() > 20
        return
    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    got = [r[0] for r in found.select("doc_id").collect()]
    if name == "op10_decontamination":
        assert set(got) <= ids
    else:
        assert set(got) == ids and (len(got) == len(ids) or name == "op3_best_fit_packing")


def test_all_are_registered():
    assert set(registered()) == set(COLUMNS)
