"""Every query and stage over the awkward tables and over empty ones; each case's result as its docstring states."""

import zlib
from collections import Counter

import corpus_pipeline
import pytest

import foldlake.llm as llm

QUERIES = llm.queries()
PER_DOC = [q for q in QUERIES if q.startswith(("op1_", "op2_", "op3_", "op4_", "op7_", "op8_", "op9_"))]


def rows(spark, name, place):
    return QUERIES[name](spark, place).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert rows(spark, name, empty) == []


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


@pytest.mark.parametrize("name", PER_DOC)
def test_a_row_for_each_document(spark, odd, odd_rows, name):
    got = Counter(r.doc_id for r in rows(spark, name, odd))
    assert got == Counter(r[0] for r in odd_rows)


def test_secret_scan(spark, odd):
    r = {x.doc_id: x for x in rows(spark, "op1_secret_scan", odd) if x.doc_id is not None}
    assert (r[10].n_assign, r[10].n_access, r[10].n_hex) == (1, 1, 1)
    assert r[5].spans == "" and r[5].base_sha256 == r[7].base_sha256


def test_tiff_equal_texts_equal_values(spark, odd):
    r = rows(spark, "op2_tiff", odd)
    a, b = (x for x in r if x.doc_id in (0, 1))
    assert a[1:] == b[1:]
    null = next(x for x in r if x.doc_id is None and x.n_bytes == 0)
    empty = next(x for x in r if x.doc_id == 5)
    assert null[1:] == empty[1:] and empty.payload_bytes == 192


def test_mix_orders_each_source(spark, odd):
    r = rows(spark, "op3_pfair_mix", odd)
    assert len({(x.slot, x.pos) for x in r}) == len(r)
    assert {x.source for x in r} == {"a", "b", "c", ""}


def test_spans_of_repeated_rows_agree(spark, odd, odd_rows):
    r = rows(spark, "op4_sentence_spans", odd)
    twice = [x for x in r if x.doc_id == 2 and x.text == odd_rows[2][1]]
    assert len(twice) == 2 and not any(x.n_removed for x in twice)
    zero, one = (next(x for x in r if x.doc_id == k) for k in (0, 1))
    assert zero.n_removed == 0 and one.n_removed > 0
    assert all(x.text == "" for x in r if x.doc_id == 5)


def test_packing_covers_every_id(spark, odd, odd_rows):
    r = rows(spark, "op5_packing", odd)
    assert sum(x.length for x in r) == sum(x.doc_tokens for x in r if x.start == 0)
    assert sum(x.start == 0 for x in r) == len(odd_rows)
    end = zlib.crc32((1).to_bytes(4, "little"))
    assert all((x.length, x.ids_crc32) == (1, end) for x in r if x.doc_id == 5)


def test_pages(spark, odd):
    r = rows(spark, "op6_text_density", odd)
    assert sorted((x.page_id, x.n_chars) for x in r if x.page_id in (0, 2, 3, 4)) == [(0, 3), (0, 3), (2, 0), (3, 4), (4, 14)]
    assert next(x for x in r if x.page_id == 5).text.startswith("T\nword word")
    assert next(x for x in r if x.page_id is None).text == ""


def test_scores(spark, odd):
    r = rows(spark, "op7_neighbour_votes", odd)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in r)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in r if x.doc_id is not None)
    assert not any(x.held_out for x in r if x.doc_id is None)


def test_classes(spark, odd):
    r = rows(spark, "op8_bagminhash", odd)
    assert {x.class_id for x in r if x.doc_id in (0, 1)} == {0}
    assert {x.class_id for x in r if x.doc_id == 6} == {6}
    assert Counter(x.class_id for x in r)[None] == 4  # two null texts, the empty text that equals them, and a text of its own


def test_rules(spark, odd):
    r = {x.doc_id: x for x in rows(spark, "op9_compression_bands", odd)}
    assert r[5].base_failed and not r[5].kept and r[5].n_words == 0
    assert r[0].kept and not r[0].base_failed
    assert r[8].n_words == 1 and not r[8].kept


def test_audit_counts_repeated_records(spark, odd):
    r = rows(spark, "op10_merkle_audit", odd)
    assert sum(x.copies for x in r) == 7 and len(r) == 6


def test_stages(spark, odd, odd_rows):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    names, place = docs.columns, f"{odd}/stage"
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(f"{place}{k}")
        docs = spark.read.parquet(f"{place}{k}")


def test_near_dedup_stage_keeps_one_of_each_class(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, odd).collect())
    assert got[0] == 1 and got[1] == 0 and got[2] == 2 and got[None] == 2


def test_secrets_stage_masks(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    r = {x.doc_id: x for x in corpus_pipeline.secrets(spark, docs, odd).collect()}
    assert "24be64439e" not in r[10].text and "AKIA" not in r[10].text and r[10].n_chars == len(r[10].text)
    assert r[0].n_chars == len(r[0].text)
