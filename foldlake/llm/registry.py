"""The queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from . import bagminhash, html_text, mixing, packing, quality, rules, secret_scan, sentence_spans, tiff, warc


def queries():
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_tiff": tiff.op2_tiff,
        "op3_pfair_mix": mixing.op3_pfair_mix,
        "op4_sentence_spans": sentence_spans.op4_sentence_spans,
        "op5_packing": packing.op5_packing,
        "op6_text_density": html_text.op6_text_density,
        "op7_neighbour_votes": quality.op7_neighbour_votes,
        "op8_bagminhash": bagminhash.op8_bagminhash,
        "op9_compression_bands": rules.op9_compression_bands,
        "op10_merkle_audit": warc.op10_merkle_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_pfair_mix": mixing.SQL, "op10_merkle_audit": warc.SQL}
