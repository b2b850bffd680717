"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, embeddings, exact_dedup, filter_audit, langid, linededup, paragraphs, phrases, quality, simhash, suffix, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_warc": warc.op2_warc,
    "op3_paragraphs": paragraphs.op3_paragraphs,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_langid": langid.op6_langid,
    "op7_suffix": suffix.op7_suffix,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_linededup": linededup.op10_linededup,
    "op10_linededup_long": linededup.op10_linededup_long,
    "op11_vectors": embeddings.op11_vectors,
    "op12_phrases": phrases.op12_phrases,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "op4_proximity": decontaminate.op4_proximity,
}
SQL = {
    "op2_warc": warc.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op10_linededup": linededup.SQL,
    "op10_linededup_long": linededup.LONG_SQL,
    "op11_vectors": embeddings.SQL,
    "op12_phrases": phrases.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
