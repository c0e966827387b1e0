"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import brown, decontaminate, html, packing, quality, repair, simhash, substrings, transducer, warc

QUERIES = {
    "op1_suffix_dedup": substrings.op1_suffix_dedup,
    "op2_class_bigrams": brown.op2_class_bigrams,
    "op3_repair_tokens": repair.op3_repair_tokens,
    "op4_html_text": html.op4_html_text,
    "op5_host_rules": quality.op5_host_rules,
    "op6_vector_packing": packing.op6_vector_packing,
    "op7_transducer_counts": transducer.op7_transducer_counts,
    "op8_template_decontamination": decontaminate.op8_template_decontamination,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_simhash_balls": simhash.op10_simhash_balls,
}
ORACLES = {
    "op5_host_rules": quality.ORACLE_SQL,
    "op8_template_decontamination": decontaminate.ORACLE_SQL,
    "op9_warc_revisits": warc.ORACLE_SQL,
}
