"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, html_text, licenses, line_dedup, near_dedup, pii, quality_model, quality_rules, warc
from .oracles import SQL

QUERIES = {
    "op1_near_dedup": near_dedup.op1,
    "op2_bpe": bpe.op2,
    "op3_warc": warc.op3,
    "op4_licenses": licenses.op4,
    "op5_pii": pii.op5,
    "op6_html_text": html_text.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_quality_model": quality_model.op10,
}

ORACLE_SQL = dict(SQL)
