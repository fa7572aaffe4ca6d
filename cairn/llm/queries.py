"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from cairn.llm.centroids import OP13_SQL, op13_centroids
from cairn.llm.chat_format import OP4_SQL, op4_chat_format
from cairn.llm.decontaminate import OP3_SQL, op3_decontaminate
from cairn.llm.language_id import op7_language_id
from cairn.llm.license_scan import op5_license_scan
from cairn.llm.minhash import OP11_SQL, op11_minhash
from cairn.llm.mixing import op9_mixing
from cairn.llm.ngram_join import OP2_SQL, op2_ngram_jaccard
from cairn.llm.periodic_runs import op12_periodic_runs
from cairn.llm.pii import OP10_SQL, op10_pii
from cairn.llm.quality_classifier import op8_quality_classifier
from cairn.llm.quality_rules import OP1_SQL, op1_quality_rules
from cairn.llm.token_counts import op6_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_ngram_jaccard, op3_decontaminate, op4_chat_format, op5_license_scan,
        op6_token_counts, op7_language_id, op8_quality_classifier, op9_mixing, op10_pii, op11_minhash, op12_periodic_runs, op13_centroids,
    )
}
ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL,
    "op2_ngram_jaccard": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op10_pii": OP10_SQL,
    "op11_minhash": OP11_SQL,
    "op13_centroids": OP13_SQL,
}
