"""Queries of this package by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, exact, langid, licenses, mixing, phrases, pii, quality, quotes, repair, simhash, substrings
from .oracles import ORACLES

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_license_scan": licenses.op2_license_scan,
    "licence_tree": licenses.licence_tree,
    "op3_nearest": ann.op3_nearest,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_language_id": langid.op6_language_id,
    "op7_simhash": simhash.op7_simhash,
    "op8_pii": pii.op8_pii,
    "op9_chat_quotes": quotes.op9_chat_quotes,
    "chat_quotes_linked": quotes.chat_quotes_linked,
    "op10_repeated_substrings": substrings.op10_repeated_substrings,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_exact_dedup": exact.op12_exact_dedup,
    "op13_collocations": phrases.op13_collocations,
}
