"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bitplanes, chat, chunks, importance, infill, languages, licences, mixing, packing, quality, simhash, suffixes, url_lists

QUERIES = {
    "op1_licences": licences.query,
    "op2_bitplanes": bitplanes.query,
    "op3_url_lists": url_lists.query,
    "op4_quality": quality.query,
    "op5_simhash": simhash.query,
    "op6_suffixes": suffixes.query,
    "op7_mixing": mixing.query,
    "op8_chat": chat.query,
    "op9_packing": packing.query,
    "op10_chunks": chunks.query,
    "op11_languages": languages.query,
    "op12_importance": importance.query,
    "op13_infill": infill.query,
}
SQL = {
    "op1_licences": licences.SQL,
    "op3_url_lists": url_lists.SQL,
    "op4_quality": quality.SQL,
    "op8_chat": chat.SQL,
    "op13_infill": infill.SQL,
}
