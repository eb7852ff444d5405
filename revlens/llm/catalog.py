"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from revlens.llm import chat, fingerprint, infill, language, lines, mixing, packing, quality, repeats, simhash, urls, vectors, whitening

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_chat": chat.op2_chat,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_urls": urls.op7_urls,
    "op8_language": language.op8_language,
    "op9_fingerprint": fingerprint.op9_fingerprint,
    "op10_lines": lines.op10_lines,
    "op11_whitening": whitening.op11_whitening,
    "op12_vectors": vectors.op12_vectors,
    "op13_infill": infill.op13_infill,
}

ORACLE_SQL = {
    "op3_mixing": mixing.SQL,
    "op4_quality": quality.SQL,
    "op13_infill": infill.SQL,
}
