"""The subpackage's queries, for __spark_entry__.py."""

from __future__ import annotations

from orrery.llm import byte_pairs, chats, fingerprints, jaccard, licenses, lines, mixing, packing, phrases, pii, quality, repair, shards

QUERIES = {
    "op1_jaccard": jaccard.op1_jaccard,
    "op2_packing": packing.op2_packing,
    "op3_chat_format": chats.op3_chat_format,
    "op4_personal_data": pii.op4_personal_data,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_byte_bpe": byte_pairs.op7_byte_bpe,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_sharding": shards.op10_sharding,
    "op11_collocations": phrases.op11_collocations,
    "op12_mixing": mixing.op12_mixing,
    "op13_repair": repair.op13_repair,
}

ORACLE_SQL = {"op8_line_dedup": lines.OP8_SQL, "op9_license_scan": licenses.OP9_SQL, "op11_collocations": phrases.OP11_SQL, "op12_mixing": mixing.OP12_SQL}
