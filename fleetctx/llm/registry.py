"""The opN_ queries and those of their results that DuckDB SQL can give."""

from . import decontam, langid, linededup, mixing, pii, quality, sharding, simhash, substring, tokens

QUERIES = {
    "op1_bootstrap": pii.op1_bootstrap,
    "op2_simhash": simhash.op2_simhash,
    "op3_inverted_index": decontam.op3_inverted_index,
    "op4_cuckoo": linededup.op4_cuckoo,
    "op5_suffix": substring.op5_suffix,
    "op6_rendezvous": sharding.op6_rendezvous,
    "op7_orc": tokens.op7_orc,
    "op8_hierarchical": mixing.op8_hierarchical,
    "op9_kneser_ney": langid.op9_kneser_ney,
    "op10_line_rules": quality.op10_line_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op3_inverted_index": decontam.op3_sql(),
    "op4_cuckoo": linededup.op4_sql(),
    "op8_hierarchical": mixing.op8_sql(),
    "op10_line_rules": quality.op10_sql(),
}
