"""The queries and SQL of this subpackage."""

from __future__ import annotations

from ..shipping import shipped
from . import ann, chat, exact_dedup, langid, mixing, packing, secrets, simhash, suffix_lm, toxicity

QUERIES = {
    "op1_langid": langid.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_mixing": mixing.query,
    "op4_chat": chat.query,
    "op5_simhash": simhash.query,
    "op6_packing": packing.query,
    "op7_suffix_lm": suffix_lm.query,
    "op8_ann": ann.query,
    "op9_toxicity": toxicity.query,
    "op10_secrets": secrets.query,
}

QUERIES = {name: shipped(query) for name, query in QUERIES.items()}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op4_chat": chat.ORACLE,
    "op10_secrets": secrets.ORACLE,
}
