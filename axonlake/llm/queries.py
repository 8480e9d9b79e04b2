"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import importlib

#: Query name -> module of this subpackage that has the function of that name.
MODULES = {
    "op1_decontam": "decontam",
    "op2_mixing": "mixing",
    "op3_toxicity": "toxicity",
    "op4_pii": "pii",
    "op5_sharding": "sharding",
    "op6_lmscore": "lmscore",
    "op7_quality": "quality",
    "op8_neardup": "neardup",
    "op9_topk": "topk",
    "op10_chat": "chat",
    "op11_codes": "gnat",
    "op12_trie": "prefix_trie",
    "op13_packing": "packing",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"axonlake.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from axonlake.llm import gnat, mixing, neardup, prefix_trie, sharding, topk

    return {"op2_mixing": mixing.OP2_SQL, "op5_sharding": sharding.OP5_SQL, "op8_neardup": neardup.OP8_SQL, "op9_topk": topk.OP9_SQL, "op11_codes": gnat.OP11_SQL, "op12_trie": prefix_trie.OP12_SQL}
