"""The operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tabscope.llm.audit import OP12_SQL, op12_audit
from tabscope.llm.bpe import op5_bpe
from tabscope.llm.chat import OP9_SQL, op9_chat
from tabscope.llm.digest import op10_digest
from tabscope.llm.jaccard import op3_jaccard
from tabscope.llm.lm import op11_lm
from tabscope.llm.mixing import OP6_SQL, op6_mixing
from tabscope.llm.periodic import op13_runs
from tabscope.llm.pii import op8_pii
from tabscope.llm.quality import op2_quality
from tabscope.llm.rules import op7_rules
from tabscope.llm.suffixes import op1_suffixes
from tabscope.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_suffixes": op1_suffixes, "op2_quality": op2_quality, "op3_jaccard": op3_jaccard, "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe, "op6_mixing": op6_mixing, "op7_rules": op7_rules, "op8_pii": op8_pii, "op9_chat": op9_chat,
    "op10_digest": op10_digest, "op11_lm": op11_lm, "op12_audit": op12_audit, "op13_runs": op13_runs,
}
SQL: dict[str, str] = {"op6_mixing": OP6_SQL, "op9_chat": OP9_SQL, "op12_audit": OP12_SQL}
