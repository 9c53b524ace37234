"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from siteloom.llm.ann import op2_ann
from siteloom.llm.bpe import op4_bpe
from siteloom.llm.chat import op9_chat
from siteloom.llm.collocations import OP13_SQL, op13_collocations
from siteloom.llm.mixing import op5_mixing
from siteloom.llm.mtree import OP11_SQL, op11_topk
from siteloom.llm.neardup import OP1_SQL, op1_neardup
from siteloom.llm.pii import op10_pii
from siteloom.llm.quality import op8_quality
from siteloom.llm.secrets import op3_secrets
from siteloom.llm.simhash import op6_simhash
from siteloom.llm.spelling import OP12_SQL, op12_spelling
from siteloom.llm.toxicity import op7_toxicity

_ALL = (op1_neardup, op2_ann, op3_secrets, op4_bpe, op5_mixing, op6_simhash, op7_toxicity, op8_quality, op9_chat, op10_pii, op11_topk, op12_spelling, op13_collocations)
QUERIES = {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}

ORACLE = {"op1_neardup": OP1_SQL, "op11_topk": OP11_SQL, "op12_spelling": OP12_SQL, "op13_collocations": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
