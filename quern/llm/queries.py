"""The registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quern.llm.bpe import op1_bpe
from quern.llm.bpe_rounds import op12_bytebpe
from quern.llm.ctw import op9_ctw
from quern.llm.decontam import OP8_SQL, op8_decontam
from quern.llm.divergence import OP11_SQL, op11_divergence
from quern.llm.html_text import op10_html
from quern.llm.lshjoin import op6_lshjoin
from quern.llm.merkle import OP13_SQL, op13_merkle
from quern.llm.quality import op4_quality
from quern.llm.substring import op3_substring
from quern.llm.topk import OP2_SQL, op2_topk
from quern.llm.toxicity import op7_toxicity
from quern.llm.warc import OP5_SQL, op5_warc

QUERIES = {"op1_bpe": op1_bpe, "op2_topk": op2_topk, "op3_substring": op3_substring, "op4_quality": op4_quality, "op5_warc": op5_warc, "op6_lshjoin": op6_lshjoin, "op7_toxicity": op7_toxicity, "op8_decontam": op8_decontam, "op9_ctw": op9_ctw, "op10_html": op10_html, "op11_divergence": op11_divergence, "op12_bytebpe": op12_bytebpe, "op13_merkle": op13_merkle}
ORACLE_SQL: dict[str, str] = {"op2_topk": OP2_SQL, "op5_warc": OP5_SQL, "op8_decontam": OP8_SQL, "op11_divergence": OP11_SQL, "op13_merkle": OP13_SQL}
