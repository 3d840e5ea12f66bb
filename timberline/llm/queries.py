"""The numbered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from timberline.llm.bitpack import op3_bit_packed_tokens
from timberline.llm.chat import OP5_SQL, op5_chat_format
from timberline.llm.collocations import OP13_SQL, op13_collocations
from timberline.llm.covertree import OP2_SQL, op2_near_vectors
from timberline.llm.grades import op9_quality_grades
from timberline.llm.jaccard import OP4_SQL, op4_jaccard_join
from timberline.llm.mixing import op10_mix_sources
from timberline.llm.packing import op7_best_fit_packing
from timberline.llm.quality import op1_quality_rules
from timberline.llm.repeats import OP6_SQL, op6_repeated_lines
from timberline.llm.secrets import OP8_SQL, op8_secret_scan
from timberline.llm.tokencounts import op11_token_counts
from timberline.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_near_vectors, op3_bit_packed_tokens, op4_jaccard_join, op5_chat_format, op6_repeated_lines, op7_best_fit_packing,
                                   op8_secret_scan, op9_quality_grades, op10_mix_sources, op11_token_counts, op12_whitening, op13_collocations)}
ORACLES: dict[str, str] = {"op2_near_vectors": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op5_chat_format": OP5_SQL, "op6_repeated_lines": OP6_SQL, "op8_secret_scan": OP8_SQL,
                           "op13_collocations": OP13_SQL}
