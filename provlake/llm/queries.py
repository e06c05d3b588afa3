"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from provlake.llm.license_scan import op11_license_scan
from provlake.llm.license_scan import oracle as op11_oracle
from provlake.llm.mixing import op5_mixing
from provlake.llm.packing import op6_packing
from provlake.llm.pii import op4_pii
from provlake.llm.pitman_yor import op8_pitman_yor
from provlake.llm.prune_graph import op9_prune_graph
from provlake.llm.quality_llr import op2_quality_llr
from provlake.llm.simhash_trie import op3_simhash_trie
from provlake.llm.templates import op10_templates
from provlake.llm.token_links import op13_token_links
from provlake.llm.token_planes import op1_token_planes
from provlake.llm.toxicity import op7_toxicity
from provlake.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_token_planes, op2_quality_llr, op3_simhash_trie, op4_pii, op5_mixing, op6_packing, op7_toxicity,
                                  op8_pitman_yor, op9_prune_graph, op10_templates, op11_license_scan, op12_whitening, op13_token_links)}
ORACLES: dict[str, str] = {"op11_license_scan": op11_oracle()}
