"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from loamgrid.llm import collocations
from loamgrid.llm.collocations import op11_phrase_collocation_mining
from loamgrid.llm.decontamination import op1_benchmark_decontamination
from loamgrid.llm.html_extraction import op9_html_extraction
from loamgrid.llm.line_dedup import op6_line_dedup
from loamgrid.llm.lm_scoring import op7_katz_backoff
from loamgrid.llm.mixture import op12_mixture_packing
from loamgrid.llm.ngram_join import op4_ngram_jaccard_join
from loamgrid.llm.packing import op2_best_fit_packing
from loamgrid.llm.periodic_runs import op13_periodic_run_detection
from loamgrid.llm.pii import op3_pii
from loamgrid.llm.quality_rules import op8_quality_rules
from loamgrid.llm.sharding import op10_label_propagation_sharding
from loamgrid.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_best_fit_packing, op3_pii, op4_ngram_jaccard_join, op5_toxicity, op6_line_dedup, op7_katz_backoff, op8_quality_rules, op9_html_extraction, op10_label_propagation_sharding,
                                  op11_phrase_collocation_mining, op12_mixture_packing, op13_periodic_run_detection)}
ORACLES: dict[str, str] = {"op11_phrase_collocation_mining": collocations.ORACLE_SQL}
