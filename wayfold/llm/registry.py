"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from corpus_pipeline import run as pipeline

from .additive_search import op9_additive_search
from .language import op10_language_id
from .licences import OP1_SQL, op1_licence_scan
from .mixing import OP4_SQL, op4_mixing
from .ngram_join import OP7_SQL, op7_ngram_join
from .periodic_runs import op11_periodic_runs
from .perspectives import OP8_SQL, op8_perspectives
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .sentencepieces import op3_sentencepieces
from .sharding import op6_sharding
from .sketch_dedup import OP12_SQL, op12_sketch_dedup
from .token_files import op2_token_files
from .topk_search import OP5_SQL, op5_topk_search

QUERIES = {
    "op1_licence_scan": op1_licence_scan,
    "op2_token_files": op2_token_files,
    "op3_sentencepieces": op3_sentencepieces,
    "op4_mixing": op4_mixing,
    "op5_topk_search": op5_topk_search,
    "op6_sharding": op6_sharding,
    "op7_ngram_join": op7_ngram_join,
    "op8_perspectives": op8_perspectives,
    "op9_additive_search": op9_additive_search,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_sketch_dedup": op12_sketch_dedup,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op1_licence_scan": OP1_SQL, "op4_mixing": OP4_SQL, "op5_topk_search": OP5_SQL, "op7_ngram_join": OP7_SQL, "op8_perspectives": OP8_SQL, "op12_sketch_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
