"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from proselake.llm.binary import op8_binary_ids
from proselake.llm.centroids import OP13_SQL, op13_centroid_clustering
from proselake.llm.decontaminate import OP5_SQL, op5_benchmark_decontamination
from proselake.llm.lexical import OP11_SQL, op11_ranked_search
from proselake.llm.licenses import OP10_SQL, op10_license_scans
from proselake.llm.near_duplicates import OP1_SQL, op1_minhash_near_dedup
from proselake.llm.packing import op2_best_fit_packing
from proselake.llm.quality import OP7_SQL, op7_quality_rules
from proselake.llm.repeats import op3_suffix_array_dedup
from proselake.llm.sharding import op6_sharding
from proselake.llm.tokens import op4_token_counts
from proselake.llm.topk import OP12_SQL, op12_exact_top_k
from proselake.llm.urls import op9_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_best_fit_packing,
        op3_suffix_array_dedup,
        op4_token_counts,
        op5_benchmark_decontamination,
        op6_sharding,
        op7_quality_rules,
        op8_binary_ids,
        op9_url_filters,
        op10_license_scans,
        op11_ranked_search,
        op12_exact_top_k,
        op13_centroid_clustering,
    )
}
SQL = {"op1_minhash_near_dedup": OP1_SQL, "op5_benchmark_decontamination": OP5_SQL, "op7_quality_rules": OP7_SQL, "op10_license_scans": OP10_SQL,
       "op11_ranked_search": OP11_SQL, "op12_exact_top_k": OP12_SQL, "op13_centroid_clustering": OP13_SQL}
