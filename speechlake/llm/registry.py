"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from speechlake.llm import stages
from speechlake.llm.centroids import OP13_SQL, op13_centroid_clusters
from speechlake.llm.decontaminate import OP4_SQL, op4_decontaminate
from speechlake.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from speechlake.llm.exact_substring import OP9_SQL, op9_suffix_dedup
from speechlake.llm.language import op2_language
from speechlake.llm.licenses import op1_license_scan
from speechlake.llm.merkle import OP11_SQL, op11_merkle_manifest
from speechlake.llm.ngram_join import OP10_SQL, op10_ngram_join
from speechlake.llm.packing import op8_best_fit_packing
from speechlake.llm.projected_search import OP12_SQL, op12_projected_search
from speechlake.llm.quality import op3_quality
from speechlake.llm.token_ids import op6_token_ids
from speechlake.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_token_ids": op6_token_ids,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_projected_search": op12_projected_search,
    "op13_centroid_clusters": op13_centroid_clusters,
    "pipeline": stages.run,
}

ORACLE: dict[str, str] = {
    "op4_decontaminate": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_ngram_join": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_projected_search": OP12_SQL,
    "op13_centroid_clusters": OP13_SQL,
}
