"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from dyadlake.llm.centroids import ORACLE as CENTROIDS_SQL
from dyadlake.llm.centroids import op13_centroid_clusters
from dyadlake.llm.decontaminate import op1_decontaminate
from dyadlake.llm.filters import ORACLE as FILTERS_SQL
from dyadlake.llm.filters import op12_filter_audit
from dyadlake.llm.language import op7_language_id
from dyadlake.llm.minhash import ORACLE as MINHASH_SQL
from dyadlake.llm.minhash import op3_minhash_near_duplicates
from dyadlake.llm.perplexity import op6_quality_rules
from dyadlake.llm.quality import op4_quality_embeddings
from dyadlake.llm.quotes import op10_quote_links
from dyadlake.llm.repeats import op9_suffix_dedup
from dyadlake.llm.secrets import op2_secret_scan
from dyadlake.llm.segmentations import op5_sampled_pieces
from dyadlake.llm.tokens import op8_token_codes
from dyadlake.llm.vectors import ORACLE as VECTORS_SQL
from dyadlake.llm.vectors import op11_embedding_near_duplicates

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_minhash_near_duplicates": op3_minhash_near_duplicates,
    "op4_quality_embeddings": op4_quality_embeddings,
    "op5_sampled_pieces": op5_sampled_pieces,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_token_codes": op8_token_codes,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quote_links": op10_quote_links,
    "op11_embedding_near_duplicates": op11_embedding_near_duplicates,
    "op12_filter_audit": op12_filter_audit,
    "op13_centroid_clusters": op13_centroid_clusters,
}

ORACLES = {
    "op3_minhash_near_duplicates": MINHASH_SQL,
    "op11_embedding_near_duplicates": op11_embedding_near_duplicates,
    "op12_filter_audit": op12_filter_audit,
    "op11_embedding_near_duplicates": VECTORS_SQL,
    "op12_filter_audit": FILTERS_SQL,
    "op13_centroid_clusters": CENTROIDS_SQL,
}
