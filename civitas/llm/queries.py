"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from civitas.llm import clusters, divergence, licenses, secrets, vector_dedup
from civitas.llm.decontaminate import op3_decontaminate
from civitas.llm.dedup import op2_near_duplicates
from civitas.llm.language import op1_language_id
from civitas.llm.lm import op5_lm_score
from civitas.llm.neighbours import op6_nearest
from civitas.llm.packing import op10_pack
from civitas.llm.quality import op4_quality
from civitas.llm.tokens import op9_token_counts

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_lm_score": op5_lm_score,
    "op6_nearest": op6_nearest,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_licenses": licenses.op8_licenses,
    "op9_token_counts": op9_token_counts,
    "op10_pack": op10_pack,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_embedding_duplicates": vector_dedup.op12_embedding_duplicates,
    "op13_clusters": clusters.op13_clusters,
}
ORACLE_SQL: dict[str, str] = {
    "op7_secret_scan": secrets.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_embedding_duplicates": vector_dedup.ORACLE,
    "op13_clusters": clusters.ORACLE,
}
