"""The queries that this subpackage adds to the library's registry, and their SQL."""

from __future__ import annotations

from terraspan.llm import bpe, clustering, embedding_dedup, exact_dedup, licenses, packing, periodic, quality, sharding, simhash, substring_dedup, syncmers, wavelet

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_quality": quality.query,
    "op3_packing": packing.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_wavelet": wavelet.query,
    "op6_bpe": bpe.query,
    "op7_licenses": licenses.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_syncmers": syncmers.query,
    "op10_simhash": simhash.query,
    "op11_clustering": clustering.query,
    "op12_periodic": periodic.query,
    "op13_embedding_dedup": embedding_dedup.query,
}
ORACLE_SQL = {"op4_exact_dedup": exact_dedup.SQL, "op7_licenses": licenses.SQL, "op8_substring_dedup": substring_dedup.SQL, "op11_clustering": clustering.SQL, "op13_embedding_dedup": embedding_dedup.SQL}
