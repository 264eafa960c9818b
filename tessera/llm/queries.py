"""The queries of the training-data operators, by name."""

from __future__ import annotations

from . import alignment, byte_bpe, clusters, media, mixing, packing, pii, quality, secrets, shingles, token_store, urls, vectors

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_pii": pii.op2,
    "op3_ngram_jaccard_join": shingles.op3,
    "op4_embedding_near_dedup": vectors.op4,
    "op5_token_store": token_store.op5,
    "op6_media_columns": media.op6,
    "op7_secret_scan": secrets.op7,
    "op8_quality_classifier": quality.op8,
    "op9_byte_bpe": byte_bpe.op9,
    "op10_url_filter": urls.op10,
    "op11_centroid_clustering": clusters.op11,
    "op12_source_mixing": mixing.op12,
    "op13_token_alignment": alignment.op13,
}
ORACLES: dict[str, str] = {"op3_ngram_jaccard_join": shingles.ORACLE, "op4_embedding_near_dedup": vectors.ORACLE, "op11_centroid_clustering": clusters.oracle()}
