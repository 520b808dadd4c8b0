"""Queries of this package and the SQL that some of them can be held against."""

from __future__ import annotations

from . import decontaminate, hnsw, html_extract, language_id, order_minhash, ring, sentencepiece_codec, spelling_variants, suffix_dedup, super_kmer, token_alignment, token_counts, toxicity

QUERIES = {
    "op1_html_extract": html_extract.query,
    "op2_toxicity": toxicity.query,
    "op3_token_counts": token_counts.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_hnsw": hnsw.query,
    "op6_ring_sharding": ring.query,
    "op7_language_id": language_id.query,
    "op8_decontaminate": decontaminate.query,
    "op9_order_minhash": order_minhash.query,
    "op10_sentencepiece": sentencepiece_codec.query,
    "op11_super_kmer": super_kmer.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_token_alignment": token_alignment.query,
}
ORACLE_SQL = {"op8_decontaminate": decontaminate.SQL, "op11_super_kmer": super_kmer.SQL, "op12_spelling_variants": spelling_variants.SQL}
