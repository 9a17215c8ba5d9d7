"""The queries of this subpackage and the SQL that states their results, by name."""

from narrata.llm import bpe, fingerprints, html, media, minhash, mixing, pii, quality, secrets, urls

QUERIES = {
    "op1_pii_disclosure": pii.op1_pii_disclosure,
    "op2_mix_systematic": mixing.op2_mix_systematic,
    "op3_media_chunks": media.op3_media_chunks,
    "op4_bpe_chunk_reuse": bpe.op4_bpe_chunk_reuse,
    "op5_fingerprint_bottom_k": fingerprints.op5_fingerprint_bottom_k,
    "op6_html_site_templates": html.op6_html_site_templates,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_quality_random_indexing": quality.op8_quality_random_indexing,
    "op9_url_template_tree": urls.op9_url_template_tree,
    "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
}

SQL: dict[str, str] = {"op1_pii_disclosure": pii.OP1_SQL, "op2_mix_systematic": mixing.OP2_SQL, "op10_minhash_near_dedup": minhash.OP10_SQL}
