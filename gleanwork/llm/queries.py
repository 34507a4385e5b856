"""The corpus operators' queries, and SQL for those that SQL can express."""

from . import centroids, fingerprints, html, media, minhash, mixing, packing, phrases, pii, quality, repeats, rules, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_media": media.op2_media,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_html": html.op5_html,
    "op6_repeats": repeats.op6_repeats,
    "op7_near_duplicates": minhash.op7_near_duplicates,
    "op8_pii": pii.op8_pii,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op11_rules": rules.op11_rules,
    "op12_centroids": centroids.op12_centroids,
    "op13_phrases": phrases.op13_phrases,
}

SQL = {"op10_mixing": mixing.OP10_SQL, "op11_rules": rules.OP11_SQL, "op12_centroids": centroids.OP12_SQL, "op13_phrases": phrases.OP13_SQL}
