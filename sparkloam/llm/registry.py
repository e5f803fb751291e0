"""The queries of the operators here and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, classifier, jaccard, lm, packing, pii, rules, suffixes, urls

QUERIES = {
    f.__name__: f
    for f in (
        classifier.op1_neighbour_vote,
        bpe.op2_bpe_tree,
        urls.op3_url_reputation,
        jaccard.op4_group_jaccard,
        suffixes.op5_prefix_free,
        rules.op6_quality_rules,
        pii.op7_weak_pii,
        ann.op8_hnsw,
        packing.op9_best_fit,
        lm.op10_ppm,
    )
}
ORACLE_SQL = {"op3_url_reputation": urls.OP3_SQL, "op6_quality_rules": rules.OP6_SQL}
