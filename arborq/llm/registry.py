"""The queries of this package for __spark_entry__.py, and the SQL that some of them can be checked with."""

from arborq.llm import bestfit, bitpack, jaccard, licenses, media, mixing, quality, secretscan, sql, tokencount, urlrep

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_divergence_quality,
        bitpack.op2_bit_packed_ids,
        bestfit.op3_best_fit_packing,
        urlrep.op4_url_reputation,
        secretscan.op5_secret_scan,
        tokencount.op6_token_counts,
        licenses.op7_license_sentences,
        media.op8_png_media,
        jaccard.op9_jaccard_join,
        mixing.op10_hierarchical_mix,
    )
}
ORACLE_SQL = {"op1_divergence_quality": sql.op1(), "op4_url_reputation": urlrep.sql(), "op5_secret_scan": sql.op5(), "op9_jaccard_join": sql.op9()}
