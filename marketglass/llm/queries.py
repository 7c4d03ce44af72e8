"""The numbered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, language_id, minhash, mixing, packing, pii, quality, resampling, secrets, simhash, token_counts, toxicity, va_search

QUERIES = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity,
        mixing.op2_source_mixing,
        quality.op3_quality_classifier,
        packing.op4_best_fit_packing,
        minhash.op5_document_fingerprints,
        language_id.op6_language_id,
        va_search.op7_exact_top_k,
        simhash.op8_simhash_near_dedup,
        pii.op9_pii,
        token_counts.op10_token_counts,
        resampling.op11_importance_resampling,
        secrets.op12_secret_scan,
        alignment.op13_tokenizer_alignment,
    )
}

SQL = {
    "op2_source_mixing": mixing.SQL,
    "op7_exact_top_k": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
          from embeddings
          where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as (
          select a.vec_id as query_id, b.vec_id, cast(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) as bigint) as score
          from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
        select query_id, rank, vec_id, score from r where rank <= 5""",
}
