"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, licenses
from .chat import op7_chat_rotation
from .common import table
from .exact_dedup import op2_exact_dedup
from .langid import op6_language_id
from .licenses import op5_license_scan
from .packing import op3_best_fit_packing
from .pii import op10_pii
from .sentencepiece_fst import op1_sentencepiece
from .simhash import op9_simhash_near_dedup
from .suffix_dedup import op8_suffix_array_dedup
from .topk import op4_exact_topk


def queries():
    def over(name, operator):
        return lambda spark, sf_dir: operator(table(spark, sf_dir, name))

    return {
        "op1_sentencepiece": over("documents", op1_sentencepiece),
        "op2_exact_dedup": over("documents", op2_exact_dedup),
        "op3_best_fit_packing": over("documents", op3_best_fit_packing),
        "op4_exact_topk": over("embeddings", op4_exact_topk),
        "op5_license_scan": over("documents", op5_license_scan),
        "op6_language_id": over("documents", op6_language_id),
        "op7_chat_rotation": over("conversations", op7_chat_rotation),
        "op8_suffix_array_dedup": over("documents", op8_suffix_array_dedup),
        "op9_simhash_near_dedup": over("documents", op9_simhash_near_dedup),
        "op10_pii": over("documents", op10_pii),
    }


OP2_SQL = r"""
with n as (select doc_id, coalesce(text, '') as text,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
r as (select *, row_number() over w as rn, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as n_rows
    from n window w as (partition by norm order by length(text) desc, doc_id))
select doc_id, keep_id, n_rows as group_size, rn = 1 as kept, sha256(norm) as text_sha256,
    true as verified from r
"""

OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda c: cast(floor(64 * cast(c as double)) as bigint)) v
    from embeddings where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.vec_id query_id, x.vec_id, cast(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) as bigint) score
    from (select * from v where vec_id % 20 = 0) q join v x on q.vec_id <> x.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def oracle_sql():
    return {"op2_exact_dedup": OP2_SQL, "op4_exact_topk": OP4_SQL, "op5_license_scan": licenses.oracle_sql(), "op7_chat_rotation": chat.ORACLE_SQL}
