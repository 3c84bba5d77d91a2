"""DuckDB SQL for the rows of the training-data queries; plain all-pairs forms, for small tables only."""

WARC_SQL = """
    with p as (select page_id, coalesce(html, '') as h from pages),
    d as (select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by h) as first from p)
    select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
        case when payload_bytes >= 100 and page_id <> first then first end as refers_to
    from d
"""

VECTOR_SQL = """
    with recursive v as (
        select distinct vec_id, label, embedding::double[] as e from embeddings
        where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
            and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
    walk as (select vec_id as id, vec_id as r from embeddings union select w.id, l.b from walk w join links l on w.r = l.a),
    least as (select id, min(r) as component_id from walk group by id),
    n as (select a as id, count(*) as n_links from links group by a)
    select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
    from embeddings join least on least.id = vec_id left join n on n.id = vec_id
"""

MINHASH_SQL = r"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as x from documents),
    s as (select distinct doc_id, unnest(case when len(x) = 0 then [] when len(x) < 5 then [list_aggregate(x, 'string_agg', ' ')]
        else list_transform(range(1, len(x) - 3), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] || ' ' || x[i + 3] || ' ' || x[i + 4]) end) as g from w),
    n as (select doc_id, count(*) as n from s group by doc_id),
    same as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
    links as (select a, b from same join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
    walk as (select doc_id as id, doc_id as r from documents union select w.id, l.b from walk w join links l on w.r = l.a),
    least as (select id, min(r) as component_id from walk group by id)
    select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
    from documents d join least on least.id = d.doc_id left join n on n.doc_id = d.doc_id
"""
