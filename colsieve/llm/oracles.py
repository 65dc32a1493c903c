"""SQL for the queries that DuckDB can express, run on the small tables only."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

#: Smallest id reachable over the links (a, b) of a table l.
_REACH = "e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l), r(id, reach) AS (SELECT id, id FROM ids UNION SELECT r.id, e.v FROM r JOIN e ON r.reach = e.u), c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)"

ORACLE_SQL = {
    "op8_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS body FROM documents) WINDOW g AS (PARTITION BY body)""",
    "op3_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] ELSE w END) AS sh FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        ids AS (SELECT doc_id AS id FROM documents), {_REACH}
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id""",
    "op5_lattice_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.95),
        ids AS (SELECT vec_id AS id FROM v), {_REACH},
        k AS (SELECT u, count(*) AS n FROM e GROUP BY u)
        SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN k ON k.u = id""",
    "op9_substring_dedup": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i : i + 49], ' ')) END AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        m AS (SELECT h, min(doc_id) AS least FROM x WHERE h IS NOT NULL GROUP BY h),
        f AS (SELECT x.doc_id, i, word, max(coalesce((least < x.doc_id)::INT, 0)) OVER (PARTITION BY x.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN m ON m.h = x.h),
        a AS (SELECT doc_id, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM f GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id""",
}
