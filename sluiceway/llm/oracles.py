"""The queries' results in DuckDB SQL, where SQL can express them."""

# Shared parts of the queries over word shingles.
_SHINGLES = r"""
    words AS (
        SELECT doc_id,
               regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE
            WHEN len(w) = 0 THEN []
            WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM words)
"""

ORACLES = {
    "op2_exact_dedup": """
        WITH rows AS (SELECT doc_id, coalesce(text, '') AS content FROM documents)
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(content) AS text_sha256
        FROM rows WINDOW same AS (PARTITION BY content)
    """,
    "op5_jaccard_join": "WITH RECURSIVE" + _SHINGLES + """,
    sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
    links AS (
        SELECT a.doc_id AS x, b.doc_id AS y
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, m.n, n.n
        HAVING 100 * count(*) >= 80 * (m.n + n.n - count(*))),
    reach AS (
        SELECT doc_id, doc_id AS to_id FROM documents
        UNION
        SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.to_id)
        SELECT doc_id, n AS n_shingles, min(to_id) AS component_id
        FROM sizes JOIN reach USING (doc_id) GROUP BY doc_id, n
    """,
    "op8_nearest": """
        WITH usable AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score
            FROM pairs)
        SELECT * FROM ranked WHERE rank <= 10
    """,
    "op11_mix_sources": """
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents),
        sources AS (
            SELECT source, sum(size)::HUGEINT AS source_size,
                   [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS weight
            FROM sized GROUP BY source),
        -- Each round: what is left to share, and the weights that share it.
        shared AS (
            SELECT 0 AS round, sum(source_size)::HUGEINT AS over, sum(weight)::HUGEINT AS under,
                   0::BIGINT AS capped, -1::BIGINT AS before
            FROM sources
            UNION ALL
            SELECT s.round + 1, n.over, n.under, n.capped, s.capped
            FROM shared s, LATERAL (
                SELECT sum(CASE WHEN weight * s.over > 3 * source_size * s.under THEN -2 ELSE 1 END * source_size)::HUGEINT AS over,
                       sum(weight) FILTER (weight * s.over <= 3 * source_size * s.under)::HUGEINT AS under,
                       count(*) FILTER (weight * s.over > 3 * source_size * s.under) AS capped
                FROM sources) n
            WHERE s.capped <> s.before AND s.over > 0),
        final AS (SELECT over, under FROM shared ORDER BY round DESC LIMIT 1),
        targets AS (
            SELECT source, source_size,
                   CASE WHEN weight * over > 3 * source_size * under THEN 3 * source_size ELSE weight * over END AS over,
                   CASE WHEN weight * over > 3 * source_size * under THEN 1 ELSE under END AS under,
                   ('0x' || substr(md5('0/source/' || coalesce(source, '')), 1, 5))::HUGEINT AS place
            FROM sources, final),
        numbered AS (
            SELECT *, row_number() OVER (
                PARTITION BY source
                ORDER BY size, md5('0/' || doc_id) NULLS FIRST, doc_id NULLS FIRST)::HUGEINT AS k
            FROM sized),
        found AS (
            SELECT doc_id, size, source_size::BIGINT AS source_size, over::DOUBLE / under::DOUBLE AS target,
                   CASE WHEN source_size > 0 THEN
                       (k * over * 1048576 + place * under * source_size) // (1048576 * under * source_size)
                       - ((k - 1) * over * 1048576 + place * under * source_size) // (1048576 * under * source_size)
                   ELSE 0 END::BIGINT AS copies
            FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM found
    """,
    "op13_hard_negatives": """
        WITH usable AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                   list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.positive_id,
               row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
               n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
        FROM positives p JOIN scored n
          ON n.anchor_id = p.anchor_id AND NOT n.same
         AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
        QUALIFY rank <= 10
    """,
}
