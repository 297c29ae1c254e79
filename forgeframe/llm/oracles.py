"""DuckDB SQL for the queries that SQL can express.

The other operators (language models, Markov models, XXH64, BPE, media bytes, CRC-32) are
tested against plain versions in ``tests/llm``.
"""

#: Words of documents and their hash-random keys; cells as in ``mixing``; the common level by its definition.
MIXING = r"""
WITH docs AS (
    SELECT doc_id, COALESCE(source, '') AS s, source IS NULL AS none,
        CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
    FROM documents),
sources AS (
    SELECT s, none, CAST(SUM(size) AS BIGINT) AS source_size,
        CAST(CASE (ROW_NUMBER() OVER (ORDER BY none, s) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
    FROM docs GROUP BY s, none),
caps AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS most, 2 * source_size / w AS ratio FROM sources),
levels AS (
    SELECT (1.5::DOUBLE * (SELECT SUM(source_size) FROM caps)
            - COALESCE((SELECT SUM(most) FROM caps b WHERE (b.ratio, b.none, b.s) < (c.ratio, c.none, c.s)), 0))
            / (SELECT SUM(w) FROM caps b WHERE (b.ratio, b.none, b.s) >= (c.ratio, c.none, c.s)) AS level, c.ratio, c.none, c.s
    FROM caps c),
targets AS (
    SELECT s, none, source_size, LEAST(w * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, none, s LIMIT 1), most) AS target FROM caps),
budgets AS (
    SELECT *, LEAST(CAST(floor(target + 0.5) AS BIGINT), 2 * source_size) AS whole FROM targets),
parts AS (
    SELECT *, CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS epochs FROM budgets),
placed AS (
    SELECT d.*, p.source_size, p.target, p.epochs, p.whole - p.epochs * p.source_size AS rest,
        SUM(size) OVER (PARTITION BY d.s, d.none ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
    FROM docs d JOIN parts p ON p.s = d.s AND p.none = d.none)
SELECT doc_id, size, source_size, target,
    CAST(epochs * size + GREATEST(0, LEAST(size, rest - before)) AS BIGINT) AS taken
FROM placed
"""

#: All pairs by brute force (small tables only) and their components.
EMBEDDINGS = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w)
SELECT e.vec_id, (SELECT COUNT(*) FROM links l WHERE l.u = e.vec_id) AS n_links,
    (SELECT MIN(w) FROM reach r WHERE r.u = e.vec_id) AS component_id,
    (SELECT MIN(w) FROM reach r WHERE r.u = e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""

SQL = {"op3_mixing": MIXING, "op5_embedding_dedup": EMBEDDINGS}
