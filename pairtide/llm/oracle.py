"""The queries of this subpackage that plain SQL can express, for DuckDB."""

FILL_IN_MIDDLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), hashed AS (
    SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
           CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM units
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM hashed
), parts AS (
    SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def _lloyd(rounds: int, clusters: int, size: int) -> str:
    """A round is a query over all vectors and centroids; each is materialised once."""
    near = """
assigned_{r} AS MATERIALIZED (
    SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d
    FROM (SELECT vec_id, row, v, c, list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, centre_{r})
    GROUP BY vec_id, row, v
)"""
    move = """
centre_{n} AS MATERIALIZED (
    SELECT c, coalesce(m.x, o.x) AS x
    FROM centre_{r} o LEFT JOIN (
        SELECT c, list(CAST((s - (s % k + k) % k) // k AS BIGINT) ORDER BY i) AS x
        FROM (SELECT c, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS k FROM assigned_{r}, range(1, {size} + 1) t(i) GROUP BY c, i)
        GROUP BY c
    ) m USING (c)
)"""
    steps = [f"""
kept AS MATERIALIZED (
    SELECT CAST(vec_id AS BIGINT) AS vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size}
), centre_0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS c, x
    FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v AS x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {clusters})
)"""]
    for r in range(rounds):
        steps += [near.format(r=r), move.format(r=r, n=r + 1, size=size)]
    steps.append(near.format(r=rounds))
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM assigned_{rounds} a JOIN centre_{rounds} e ON a.c = e.c
"""


ORACLE = {"op12_fill_in_middle": FILL_IN_MIDDLE, "op13_centroid_clustering": _lloyd(3, 16, 64)}
