"""The vector operators' queries as SQL, over all pairs."""

from __future__ import annotations


def _whole(condition: str) -> str:
    good = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    whole = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
    return f"SELECT *, row_number() OVER () AS rid, {whole} AS v FROM embeddings WHERE {condition} AND {good}"


def clusters(dims: int = 64, k: int = 40, rounds: int = 5) -> str:
    steps = [
        f"kept AS MATERIALIZED ({_whole(f'len(embedding) = {dims}')})",
        "part AS MATERIALIZED (SELECT rid, unnest(range(len(v))) AS j, unnest(v) AS x FROM kept)",
        f"first AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(range(len(v))) AS j, unnest(v) AS m FROM first)",
    ]
    for i in range(rounds + 1):
        steps += [
            f"d{i} AS (SELECT rid, c, sum((x - m) * (x - m)) AS d FROM part JOIN c{i} USING (j) GROUP BY rid, c)",
            f"a{i} AS MATERIALIZED (SELECT rid, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)",
        ]
        if i < rounds:
            steps += [
                f"s{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN part USING (rid) GROUP BY c, j)",
                f"c{i + 1} AS MATERIALIZED (SELECT c, j, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{i} LEFT JOIN s{i} USING (c, j))",
            ]
    last = f"a{rounds}"
    steps += [
        f"w AS (SELECT c, sum(d) AS s FROM {last} GROUP BY c)",
        f"h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)",
    ]
    columns = (
        "vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(s AS BIGINT) AS cluster_inertia, "
        "CAST((SELECT sum(s) FROM w) AS BIGINT) AS inertia, centroid_sha256"
    )
    return f"WITH {', '.join(steps)} SELECT {columns} FROM {last} JOIN kept USING (rid) JOIN w USING (c) JOIN h USING (c)"


def hard_negatives() -> str:
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT vec_id, rid, {label} AS lab, v FROM ({_whole('embedding IS NOT NULL AND label IS NOT NULL')})
    ),
    scored AS MATERIALIZED (
        SELECT a.rid AS a_rid, a.vec_id AS anchor_id, x.rid, x.vec_id AS other_id, a.lab = x.lab AS same,
               CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
        FROM kept a JOIN kept x ON a.rid <> x.rid WHERE a.vec_id % 100 = 0
    ),
    positive AS (
        SELECT *, row_number() OVER (PARTITION BY a_rid ORDER BY score DESC, other_id, rid) AS place
        FROM scored WHERE same QUALIFY place <= 5
    ),
    negative AS (
        SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
               row_number() OVER (PARTITION BY p.a_rid, p.place ORDER BY n.score DESC, n.other_id, n.rid) AS rank
        FROM positive p JOIN scored n ON p.a_rid = n.a_rid AND NOT n.same
        WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative
    """
