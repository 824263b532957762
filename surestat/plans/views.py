"""Stand-in relations over the driver's tables, each as one SQL text that Spark and DuckDB both accept; {name} is a table or
another view. in_spark() gives a DataFrame, and in_sql() the CTEs that a SQL text needs before it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"]

VIEWS = {
    "samples": """
        SELECT l.l_suppkey AS index, CAST(l.l_orderkey % 100 AS INT) AS sample_id,
               l.l_orderkey * 10 + l.l_linenumber AS ord, p.p_name AS disease
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "trace": """
        SELECT l_suppkey AS index, l_orderkey AS item, l_linenumber AS pos, 0.05e0 + 9e0 * l_discount AS prob,
               l_tax * 10e0 AS entropy, l_returnflag = 'A' AS entailed
        FROM {lineitem}""",
    "scored": """
        SELECT l.l_suppkey AS index, p.p_name AS disease, round(avg(0.05e0 + 9e0 * l.l_discount), 9) AS uq_pure,
               round(max(l.l_tax) / 0.08e0, 9) AS kg_only, count(*) % 5 = 0 AS is_expanded
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
        WHERE l.l_returnflag = 'R' GROUP BY l.l_suppkey, p.p_name""",
    "lists": """
        SELECT p_partkey AS index,
               '- ' || p_name || ' (' || p_brand || ')' || chr(10) || '* ' || p_type || ' [' || CAST(p_size AS VARCHAR(9)) || chr(10)
               || CAST(p_partkey % 20 AS VARCHAR(9)) || ') ' || p_brand || ' due to ' || p_type || chr(10) || 'plain line' AS text
        FROM {part}""",
    "notes": """
        SELECT doc_id AS index,
               'CHIEF COMPLAINT: ' || lang || chr(10) || 'PAST MEDICAL HISTORY: ' || text || chr(10)
               || 'PHYSICAL EXAMINATION: ' || source || chr(10) || 'PLAN: ' || lang || chr(10) AS text
        FROM {documents}""",
    "kg": """
        SELECT CAST(p.p_partkey AS DOUBLE) AS x_index, 'P' || CAST(p.p_partkey AS VARCHAR(12)) AS x_id,
               CASE WHEN p.p_size % 2 = 0 THEN 'disease' ELSE 'effect/phenotype' END AS x_type, p.p_name || ' ' || CAST(p.p_partkey % 50 AS VARCHAR(9)) AS x_name,
               CAST(1000000 + l.l_suppkey AS DOUBLE) AS y_index, 'S' || CAST(l.l_suppkey AS VARCHAR(12)) AS y_id, 'drug' AS y_type, s.s_name AS y_name,
               CASE l.l_returnflag WHEN 'A' THEN 'Phenotype Present' WHEN 'R' THEN 'indication' ELSE 'associated with' END AS display_relation,
               l.l_orderkey * 10 + l.l_linenumber AS ord
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
        UNION ALL
        SELECT CAST(a.p_partkey AS DOUBLE), 'P' || CAST(a.p_partkey AS VARCHAR(12)), CASE WHEN a.p_size % 2 = 0 THEN 'disease' ELSE 'effect/phenotype' END, a.p_name || ' ' || CAST(a.p_partkey % 50 AS VARCHAR(9)),
               CAST(b.p_partkey AS DOUBLE), 'P' || CAST(b.p_partkey AS VARCHAR(12)), CASE WHEN b.p_size % 2 = 0 THEN 'disease' ELSE 'effect/phenotype' END, b.p_name || ' ' || CAST(b.p_partkey % 50 AS VARCHAR(9)),
               'parent-child', -b.p_partkey
        FROM {part} b JOIN {part} a ON a.p_partkey = CAST(floor(b.p_partkey / 10.0e0) AS BIGINT) WHERE b.p_partkey > 0""",
    "starts": """
        SELECT DISTINCT l_suppkey AS note, l_partkey AS index FROM {lineitem}""",
    "valid": """
        SELECT * FROM {kg} WHERE x_index IS NOT NULL AND y_index IS NOT NULL AND lower(display_relation) IN
               ('phenotype present', 'indication', 'off-label use', 'parent-child', 'associated with', 'side effect', 'target', 'enzyme', 'transporter', 'carrier')""",
}

# Further CTEs of the SQL side only.
SQL = {
    "gains": "SELECT index, disease AS item, count(DISTINCT sample_id) / 100.0e0 AS gain FROM {samples} GROUP BY 1, 2 HAVING count(DISTINCT sample_id) > 5",
    "long": """
        SELECT index, 'uq_pure' AS method, disease AS item, uq_pure AS score FROM {scored} WHERE NOT is_expanded
        UNION ALL SELECT index, 'kg_only', disease, kg_only FROM {scored}""",
    "wanted": "SELECT g.*, m.method FROM {gains} g CROSS JOIN (SELECT DISTINCT method FROM {long}) m",
    "universe": """
        SELECT index, method, item, coalesce(w.gain, 0) AS gain, coalesce(l.score, 0) AS score, l.item IS NOT NULL AS predicted, w.item IS NOT NULL AS in_reference
        FROM {wanted} w FULL JOIN (SELECT * FROM {long} WHERE index IN (SELECT index FROM {gains})) l USING (index, method, item)""",
    "judged": "SELECT * FROM {universe} QUALIFY count(*) OVER (PARTITION BY index, method) >= 2",
    "ranked": """
        SELECT *, CASE WHEN predicted THEN row_number() OVER (PARTITION BY index, method ORDER BY predicted DESC, score DESC, item) END AS pos,
               CASE WHEN in_reference THEN row_number() OVER (PARTITION BY index, method ORDER BY in_reference DESC, gain DESC, item) END AS ref_pos
        FROM {judged}""",
    "ndcg_rows": """
        SELECT *, row_number() OVER (PARTITION BY index, method ORDER BY score DESC, item) AS p,
               row_number() OVER (PARTITION BY index, method ORDER BY gain DESC, item) AS i,
               avg(gain) OVER (PARTITION BY index, method, score) AS m, count(*) FILTER (in_reference) OVER (PARTITION BY index, method) AS n
        FROM {judged}""",
    "ndcg": """
        SELECT index, method, """
    + ", ".join(f"coalesce(sum(m / log2(p + 1)) FILTER (p <= {k}) / nullif(sum(gain / log2(i + 1)) FILTER (i <= {k}), 0), 0) AS ndcg_{name}" for k, name in ((5, "5"), (10, "10"), ("n", "std")))
    + " FROM {ndcg_rows} GROUP BY 1, 2",
    "tau": """
        SELECT index, method, coalesce(sum(sign(a.gain - b.gain) * sign(a.score - b.score)) / nullif(sqrt(sum(abs(sign(a.gain - b.gain))) * sum(abs(sign(a.score - b.score)))), 0), 0) AS kendall_tau_b
        FROM {judged} a JOIN {judged} b USING (index, method) WHERE a.item < b.item GROUP BY 1, 2""",
    "hits": """
        SELECT index, method, coalesce(1.0e0 / min(pos) FILTER (in_reference), 0) AS mrr, """
    + ", ".join(
        f"coalesce(count(*) FILTER (in_reference AND pos <= {k}) / nullif(CAST(count(*) FILTER (pos <= {k}) AS DOUBLE), 0), 0) AS precision_{k}, coalesce(count(*) FILTER (in_reference AND pos <= {k}) / nullif(CAST(count(*) FILTER (in_reference) AS DOUBLE), 0), 0) AS recall_{k}"
        for k in (5, 10)
    )
    + " FROM {ranked} GROUP BY 1, 2",
    "rbo": """
        SELECT index, method, coalesce(sum(list_sum(list_transform(range(depth, deep + 1), lambda d: 0.1e0 * power(0.9e0, d - 1) / d))), 0) AS rbo
        FROM (SELECT index, method, greatest(count(pos), count(ref_pos)) AS deep FROM {ranked} GROUP BY 1, 2)
        LEFT JOIN (SELECT index, method, greatest(pos, ref_pos) AS depth FROM {ranked} WHERE pos IS NOT NULL AND ref_pos IS NOT NULL) USING (index, method) GROUP BY 1, 2""",
    "metrics": """
        SELECT index, method, n.* EXCLUDE (index, method), rbo, p.* EXCLUDE (index, method), kendall_tau_b
        FROM {ndcg} n JOIN {hits} p USING (index, method) JOIN {rbo} USING (index, method) JOIN {tau} USING (index, method)""",
    "nodes": """
        SELECT index, id, type, name FROM (
            SELECT 0 AS side, ord, CAST(x_index AS BIGINT) AS index, x_id AS id, x_type AS type, lower(coalesce(x_name, '')) AS name FROM {valid}
            UNION ALL SELECT 1, ord, CAST(y_index AS BIGINT), y_id, y_type, lower(coalesce(y_name, '')) FROM {valid})
        QUALIFY row_number() OVER (PARTITION BY index ORDER BY side, ord, id, type, name) = 1""",
    "weighted": """
        SELECT least(x, y) AS a, greatest(x, y) AS b, arg_max(w, (ord, w)) AS w FROM (
            SELECT CAST(x_index AS BIGINT) AS x, CAST(y_index AS BIGINT) AS y, ord,
                   CASE lower(display_relation) WHEN 'phenotype present' THEN 5e0 WHEN 'indication' THEN 3e0 WHEN 'off-label use' THEN 3e0 ELSE 1e0 END AS w
            FROM {valid}) GROUP BY 1, 2""",
    "sym": "SELECT a AS src, b AS dst, w FROM {weighted} UNION ALL SELECT b, a, w FROM {weighted} WHERE a <> b",
    "degree": "SELECT src AS index, sum(w) AS weighted, CAST(sum(CASE WHEN src = dst THEN 2 ELSE 1 END) AS BIGINT) AS degree FROM {sym} GROUP BY 1",
    "q": "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS q FROM {sym}",
    "tree": "SELECT DISTINCT CAST(y_index AS BIGINT) AS src, CAST(x_index AS BIGINT) AS dst FROM {valid} WHERE display_relation = 'parent-child' AND x_type IS NOT NULL AND y_type IS NOT NULL",
    "members": "SELECT src AS index FROM {tree} UNION SELECT dst FROM {tree} UNION SELECT index FROM {nodes} WHERE type IN ('disease', 'effect/phenotype')",
    "moves": "SELECT src, dst, 1.0e0 / count(*) OVER (PARTITION BY src) AS q FROM {tree}",
}


def _needed(text: str, found: dict[str, str], sql: bool) -> dict[str, str]:
    for name in re.findall(r"\{(\w+)\}", text):
        if name in found or name in TABLES:
            continue
        body = VIEWS.get(name) or (SQL[name] if sql else VIEWS[name])
        _needed(body, found, sql)
        found[name] = re.sub(r"\{(\w+)\}", r"\1", body)
    return found


def in_sql(text: str, recursive: str = "") -> str:
    """text, whose {name}s are tables and views, as one statement of DuckDB; recursive: a recursive CTE that comes last."""
    needed = _needed(text + recursive, {}, True)
    ctes = [f"{name} AS ({body})" for name, body in needed.items()] + ([re.sub(r"\{(\w+)\}", r"\1", recursive)] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {re.sub(r'[{](\w+)[}]', r'\1', text)}" if ctes else re.sub(r"\{(\w+)\}", r"\1", text)


def in_spark(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = VIEWS[name]
    return spark.sql(body, **{n: in_spark(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", body))})
