"""Queries over code graphs, features and containers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracefold import rules
from tracefold.operators import features, graph, lineage
from tracefold.plans.catalog import query
from tracefold.plans.views import literal, values
from tracefold.session import cut
from tracefold.sources import graphs as graph_io

# --- building --------------------------------------------------------------------------

NODE_ROWS = """
SELECT graph_id, func, block_id, type, name, code, line, is_external, n,
       row_number() OVER (PARTITION BY graph_id ORDER BY func_seq, block_seq) - 1 AS id
FROM (SELECT graph_id, func, func_seq, NULL AS block_id, -1 AS block_seq, 'METHOD' AS type, func AS name,
             CASE WHEN signature <> '' THEN signature ELSE func END AS code, address AS line, is_external, 0 AS n
      FROM {functions}
      UNION ALL SELECT b.graph_id, b.func, func_seq, b.block_id, block_seq, 'BLOCK',
             'block_' || b.block_id, coalesce(txt, ''), start, FALSE, coalesce(n, 0)
      FROM {blocks} b JOIN {functions} f ON b.func = f.func AND b.graph_id = f.graph_id AND NOT is_external
      LEFT JOIN (SELECT graph_id, func, block_id, count(*) AS n,
                        string_agg(nullif(raw_text, ''), chr(10) ORDER BY idx) AS txt
                 FROM {block_instructions} GROUP BY graph_id, func, block_id) i
           ON i.graph_id = b.graph_id AND i.func = b.func AND i.block_id = b.block_id) x"""
BUILT = {"nd": NODE_ROWS}


def _nodes(t):
    return cut(graph.node_ids(t("functions"), t("blocks")))


@query("build_nodes", """
SELECT nd.graph_id, id, type, name, code, line, is_external, n AS num_instructions, coalesce(c, '') AS counts
FROM {nd} LEFT JOIN (SELECT graph_id, func, block_id, string_agg(k, ',' ORDER BY k) AS c FROM (
    SELECT graph_id, func, block_id, inst_type || '=' || count(*) AS k FROM {block_instructions}
    GROUP BY graph_id, func, block_id, inst_type) y GROUP BY graph_id, func, block_id) z
  ON nd.graph_id = z.graph_id AND nd.func = z.func AND nd.block_id = z.block_id""", BUILT)
def _(t):
    pairs = F.transform(F.array_sort(F.map_entries("inst_counts")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string")))
    nodes = graph.build_nodes(t("functions"), t("blocks"), t("block_instructions"), texts=True)
    return nodes.select(
        "graph_id", "id", "type", "name", "code", "line", "is_external", "num_instructions",
        F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("counts"))


@query("block_code", """
SELECT nd.graph_id, nd.id, idx // 2 AS piece, string_agg(raw_text, chr(10) ORDER BY idx) AS code
FROM {nd} JOIN {block_instructions} i ON i.graph_id = nd.graph_id AND i.func = nd.func AND i.block_id = nd.block_id
WHERE coalesce(raw_text, '') <> '' AND type = 'BLOCK' GROUP BY nd.graph_id, nd.id, idx // 2""", BUILT)
def _(t):
    return graph.block_code(_nodes(t), t("block_instructions"), 2)


@query("cfg_edges", """
SELECT s.graph_id, m.id AS src, b.id AS dst, 'FLOWS_TO' AS etype
FROM (SELECT bl.graph_id, bl.func, coalesce(max(bl.block_id) FILTER (WHERE bl.block_id = f.entry_block_id),
             min(bl.block_id)) AS block_id
      FROM {blocks} bl JOIN {functions} f ON f.func = bl.func AND f.graph_id = bl.graph_id
      GROUP BY bl.graph_id, bl.func) s
JOIN {nd} b ON b.graph_id = s.graph_id AND b.func = s.func AND b.block_id = s.block_id
JOIN {nd} m ON m.graph_id = s.graph_id AND m.func = s.func AND m.block_id IS NULL
UNION ALL SELECT s.graph_id, a.id, b.id, 'FLOWS_TO' FROM {successors} s
JOIN {nd} a ON a.graph_id = s.graph_id AND a.func = s.func AND a.block_id = s.block_id
JOIN {nd} b ON b.graph_id = s.graph_id AND b.func = s.func AND b.block_id = s.succ_id""", BUILT)
def _(t):
    return graph.cfg_edges(t("functions"), t("blocks"), t("successors"), _nodes(t))


@query("call_edges", """
SELECT l.graph_id, a.id AS src, b.id AS dst, 'CALLS' AS etype FROM {listed_calls} l
JOIN {nd} a ON a.graph_id = l.graph_id AND a.name = l.func AND a.type = 'METHOD'
JOIN {nd} b ON b.graph_id = l.graph_id AND b.name = l.callee AND b.type = 'METHOD'
UNION ALL SELECT c.graph_id, b.id, m.id, 'CALLS' FROM (
  SELECT DISTINCT graph_id, func, block_id, idx, unnest(names) AS callee FROM (
    SELECT graph_id, func, block_id, idx, list_concat([CASE WHEN EXISTS (SELECT 1 FROM {functions} f
           WHERE f.graph_id = i.graph_id AND f.func = i.operand_name) THEN operand_name ELSE operand_value END],
           string_split_regex(trim(raw_text), ' +')) AS names
    FROM {block_instructions} i WHERE inst_type = 'CALL') x) c
JOIN {nd} m ON m.graph_id = c.graph_id AND m.name = c.callee AND m.type = 'METHOD'
JOIN {nd} b ON b.graph_id = c.graph_id AND b.func = c.func AND b.block_id = c.block_id""", BUILT)
def _(t):
    return graph.call_edges(t("functions"), t("listed_calls"), t("block_instructions"), _nodes(t))


DEF_USE = {"du": """
SELECT graph_id, func, block_id, var, bool_or(is_output) AS is_defined,
       coalesce(min(idx) FILTER (WHERE is_input) <= coalesce(min(idx) FILTER (WHERE is_output), 1000000), FALSE)
       AS is_exposed
FROM {operands} WHERE op_type <> 'constant' GROUP BY graph_id, func, block_id, var"""}


@query("def_use", "SELECT * FROM {du}", DEF_USE)
def _(t):
    return graph.def_use(t("operands"))


PREDS = {"pr": """
SELECT DISTINCT s.graph_id, s.func, s.succ_id AS block_id, s.block_id AS pred_id FROM {successors} s
JOIN {blocks} b ON b.func = s.func AND b.graph_id = s.graph_id AND b.block_id = s.succ_id"""}


@query("predecessors", "SELECT * FROM {pr}", PREDS)
def _(t):
    return graph.predecessors(t("blocks"), t("successors"))


@query("reaching_definitions", """
SELECT w.graph_id, w.func, w.var, w.cur AS def_id, w.use_id FROM {walk} w
JOIN {du} d ON d.graph_id = w.graph_id AND d.func = w.func AND d.block_id = w.cur AND d.var = w.var
     AND d.is_defined""", DEF_USE | PREDS | {"walk": """
SELECT u.graph_id, u.func, u.var, u.block_id AS use_id, p.pred_id AS cur FROM {du} u
JOIN {pr} p ON p.graph_id = u.graph_id AND p.func = u.func AND p.block_id = u.block_id
WHERE u.is_exposed
UNION SELECT w.graph_id, w.func, w.var, w.use_id, p.pred_id FROM walk w
JOIN {pr} p ON p.graph_id = w.graph_id AND p.func = w.func AND p.block_id = w.cur
WHERE NOT EXISTS (SELECT 1 FROM {du} d WHERE d.graph_id = w.graph_id AND d.func = w.func
                  AND d.block_id = w.cur AND d.var = w.var AND d.is_defined)"""})
def _(t):
    preds = graph.predecessors(t("blocks"), t("successors"))
    return graph.reaching_definitions(graph.def_use(t("operands")), preds)


@query("metadata_caps", """
SELECT file_id, kind, pos, value, row_number() OVER (PARTITION BY file_id, kind ORDER BY pos, value) - 1 AS place
FROM {items}""")
def _(t):
    return graph.metadata_items(t("items"))


# --- checks and neighbours ---------------------------------------------------------------

@query("validate_edges", """
SELECT e.graph_id, src, dst, etype, a.id IS NULL AS missing_src, b.id IS NULL AS missing_dst
FROM {edges} e LEFT JOIN {n} a ON a.graph_id = e.graph_id AND a.id = src
LEFT JOIN {n} b ON b.graph_id = e.graph_id AND b.id = dst WHERE a.id IS NULL OR b.id IS NULL""",
       {"n": "SELECT graph_id, id + CASE WHEN id % 10 = 3 THEN 1000000000 ELSE 0 END AS id FROM {nodes}"})
def _(t):
    moved = t("nodes").withColumn("id", F.expr("id + CASE WHEN id % 10 = 3 THEN 1000000000 ELSE 0 END"))
    return graph.invalid_edges(moved, t("edges"))


@query("duplicate_nodes", """
SELECT graph_id, id, count(*) AS copies FROM (SELECT graph_id, id FROM {nodes}
  UNION ALL SELECT graph_id, id FROM {nodes} WHERE id % 9 = 0) x GROUP BY graph_id, id HAVING count(*) > 1""")
def _(t):
    return graph.duplicate_nodes(t("nodes").unionByName(t("nodes").where("id % 9 = 0")))


@query("nodes_by_type", "SELECT graph_id, id, name FROM {nodes} WHERE type = 'METHOD'")
def _(t):
    return graph.nodes_by_type(t("nodes"), "METHOD").select("graph_id", "id", "name")


@query("graph_counts", """
SELECT n.graph_id, num_nodes, num_methods, num_calls, coalesce(num_edges, 0) AS num_edges FROM (
  SELECT graph_id, count(*) AS num_nodes, count(*) FILTER (WHERE type = 'METHOD') AS num_methods,
         count(*) FILTER (WHERE type = 'CALL') AS num_calls FROM {nodes} GROUP BY graph_id) n
LEFT JOIN (SELECT graph_id, count(*) AS num_edges FROM {edges} GROUP BY graph_id) e ON n.graph_id = e.graph_id""")
def _(t):
    return graph.graph_counts(t("nodes"), t("edges"))


@query("out_edges", """
SELECT e.graph_id, src AS id, dst AS other_id, etype, n.type AS other_type, n.name AS other_name
FROM {edges} e JOIN {nodes} n ON n.graph_id = e.graph_id AND n.id = dst WHERE etype = 'CALLS'""")
def _(t):
    return graph.neighbours(t("nodes"), t("edges"), "out", rules.EDGE_CALLS)


@query("in_edges", """
SELECT e.graph_id, dst AS id, src AS other_id, etype, n.type AS other_type, n.name AS other_name
FROM {edges} e JOIN {nodes} n ON n.graph_id = e.graph_id AND n.id = src""")
def _(t):
    return graph.neighbours(t("nodes"), t("edges"), "in")


@query("subgraph", """
SELECT e.graph_id, src, dst, etype FROM {edges} e
WHERE EXISTS (SELECT 1 FROM {nodes} n WHERE n.graph_id = e.graph_id AND n.id = src AND type = 'BLOCK')
  AND EXISTS (SELECT 1 FROM {nodes} n WHERE n.graph_id = e.graph_id AND n.id = dst AND type = 'BLOCK')""")
def _(t):
    return graph.subgraph(t("nodes"), t("edges"), graph.nodes_by_type(t("nodes"), "BLOCK"))[1]


OFFSETS = {"off": """
SELECT graph_id, box, CAST(sum(nx) OVER (PARTITION BY box ORDER BY graph_id) - nx AS BIGINT) AS o
FROM (SELECT graph_id, graph_id % 4 AS box, max(id) + 1 AS nx FROM {nodes} GROUP BY graph_id) x"""}


@query("merge_graphs", """
SELECT off.box, e.graph_id, src + o AS src, dst + o AS dst, etype
FROM {edges} e JOIN {off} ON off.graph_id = e.graph_id""", OFFSETS)
def _(t):
    boxed = t("nodes").withColumn("box", F.col("graph_id") % 4)
    return graph.merge_graphs(boxed, t("edges"), "box")[1]


@query("merge_graph_nodes", """
SELECT off.box, n.graph_id, id + o AS id, type FROM {nodes} n JOIN {off} ON off.graph_id = n.graph_id""",
       OFFSETS)
def _(t):
    boxed = t("nodes").withColumn("box", F.col("graph_id") % 4)
    return graph.merge_graphs(boxed, t("edges"), "box")[0].select("box", "graph_id", "id", "type")


COLLATED = {"pl": """
SELECT graph_id, id, type, dense_rank() OVER (ORDER BY graph_id) - 1 AS batch_index,
       row_number() OVER (ORDER BY graph_id, id) - 1 AS node_index FROM {nodes}"""}


@query("collate_graphs", "SELECT * FROM {pl}", COLLATED)
def _(t):
    return graph.collate_graphs(t("nodes"), t("edges"))[0]


@query("collate_graph_edges", """
SELECT e.graph_id, a.node_index AS src_index, b.node_index AS dst_index, etype FROM {edges} e
JOIN {pl} a ON a.graph_id = e.graph_id AND a.id = src JOIN {pl} b ON b.graph_id = e.graph_id AND b.id = dst""",
       COLLATED)
def _(t):
    return graph.collate_graphs(t("nodes"), t("edges"))[1]


# --- traversal -------------------------------------------------------------------------------

def reach_sql(edges: str, start: str, limit: int = 14) -> str:
    """Shortest distances by levels; ``limit`` is above the longest one."""
    return f"""
SELECT graph_id, id, 0 AS distance FROM ({start}) s
UNION SELECT r.graph_id, e.next, r.distance + 1 FROM reach r JOIN ({edges}) e
      ON e.graph_id = r.graph_id AND e.id = r.id WHERE r.distance < {limit}"""


@query("bfs_reach", "SELECT graph_id, id, min(distance) AS distance FROM {reach} GROUP BY graph_id, id", {
    "reach": reach_sql("SELECT DISTINCT graph_id, src AS id, dst AS next FROM {edges}",
                       "SELECT graph_id, id FROM {nodes} WHERE type = 'METHOD'")})
def _(t):
    sources = t("nodes").where("type = 'METHOD'")
    return graph.bfs_reach(t("edges"), sources)


@query("bfs_reach_typed", "SELECT graph_id, id, min(distance) AS distance FROM {reach} GROUP BY graph_id, id", {
    "reach": reach_sql("SELECT DISTINCT graph_id, src AS id, dst AS next FROM {edges} WHERE etype = 'FLOWS_TO'",
                       "SELECT graph_id, id FROM {nodes} WHERE type = 'METHOD'", 30)})
def _(t):
    return graph.bfs_reach(t("edges"), graph.nodes_by_type(t("nodes"), "METHOD"), rules.EDGE_CFG)


def _round(previous: str, links: str) -> str:
    return f"""
SELECT graph_id, id, block FROM {{{previous}}}
UNION ALL SELECT l.graph_id, l.next, min(p.block) FROM ({links}) l JOIN {{{previous}}} p
      ON p.graph_id = l.graph_id AND p.id = l.id
WHERE NOT EXISTS (SELECT 1 FROM {{{previous}}} q WHERE q.graph_id = l.graph_id AND q.id = l.next)
GROUP BY l.graph_id, l.next"""


BOTH = ("SELECT graph_id, src AS id, dst AS next FROM {edges} UNION ALL "
        "SELECT graph_id, dst, src FROM {edges}")
PLACED = {
    "p0": "SELECT graph_id, id, id AS block FROM {nodes} WHERE type = 'BLOCK'",
    "p1": _round("p0", "SELECT graph_id, src AS id, dst AS next FROM {edges} WHERE etype = 'IS_AST_PARENT'"),
    **{f"p{i}": _round(f"p{i - 1}", BOTH) for i in range(2, 9)}, "placed": _round("p8", BOTH)}


@query("instruction_to_block", "SELECT * FROM {placed}", PLACED)
def _(t):
    return graph.instruction_to_block(t("nodes"), t("edges"))


@query("collapse_to_blocks", """
SELECT DISTINCT graph_id, unnest(e).s AS src, unnest(e).d AS dst, unnest(e).t AS etype FROM (
  SELECT e.graph_id, [CASE
    WHEN etype IN ('FLOWS_TO', 'REACHES') AND a.block <> 0 AND b.block <> 0 AND a.block <> b.block
         THEN {'s': a.block, 'd': b.block, 't': etype}
    WHEN etype = 'CALLS' AND n.type = 'METHOD' AND m.type = 'METHOD' THEN {'s': src, 'd': dst, 't': etype}
    WHEN etype = 'CALLS' AND a.block <> 0 AND m.type = 'METHOD' THEN {'s': a.block, 'd': dst, 't': etype}
    WHEN etype = 'IS_AST_PARENT' AND n.type = 'METHOD' AND m.type = 'BLOCK'
         THEN {'s': src, 'd': dst, 't': 'FLOWS_TO'} END] AS e
  FROM {edges} e JOIN {nodes} n ON n.graph_id = e.graph_id AND n.id = src
  JOIN {nodes} m ON m.graph_id = e.graph_id AND m.id = dst
  LEFT JOIN {placed} a ON a.graph_id = e.graph_id AND a.id = src
  LEFT JOIN {placed} b ON b.graph_id = e.graph_id AND b.id = dst) x WHERE e[1] IS NOT NULL""", PLACED)
def _(t):
    placed = graph.instruction_to_block(t("nodes"), t("edges"))
    return graph.collapse_to_blocks(t("nodes"), t("edges"), placed)


@query("block_composition", """
SELECT n.graph_id, block, coalesce(operator_type, control_type, type) AS key, count(*) AS n
FROM {nodes} n JOIN {placed} p ON p.graph_id = n.graph_id AND p.id = n.id
WHERE type NOT IN ('BLOCK', 'METHOD') GROUP BY ALL""", PLACED)
def _(t):
    placed = graph.instruction_to_block(t("nodes"), t("edges"))
    return graph.block_composition(t("nodes"), placed)


@query("sample_graph", """
SELECT n.graph_id, n.id, coalesce(d, 2147483647) AS distance,
       row_number() OVER (PARTITION BY n.graph_id ORDER BY coalesce(d, 2147483647), n.id) - 1 AS place
FROM {nodes} n LEFT JOIN (SELECT graph_id, id, min(distance) AS d FROM {reach} GROUP BY graph_id, id) r
     ON r.graph_id = n.graph_id AND r.id = n.id""", {
    "reach": reach_sql("SELECT DISTINCT graph_id, id, next FROM (" + BOTH + ") b",
                       "SELECT graph_id, id FROM {nodes} WHERE type = 'METHOD'", 14)})
def _(t):
    return graph.rank_nodes(t("nodes"), t("edges"))


# --- graph documents ----------------------------------------------------------------------------

@query("graph_write_read", """
SELECT graph_id, id, type, name, coalesce(operator_type, '') AS operator_type, is_external, line
FROM {nodes}""")
def _(t):
    records = graph_io.graph_records(t("nodes"), t("edges"))
    nodes, _ = graph_io.graph_read(records)
    return nodes.select("graph_id", "id", "type", "name", F.coalesce("operator_type", F.lit(""))
                        .alias("operator_type"), "is_external", "line")


@query("graph_documents", """
SELECT n.graph_id, n, coalesce(e, 0) AS e FROM (SELECT graph_id, count(*) AS n FROM {nodes} GROUP BY graph_id) n
LEFT JOIN (SELECT graph_id, count(*) AS e FROM {edges} GROUP BY graph_id) x ON n.graph_id = x.graph_id""")
def _(t):
    documents = graph_io.graph_documents(graph_io.graph_records(t("nodes"), t("edges")))
    records = graph_io.parse_documents(documents)
    count = lambda part: F.count_if(F.col("part") == part)
    return records.groupBy("graph_id").agg(count("node").alias("n"), count("edge").alias("e"))


@query("feature_defaults", """
SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN 1024 ELSE 2 END AS n_bytes, 256 AS n_tokens,
       CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS label FROM {orders}""")
def _(t):
    key = F.col("o_orderkey")
    bundle = t("orders").select(
        key.alias("file_id"), F.when(key % 2 == 1, F.array(F.lit(0.5), F.lit(0.25)))
        .alias("byte_means"), F.when(key % 3 != 0, F.lit(1)).alias("label"))
    out = graph_io.with_feature_defaults(bundle)
    return out.select("file_id", F.size("byte_means").alias("n_bytes"),
                      F.size("api_tokens").alias("n_tokens"), "label")


# --- features -------------------------------------------------------------------------------------

STEP = (1 << 32) % rules.HASH_BUCKETS


def _digest(digest: str, chunks: int) -> str:
    out = "0"
    for i in range(chunks):
        out = f"(({out}) * {STEP} + CAST('0x' || substr({digest}, {8 * i + 1}, 8) AS BIGINT)) % 68"
    return out


def buckets_sql(text: str) -> str:
    poly = (f"list_reduce(list_concat([0::BIGINT], list_transform(regexp_extract_all({text}, '(?s).'), "
            "lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295) % 68")
    return (f"list_distinct([CAST({_digest(f'md5({text})', 4)} AS BIGINT), "
            f"CAST({_digest(f'sha1({text})', 5)} AS BIGINT), CAST({poly} AS BIGINT)])")


@query("multi_hash", f"""
SELECT c_custkey AS text_id, unnest({buckets_sql('c_name')}) AS bucket FROM {{customer}}""")
def _(t):
    return features.multi_hash(t("customer").select(F.col("c_custkey").alias("text_id"),
                                                    F.col("c_name").alias("text")))


def grams_sql(name: str) -> str:
    clean = f"lower(split_part({name}, '!', -1))"
    return (f"CASE WHEN length({clean}) < 3 THEN [{clean}] ELSE list_distinct(list_transform("
            f"range(1, length({clean}) - 1), lambda i: substr({clean}, i, 3))) END")


NAME_BUCKETS = f"""
SELECT DISTINCT name, unnest({buckets_sql('gram')}) AS bucket
FROM (SELECT DISTINCT name, unnest({grams_sql('name')}) AS gram FROM {{nodes}}) x"""


@query("name_ngrams", """
SELECT n.graph_id, n.id, string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY bucket) AS buckets
FROM {nodes} n JOIN {nb} ON n.name = nb.name GROUP BY n.graph_id, n.id""", {"nb": NAME_BUCKETS})
def _(t):
    return t("nodes").select("graph_id", "id", F.array_join(
        F.array_sort(features.name_buckets(F.col("name"))), ",").alias("buckets"))


FLOW = "etype IN ('FLOWS_TO', 'CALLS', 'REACHES')"
DEGREES = {"dg": """
SELECT graph_id, id, count(*) FILTER (WHERE side = 'in') AS in_degree,
       count(*) FILTER (WHERE side = 'out') AS out_degree, """ + ", ".join(
    f"count(*) FILTER (WHERE side = '{s}' AND etype = '{e}') AS {s}_{i}"
    for s in ("in", "out") for i, e in enumerate(rules.EDGE_TYPES)) + """
FROM (SELECT graph_id, src AS id, 'out' AS side, etype FROM {edges}
      UNION ALL SELECT graph_id, dst, 'in', etype FROM {edges}) x GROUP BY graph_id, id"""}


@query("degrees", "SELECT * FROM {dg}", DEGREES)
def _(t):
    return features.degrees(t("edges"))


@query("degree_features", """
SELECT graph_id, id, round(ln(1 + in_degree) / 5, 6) AS in_degree, round(ln(1 + out_degree) / 5, 6) AS out_degree,
       round(ln(1 + in_degree + out_degree) / 5, 6) AS both_degree, round(ln(1 + in_4) / 5, 6) AS calls_in
FROM {dg}""", DEGREES)
def _(t):
    out = features.degree_features(t("edges"))
    return out.select("graph_id", "id", *[F.round(c, 6).alias(c) for c in (
        "in_degree", "out_degree", "both_degree")], F.round("in_4", 6).alias("calls_in"))


MAPPED = {"nn": """
SELECT n.*, coalesce(num, 0) AS num_instructions FROM {nodes} n LEFT JOIN (
  SELECT graph_id, id, CAST(sum(n) AS BIGINT) AS num FROM {inst_counts} GROUP BY graph_id, id) c
  ON c.graph_id = n.graph_id AND c.id = n.id"""}
METRICS = MAPPED | {"mm": f"""
SELECT e.graph_id, src AS id, count(*) FILTER (WHERE etype = 'FLOWS_TO' AND b.type = 'BLOCK') AS blocks,
       CAST(coalesce(sum(b.num_instructions) FILTER (WHERE etype = 'FLOWS_TO' AND b.type = 'BLOCK'), 0) AS BIGINT)
           AS instructions,
       count(*) FILTER (WHERE etype = 'CALLS') AS call_out,
       count(*) FILTER (WHERE etype = 'CALLS' AND b.is_external) AS api_calls,
       CASE WHEN count(*) FILTER (WHERE etype = 'FLOWS_TO' AND b.type = 'BLOCK') = 0 THEN 0
            ELSE greatest(count(*) FILTER (WHERE {FLOW}) - count(*) FILTER (
                WHERE etype = 'FLOWS_TO' AND b.type = 'BLOCK') + 2, 1) END AS cyclomatic
FROM {{edges}} e JOIN {{nn}} a ON a.graph_id = e.graph_id AND a.id = src AND a.type = 'METHOD'
JOIN {{nn}} b ON b.graph_id = e.graph_id AND b.id = dst GROUP BY e.graph_id, src"""}


def _mapped_nodes(t):
    counts = t("inst_counts").groupBy("graph_id", "id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("inst_counts"),
        F.sum("n").alias("num_instructions"))
    return (t("nodes").join(counts, ["graph_id", "id"], "left")
            .withColumn("num_instructions", F.coalesce("num_instructions", F.lit(0))))


@query("method_metrics", "SELECT * FROM {mm}", METRICS)
def _(t):
    return features.method_metrics(_mapped_nodes(t), t("edges"))


BLOCK_METRICS = {"bm": """
SELECT graph_id, id, least(abs(sum(n / t * log2(n / t))) / 4, 1) AS entropy,
       coalesce(sum(n) FILTER (WHERE key IN ('BRANCH', 'CBRANCH', 'RETURN')), 0) / any_value(t) AS jumps,
       coalesce(sum(n) FILTER (WHERE key IN ('LOAD', 'STORE')), 0) / any_value(t) AS memory,
       coalesce(sum(n) FILTER (WHERE key = 'CALL'), 0) / any_value(t) AS calls,
       least(any_value(t) / 50, 1) AS size
FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY graph_id, id) AS DOUBLE) AS t FROM {inst_counts}) x
GROUP BY graph_id, id"""}


@query("block_metrics", """
SELECT n.graph_id, n.id, round(coalesce(entropy, 0), 6) AS entropy, round(coalesce(jumps, 0), 6) AS jumps,
       round(coalesce(memory, 0), 6) AS memory, round(coalesce(calls, 0), 6) AS calls,
       round(coalesce(size, 0), 6) AS size
FROM {nodes} n LEFT JOIN {bm} b ON b.graph_id = n.graph_id AND b.id = n.id WHERE type = 'BLOCK'""",
       BLOCK_METRICS)
def _(t):
    out = features.block_metrics(_mapped_nodes(t))
    return out.select("graph_id", "id", *[F.round(c, 6).alias(c) for c in (
        "entropy", "jumps", "memory", "calls", "size")])


SLOT_KEYS = {"sk": values("key, slot", [
    (k, rules.SLOTS["composition"] + i) for i, k in enumerate(rules.COMPOSITION_KEYS)])}


@query("composition_slots", """
SELECT graph_id, id AS block, slot, least(CAST(n AS DOUBLE) / 10, 1) AS value
FROM {inst_counts} c JOIN {sk} s ON c.key = s.key""", SLOT_KEYS)
def _(t):
    return features.composition_slots(t("inst_counts").withColumnRenamed("id", "block"))


SUSPECTS = {"sus": f"""
SELECT graph_id, id, lower(split_part(name, '!', -1)) AS api FROM {{nodes}}
WHERE type = 'METHOD' AND is_external AND lower(split_part(name, '!', -1)) IN (
    {', '.join(literal(a) for a in rules.SUSPICIOUS_API_NAMES)})""",
    "prints": f"""
SELECT DISTINCT graph_id, id, unnest({buckets_sql('api')}) AS bucket FROM (
  SELECT graph_id, id, api FROM {{sus}}
  UNION SELECT e.graph_id, src, api FROM {{edges}} e JOIN {{sus}} s ON s.graph_id = e.graph_id AND s.id = dst
  JOIN {{nodes}} n ON n.graph_id = e.graph_id AND n.id = src AND n.type = 'METHOD' WHERE etype = 'CALLS') x"""}


@query("suspicious_api_fingerprint", """
SELECT graph_id, id, string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY bucket) AS buckets
FROM {prints} GROUP BY graph_id, id""", SUSPECTS)
def _(t):
    return features.suspicious_api_fingerprint(t("nodes"), t("edges")).withColumn(
        "buckets", F.array_join("buckets", ","))


GLOBALS = {"bag": f"""
SELECT DISTINCT file_id, unnest({buckets_sql("v")}) AS bucket FROM (
  SELECT DISTINCT file_id, lower(split_part(value, '!', -1)) AS v FROM {{items}} WHERE kind = 'imports') x""",
    "gf": """
SELECT h.file_id, CASE machine WHEN 332 THEN 1e0 WHEN 34404 THEN 2 / 3e0 WHEN 448 THEN 1 / 3e0
       WHEN 43620 THEN 1 / 3e0 ELSE 0e0 END AS arch_code, least(subsystem / 10, 1) AS subsystem_code,
       CASE WHEN subsystem = 1 THEN 0.6e0 ELSE 0.1e0 END AS type_code,
       CASE WHEN timestamp > 0 THEN least(timestamp / 2e9, 1) ELSE 0e0 END AS time_code,
       ln(1 + coalesce(i, 0)) / 8 AS import_code, ln(1 + coalesce(s, 0)) / 9 AS string_code,
       ln(1 + coalesce(x, 0)) / 6 AS export_code
FROM {headers} h LEFT JOIN (SELECT file_id, count(*) FILTER (WHERE kind = 'imports') AS i,
    count(*) FILTER (WHERE kind = 'strings') AS s, count(*) FILTER (WHERE kind = 'exports') AS x
    FROM {items} GROUP BY file_id) c ON c.file_id = h.file_id"""}


def _global(t):
    from tracefold.operators.layout import decode_enums
    files = decode_enums(t("headers")).select(
        "file_id", "arch", "subsystem", "timestamp",
        F.when(F.col("subsystem") == 1, "sys").otherwise("zip").alias("file_type"))
    return features.global_features(files, t("items"))


@query("global_features", f"""
SELECT g.file_id, coalesce(b, '') AS buckets, {', '.join(f'round({c}, 6) AS {c}' for c in features.GLOBAL_SCALARS)}
FROM {{gf}} g LEFT JOIN (SELECT file_id, string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY bucket) AS b
    FROM {{bag}} GROUP BY file_id) x ON x.file_id = g.file_id""", GLOBALS)
def _(t):
    return _global(t).select("file_id", F.array_join("import_buckets", ",").alias("buckets"),
                             *[F.round(c, 6).alias(c) for c in features.GLOBAL_SCALARS])


FEATURE_ROWS = f"""
SELECT graph_id, id, k.slot AS slot, 1e0 AS v FROM {{nodes}} JOIN {{tk}} k ON type = k.t
UNION ALL SELECT graph_id, id, unnest([11, 12, 13, {', '.join(str(14 + i) for i in range(8))},
    {', '.join(str(22 + i) for i in range(8))}]), unnest(list_transform([in_degree, out_degree,
    in_degree + out_degree, {', '.join(f'in_{i}' for i in range(8))}, {', '.join(f'out_{i}' for i in range(8))}],
    lambda x: ln(1 + x) / 5)) FROM {{dg}} JOIN {{nodes}} USING (graph_id, id)
UNION ALL SELECT graph_id, id, 30, 1e0 FROM {{nodes}} WHERE is_external
UNION ALL SELECT graph_id, id, 31, least(line / 1000e0, 1) FROM {{nodes}} WHERE line > 0
UNION ALL SELECT graph_id, id, 32 + bucket, 1e0 FROM {{nodes}} JOIN {{nb}} USING (name)
UNION ALL SELECT c.graph_id, c.id, slot, least(CAST(n AS DOUBLE) / 10, 1) FROM {{inst_counts}} c
    JOIN {{sk}} s ON c.key = s.key WHERE slot NOT BETWEEN 136 AND 141
UNION ALL SELECT graph_id, id, unnest([132, 133, 134, 135]), unnest([least(cyclomatic / 30e0, 1), ln(1 + api_calls) / 5,
    ln(1 + instructions) / 8, ln(1 + blocks) / 5]) FROM {{mm}}
UNION ALL SELECT graph_id, id, 136, ln(1 + out_4) / 5 FROM {{dg}} JOIN {{nodes}} USING (graph_id, id)
    WHERE type IN ('METHOD', 'BLOCK')
UNION ALL SELECT graph_id, id, unnest([137, 138, 139, 140, 141]), unnest([entropy, jumps, memory, calls, size])
    FROM {{bm}} JOIN {{nodes}} USING (graph_id, id) WHERE type = 'BLOCK'
UNION ALL SELECT graph_id, id, 142 + bucket, 1e0 FROM {{prints}} JOIN {{nodes}} USING (graph_id, id)
UNION ALL SELECT graph_id, id, 210 + bucket, 1e0 FROM {{nodes}} JOIN {{bag}} ON bag.file_id = graph_id
UNION ALL SELECT graph_id, id, unnest([278, 279, 280, 281, 282, 283, 284]), unnest([{', '.join(features.GLOBAL_SCALARS)}])
    FROM {{nodes}} JOIN {{gf}} ON gf.file_id = graph_id"""


def _slot_sums(batches):
    """Number of slots that are not 0 and the sum of slot · place, added from left to right."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("features").flatten()
        rows = values.fill_null(0.0).to_numpy().reshape(batch.num_rows, -1)
        hollow = values.is_null().to_numpy(zero_copy_only=False).reshape(rows.shape).any(axis=1)
        sums = np.cumsum(rows * np.arange(1, rows.shape[1] + 1), axis=1)[:, -1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("graph_id"), batch.column("id"), pa.array((rows != 0).sum(axis=1), pa.int64()),
             pa.array(sums, pa.float64(), mask=hollow)], names=["graph_id", "id", "slots", "checksum"])


@query("node_features", """
SELECT graph_id, id, count(*) AS slots, round(sum(v * (slot + 1)), 3) AS checksum
FROM {fr} WHERE v <> 0 GROUP BY graph_id, id""", {
    "tk": values("t, slot", [(n, i) for i, n in enumerate(rules.NODE_TYPES)]),
    "nb": NAME_BUCKETS,
    "dg": DEGREES["dg"].replace("FROM {edges}", "FROM {edges} WHERE " + FLOW),
    **METRICS, **BLOCK_METRICS, **SLOT_KEYS, **SUSPECTS, **GLOBALS, "fr": FEATURE_ROWS})
def _(t):
    facts = _global(t).withColumnRenamed("file_id", "graph_id")
    out = features.node_features(_mapped_nodes(t), t("edges"), facts)
    return (out.select("graph_id", "id", "features")
            .mapInArrow(_slot_sums, "graph_id long, id long, slots long, checksum double")
            .withColumn("checksum", F.round("checksum", 3)))


# --- bytes ----------------------------------------------------------------------------------------

BLOCK_SUMS = """
SELECT file_id, CAST(floor(i / 256) AS BIGINT) AS blk, CAST(sum(b) AS BIGINT) AS s, count(*) AS c FROM (
  SELECT file_id, unnest(list_transform(regexp_extract_all(hex(content), '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b,
         unnest(range(octet_length(content))) AS i FROM {files}) x GROUP BY file_id, blk"""


@query("byte_chunk_means", """
SELECT file_id, CAST(blk AS INT) AS pos, round((s + coalesce(s2, 0)) / (c + coalesce(c2, 0)) / 255e0, 9) AS mean
FROM (SELECT *, lead(s) OVER (PARTITION BY file_id ORDER BY blk) AS s2,
             lead(c) OVER (PARTITION BY file_id ORDER BY blk) AS c2 FROM {bs}) x""", {"bs": BLOCK_SUMS})
def _(t):
    return features.byte_chunk_means(t("files")).withColumn("mean", F.round("mean", 9))


WIDTH = "CASE " + " ".join(f"WHEN n < {a} THEN {w}" for a, w in rules.PLOT_WIDTHS) + " ELSE 1024 END"


@query("byteplot_geometry", f"""
SELECT file_id, CAST(n AS INT) AS size, {WIDTH} AS width, CAST(ceil(n / {WIDTH}) AS INT) AS height
FROM (SELECT file_id, octet_length(content) AS n FROM {{files}}) x""")
def _(t):
    return features.byteplot_geometry(t("files"))


@query("byteplot_rows", f"""
SELECT file_id, CAST(r AS INT) AS row, rpad(substr(h, CAST(r * w * 2 + 1 AS BIGINT), w * 2), w * 2, '0') AS pixels FROM (
  SELECT file_id, h, w, unnest(range(CAST(ceil(n / w) AS BIGINT))) AS r FROM (
    SELECT file_id, hex(content) AS h, octet_length(content) AS n, {WIDTH} AS w
    FROM (SELECT *, octet_length(content) AS n FROM {{files}}) x) y) z""")
def _(t):
    return features.byteplot_rows(t("files")).select("file_id", "row", F.hex("pixels").alias("pixels"))


# --- attention and augmentation ----------------------------------------------------------------------

@query("segment_softmax", """
SELECT edge_id, graph_id, dst, round(e / (sum(e) OVER (PARTITION BY graph_id, dst) + 1e-12), 9) AS weight FROM (
  SELECT *, exp(score - greatest(max(score) OVER (PARTITION BY graph_id, dst), 0)) AS e FROM {attention}) x""")
def _(t):
    out = features.segment_softmax(t("attention"), ["graph_id", "dst"])
    return out.select("edge_id", "graph_id", "dst", F.round("weight", 9).alias("weight"))


@query("segment_softmax_plain", """
SELECT edge_id, round(e / (sum(e) OVER (PARTITION BY graph_id, dst) + 1e-8), 9) AS weight FROM (
  SELECT *, exp(score - max(score) OVER (PARTITION BY graph_id, dst)) AS e FROM {attention}) x""")
def _(t):
    out = features.segment_softmax(t("attention"), ["graph_id", "dst"], floor_zero=False)
    return out.select("edge_id", F.round("weight", 9).alias("weight"))


@query("weighted_pool", """
SELECT c_nationkey AS graph_id, i AS dim, round(sum(w * v), 5) AS value FROM (
  SELECT c_nationkey, c_custkey % 7 / 7e0 AS w, CAST(unnest(range(64)) AS INT) AS i,
         CAST(unnest(embedding) AS DOUBLE) AS v FROM {customer} JOIN {embeddings} ON vec_id = c_custkey % (SELECT count(*) FROM {embeddings})) x
GROUP BY c_nationkey, i""")
def _(t):
    n = t("embeddings").count()
    rows = t("customer").join(t("embeddings"), F.col("vec_id") == F.col("c_custkey") % n).select(
        F.col("c_nationkey").alias("graph_id"), (F.col("c_custkey") % 7 / F.lit(7.0)).alias("weight"),
        F.col("embedding").cast("array<double>").alias("vector"))
    return features.weighted_pool(rows, ["graph_id"]).withColumn("value", F.round("value", 5))


@query("drop_edges", """
SELECT graph_id, src, dst, etype FROM {edges}
WHERE CAST('0x' || substr(md5('42:' || graph_id || ':' || src || ':' || dst || ':' || etype), 1, 8) AS BIGINT)
      / 4294967296e0 >= 0.2""")
def _(t):
    return features.drop_edges(t("edges"), 0.2)


@query("mask_features", """
SELECT node_id, dim, CASE WHEN CAST('0x' || substr(md5('42:' || node_id || ':' || dim), 1, 8) AS BIGINT)
       / 4294967296e0 >= 0.3 THEN value ELSE 0 END AS value FROM {features_rows}""")
def _(t):
    return features.mask_features(t("features_rows"), 0.3)


# --- containers -----------------------------------------------------------------------------------------

def expansion_sql(levels: int = 12) -> dict[str, str]:
    """Levels of the queue as chained tables; there are more than the deepest one needs."""
    seen, out = [], {}
    for i in range(levels):
        if i == 0:
            queue = "SELECT root_id, item_id, hash, is_container, 0 AS par, 0 AS seq FROM {roots}"
        else:
            queue = f"""SELECT n.root_id, m.item_id, m.hash, m.is_container, n.position AS par, m.member_seq AS seq
                FROM {{n{i - 1}}} n JOIN {{members}} m ON m.container_id = n.item_id WHERE n.is_container"""
        before = ("0" if not seen else "coalesce((SELECT sum(c) FROM (" + " UNION ALL ".join(
            f"SELECT count(*) AS c FROM {{l{j}}} b WHERE b.root_id = q.root_id" for j in range(i)) + ")), 0)")
        out[f"l{i}"] = f"""SELECT * FROM (SELECT root_id, item_id, hash, is_container, {i} AS depth,
            row_number() OVER (PARTITION BY root_id ORDER BY par, seq, item_id) + {before} AS position
            FROM ({queue}) q) x"""
        known = "".join(f" AND NOT EXISTS (SELECT 1 FROM {{n{j}}} o WHERE o.root_id = l.root_id AND o.hash = l.hash)"
                        for j in seen)
        out[f"n{i}"] = f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY root_id, hash ORDER BY position) AS rn FROM {{l{i}}} l WHERE TRUE{known}) y WHERE rn = 1"""
        seen.append(i)
    out["found"] = " UNION ALL ".join(f"SELECT * FROM {{n{i}}}" for i in range(levels))
    out["used"] = "SELECT root_id, count(*) AS total FROM (" + " UNION ALL ".join(
        f"SELECT root_id FROM {{l{i}}}" for i in range(levels)) + ") z GROUP BY root_id"
    return out


@query("expand_containers", """
SELECT f.root_id, depth, CAST(position AS BIGINT) AS position, item_id, hash, is_container,
       total AS total_processed FROM {found} f JOIN {used} u ON f.root_id = u.root_id""", expansion_sql())
def _(t):
    return lineage.expand_containers(t("roots"), t("members"))


@query("container_summary", """
SELECT f.root_id, count(*) FILTER (WHERE NOT is_container) AS contained_files, any_value(total) AS total_processed,
       coalesce(list_reduce(list_concat([0::BIGINT], array_agg(item_id) FILTER (WHERE NOT is_container)),
                lambda a, b: a + b), 0) AS leaf_sum
FROM {found} f JOIN {used} u ON f.root_id = u.root_id GROUP BY f.root_id""", expansion_sql())
def _(t):
    expanded = lineage.expand_containers(t("roots"), t("members"))
    summary = lineage.container_summary(expanded).select("root_id", "contained_files", "total_processed")
    leaves = lineage.leaves(expanded).groupBy("root_id").agg(F.sum("item_id").alias("_sum"))
    return summary.join(leaves, "root_id", "left").select(
        "root_id", "contained_files", "total_processed", F.coalesce("_sum", F.lit(0)).alias("leaf_sum"))
