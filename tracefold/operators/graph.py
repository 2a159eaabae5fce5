"""Code property graphs as node and edge tables, and traversal over them.

Nodes are ``(graph_id, id, type, ...)`` and edges ``(graph_id, src, dst, etype)``.
Traversals work on all graphs and sources at once, one join per round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracefold import rules
from tracefold.functions.literals import first_match
from tracefold.operators.ordering import number_rows, running_total, text_pieces
from tracefold.operators.reaching import reaching_definitions  # noqa: F401
from tracefold.session import cut, cut_bucketed, shuffle_partitions, without

KEEP_PIECES = 8           # visited tables are compacted after this many rounds


# --- building --------------------------------------------------------------------------

def node_rows(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """METHOD and BLOCK rows with their order in the graph; external functions have no blocks."""
    methods = functions.select(
        "graph_id", "func", "func_seq", F.lit(None).cast("bigint").alias("block_id"),
        F.lit(-1).cast("bigint").alias("block_seq"), F.lit("METHOD").alias("type"),
        F.col("func").alias("name"),
        F.when(F.coalesce("signature", F.lit("")) != "", F.col("signature"))
        .otherwise(F.col("func")).alias("code"),
        F.col("address").alias("line"), "is_external")
    own = functions.where(~F.col("is_external")).select("graph_id", "func", "func_seq")
    return methods.unionByName(blocks.join(own, ["graph_id", "func"]).select(
        "graph_id", "func", "func_seq", "block_id", "block_seq", F.lit("BLOCK").alias("type"),
        F.concat(F.lit("block_"), F.col("block_id").cast("string")).alias("name"),
        F.lit("").alias("code"), F.col("start").alias("line"), F.lit(False).alias("is_external")))


def number_nodes(rows: DataFrame) -> DataFrame:
    """Dense ids per graph; a function comes before its blocks."""
    return number_rows(rows, ["func_seq", "block_seq"], ["graph_id"], "id").drop("func_seq", "block_seq")


def node_ids(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(graph_id, func, block_id, type, id) of every node: all that edges need."""
    return number_nodes(node_rows(functions, blocks).select(
        "graph_id", "func", "block_id", "type", "func_seq", "block_seq"))


def build_nodes(functions: DataFrame, blocks: DataFrame, instructions: DataFrame, texts: bool = False) -> DataFrame:
    """METHOD and BLOCK nodes with their facts; with ``texts`` the code of a block is its instruction texts.

    Instructions are shuffled once by block, into all shuffle partitions, and meet the nodes there.
    A text is one cell here; :func:`block_code` has it in pieces.
    """
    key = ["graph_id", "func", "block_id"]
    count = shuffle_partitions(instructions.sparkSession)
    text = F.when(F.coalesce("raw_text", F.lit("")) != "", F.struct("idx", "raw_text"))
    known = instructions.select(*key, "inst_type", "idx", "raw_text").dropna(subset=key)  # others meet no node
    facts = (known.repartition(count, *key).groupBy(*key, "inst_type")
             .agg(F.count(F.lit(1)).alias("n"), *[F.collect_list(text).alias("texts")] * texts).groupBy(*key)
             .agg(F.sum("n").alias("num_instructions"),  # a few instruction types per block
                  F.map_from_entries(F.collect_list(F.struct("inst_type", "n"))).alias("inst_counts"),
                  *[F.array_sort(F.flatten(F.collect_list("texts"))).alias("texts")] * texts))
    code = F.array_join(F.transform("texts", lambda e: e["raw_text"]), "\n")
    nodes = (number_nodes(node_rows(functions, blocks)).repartition(count, *key).join(facts, key, "left")
             .withColumn("num_instructions", F.coalesce("num_instructions", F.lit(0))))
    return nodes if not texts else nodes.withColumn("code", F.when(
        F.col("type") == "BLOCK", F.coalesce(code, F.lit(""))).otherwise(F.col("code"))).drop("texts")


def block_code(nodes: DataFrame, instructions: DataFrame, rows: int = 1024) -> DataFrame:
    """(graph_id, id, piece, code): instruction texts of every block in ordered pieces of lines."""
    text = F.when(F.coalesce("raw_text", F.lit("")) != "", F.col("raw_text"))
    key = ["graph_id", "func", "block_id"]
    pieces = text_pieces(instructions, key, "idx", text, "\n", rows)
    return nodes.where("type = 'BLOCK'").select(*key, "id").join(pieces, key).select(
        "graph_id", "id", "piece", F.col("text").alias("code"))


def explode_successors(blocks: DataFrame) -> DataFrame:
    """Successor rows from an array column."""
    return blocks.select("graph_id", "func", "block_id",
                         F.explode("successor_ids").alias("succ_id"))


def cfg_edges(functions: DataFrame, blocks: DataFrame, successors: DataFrame,
              nodes: DataFrame) -> DataFrame:
    """METHOD → entry block (else first block) and block → known successor."""
    ids = nodes.select("graph_id", "func", "block_id", "id")
    block_ids = ids.where(F.col("block_id").isNotNull())
    entry = functions.select("graph_id", "func", "entry_block_id")
    firsts = (blocks.join(entry, ["graph_id", "func"])
              .groupBy("graph_id", "func").agg(F.coalesce(
                  F.max(F.when(F.col("block_id") == F.col("entry_block_id"),
                               F.col("block_id"))),
                  F.min_by("block_id", "block_seq")).alias("block_id")))
    starts = (firsts.join(block_ids.withColumnRenamed("id", "dst"),
                          ["graph_id", "func", "block_id"])
              .join(ids.where(F.col("block_id").isNull())
                    .select("graph_id", "func", F.col("id").alias("src")), ["graph_id", "func"])
              .select("graph_id", "src", "dst"))
    flows = (successors.join(block_ids.withColumnRenamed("id", "src"),
                             ["graph_id", "func", "block_id"])
             .join(block_ids.select("graph_id", "func", F.col("block_id").alias("succ_id"),
                                    F.col("id").alias("dst")), ["graph_id", "func", "succ_id"])
             .select("graph_id", "src", "dst"))
    return starts.unionByName(flows).withColumn("etype", F.lit(rules.EDGE_CFG))


def call_edges(functions: DataFrame, listed: DataFrame, instructions: DataFrame,
               nodes: DataFrame) -> DataFrame:
    """Call edges by name: METHOD → METHOD as listed, BLOCK → METHOD per CALL.

    ``listed`` is (graph_id, func, callee).  A CALL instruction matches on the
    operand name, else the operand value, the whole text and its words; every
    match is an equi-join on the name.
    """
    method = nodes.where(F.col("type") == "METHOD").select("graph_id", F.col("func").alias("name"), "id")
    block = nodes.where(F.col("type") == "BLOCK").select(
        "graph_id", "func", "block_id", F.col("id").alias("src"))
    target = lambda name: method.select("graph_id", F.col("name").alias(name),
                                        F.col("id").alias("dst"))
    direct = (listed.join(target("callee"), ["graph_id", "callee"])
              .join(method.select("graph_id", F.col("name").alias("func"),
                                  F.col("id").alias("src")), ["graph_id", "func"])
              .select("graph_id", "src", "dst"))
    calls = instructions.where(F.col("inst_type") == "CALL")
    key = ["graph_id", "func", "block_id", "idx"]
    text = F.regexp_replace(F.coalesce("raw_text", F.lit("")), r"(?U)^\s+|\s+$", "")
    words = F.array_distinct(F.concat(F.array(text), F.split(text, r"(?U)\s+")))
    by_text = calls.select(*key, F.explode(words).alias("callee")).where(
        F.col("callee") != "").join(target("callee"), ["graph_id", "callee"])
    named = calls.join(method.select("graph_id", F.col("name").alias("operand_name"),
                                     F.col("id").alias("by_name")),
                       ["graph_id", "operand_name"], "left")
    by_operand = (named.join(method.select("graph_id", F.col("name").alias("operand_value"),
                                           F.col("id").alias("by_value")),
                             ["graph_id", "operand_value"], "left")
                  .withColumn("dst", F.coalesce("by_name", "by_value"))
                  .where(F.col("dst").isNotNull()))
    found = (by_text.select(*key, "dst").unionByName(by_operand.select(*key, "dst"))
             .dropDuplicates(key + ["dst"]))
    from_blocks = found.join(block, ["graph_id", "func", "block_id"]).select(
        "graph_id", "src", "dst")
    return direct.unionByName(from_blocks).withColumn("etype", F.lit(rules.EDGE_CALLS))


def def_use(operands: DataFrame) -> DataFrame:
    """Per block and variable: is it defined, and is it read before its definition.

    Inputs of an instruction are read before its outputs are written.
    """
    used = operands.where((F.coalesce("op_type", F.lit("")) != "constant")
                          & (F.coalesce("var", F.lit("")) != ""))
    facts = used.groupBy("graph_id", "func", "block_id", "var").agg(
        F.min(F.when(F.col("is_input"), F.col("idx"))).alias("_use"),
        F.min(F.when(F.col("is_output"), F.col("idx"))).alias("_def"))
    exposed = F.col("_use").isNotNull() & (
        F.col("_def").isNull() | (F.col("_use") <= F.col("_def")))
    return facts.select("graph_id", "func", "block_id", "var",
                        F.col("_def").isNotNull().alias("is_defined"),
                        exposed.alias("is_exposed"))


def predecessors(blocks: DataFrame, successors: DataFrame,
                 given: DataFrame | None = None) -> DataFrame:
    """Given predecessor rows; functions without any use inverted successors."""
    known = blocks.select("graph_id", "func", F.col("block_id").alias("succ_id"))
    inverted = (successors.join(known, ["graph_id", "func", "succ_id"], "left_semi")
                .select("graph_id", "func", F.col("succ_id").alias("block_id"),
                        F.col("block_id").alias("pred_id")).distinct())
    if given is None:
        return inverted
    return given.select("graph_id", "func", "block_id", "pred_id").unionByName(
        inverted.join(given.select("graph_id", "func").distinct(), ["graph_id", "func"],
                      "left_anti"))


def metadata_items(items: DataFrame) -> DataFrame:
    """Every import, export and string with its place in its kind and file."""
    return number_rows(items, ["pos", "value"], ["file_id", "kind"], "place")


# --- checks, filters, neighbours ------------------------------------------------------------

def invalid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a missing end."""
    ids = nodes.select("graph_id", "id").distinct()
    mark = lambda end: ids.select("graph_id", F.col("id").alias(end), F.lit(True).alias(f"_{end}"))
    return (edges.join(mark("src"), ["graph_id", "src"], "left")
            .join(mark("dst"), ["graph_id", "dst"], "left")
            .where(F.col("_src").isNull() | F.col("_dst").isNull())
            .select("graph_id", "src", "dst", "etype",
                    F.col("_src").isNull().alias("missing_src"),
                    F.col("_dst").isNull().alias("missing_dst")))


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return subgraph_edges(edges, nodes)


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return (nodes.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def nodes_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("type") == node_type)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, methods and calls per graph."""
    n = nodes.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("num_nodes"),
        F.count_if(F.col("type") == "METHOD").alias("num_methods"),
        F.count_if(F.col("type") == "CALL").alias("num_calls"))
    e = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("num_edges"))
    return n.join(e, "graph_id", "left").fillna(0, ["num_edges"])


def neighbours(nodes: DataFrame, edges: DataFrame, direction: str = "out",
               etype: str | None = None) -> DataFrame:
    """Edges with the type and name of the node at the far end."""
    if etype:
        edges = edges.where(F.col("etype") == etype)
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    ends = nodes.select("graph_id", F.col("id").alias(far),
                        F.col("type").alias("other_type"), F.col("name").alias("other_name"))
    return edges.join(ends, ["graph_id", far]).select(
        "graph_id", F.col(near).alias("id"), F.col(far).alias("other_id"), "etype",
        "other_type", "other_name")


def subgraph_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.select("graph_id", "id").distinct()
    side = lambda end: ids.withColumnRenamed("id", end)
    return (edges.join(side("src"), ["graph_id", "src"], "left_semi")
            .join(side("dst"), ["graph_id", "dst"], "left_semi"))


def subgraph(nodes: DataFrame, edges: DataFrame,
             kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The given nodes and the edges with both ends kept."""
    ids = kept.select("graph_id", "id").distinct()
    return (nodes.join(ids, ["graph_id", "id"], "left_semi"), subgraph_edges(edges, ids))


# --- merging --------------------------------------------------------------------------------

def merge_offsets(nodes: DataFrame, group: str) -> DataFrame:
    """First free id before each graph of a group, in graph order."""
    sizes = nodes.groupBy(group, "graph_id").agg((F.max("id") + 1).alias("_next"))
    return running_total(sizes, ["graph_id"], [group], {"id_offset": F.col("_next")}) \
        .drop("_next")


def merge_graphs(nodes: DataFrame, edges: DataFrame,
                 group: str) -> tuple[DataFrame, DataFrame]:
    """Graphs of a group in one id space, each shifted behind the earlier ones."""
    offsets = cut(merge_offsets(nodes, group))
    moved = nodes.join(offsets, [group, "graph_id"]).withColumn(
        "id", F.col("id") + F.col("id_offset")).drop("id_offset")
    by_graph = offsets.select(group, "graph_id", "id_offset")
    shifted = edges.join(by_graph, "graph_id").select(
        group, "graph_id", (F.col("src") + F.col("id_offset")).alias("src"),
        (F.col("dst") + F.col("id_offset")).alias("dst"), "etype")
    return moved, shifted


def collate_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All graphs in one dense id space, with the graph index of every node."""
    sizes = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    graphs = cut(running_total(sizes, ["graph_id"], None,
                               {"batch_index": F.lit(1), "_offset": F.col("_n")}))
    placed = cut(number_rows(nodes.select("graph_id", "id", "type"), ["id"], ["graph_id"],
                             "_pos").join(graphs, "graph_id")
                 .select("graph_id", "batch_index", "id", "type",
                         (F.col("_pos") + F.col("_offset")).alias("node_index")))
    end = lambda name: placed.select("graph_id", F.col("id").alias(name),
                                     F.col("node_index").alias(f"{name}_index"))
    joined = (edges.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
              .select("graph_id", "src_index", "dst_index", "etype"))
    return placed, joined


# --- traversal ----------------------------------------------------------------------------------

def bfs_reach(edges: DataFrame, sources: DataFrame, etype: str | None = None,
              directed: bool = True, max_rounds: int | None = None) -> DataFrame:
    """Nodes reachable from the sources with their distance.

    All graphs advance together; the loop ends with an empty frontier.  Edges and visited
    nodes lie in buckets by node, so a round shuffles the frontier and nothing else.
    """
    if etype:
        edges = edges.where(F.col("etype") == etype)
    links = edges.select("graph_id", F.col("src").alias("id"), F.col("dst").alias("next"))
    if not directed:
        links = links.unionByName(edges.select(
            "graph_id", F.col("dst").alias("id"), F.col("src").alias("next")))
    links = cut_bucketed(links, NODE)
    frontier = cut_bucketed(sources.select(*NODE).distinct().withColumn("distance", F.lit(0)), NODE)
    pieces, older, distance, rows = [frontier], [], 0, frontier.count()
    while rows and (max_rounds is None or distance < max_rounds):
        distance += 1
        step = reached_next(links, frontier)
        frontier = cut_bucketed(without(step, [*older, *pieces], NODE).withColumn("distance", F.lit(distance)), NODE)
        rows = frontier.count()
        if rows:
            pieces.append(frontier)
        if len(pieces) >= KEEP_PIECES:
            older, pieces = [cut_bucketed(reduce(DataFrame.unionByName, [*older, *pieces]), NODE)], []
    return reduce(DataFrame.unionByName, [*older, *pieces])


NODE = ["graph_id", "id"]


def reached_next(links: DataFrame, frontier: DataFrame, *carried: Column) -> DataFrame:
    """Distinct ends of the links of a frontier, or the least ``carried`` values per end."""
    found = links.join(frontier.hint("merge"), NODE)
    ends = found.groupBy("graph_id", F.col("next").alias("id"))
    return ends.agg(*carried) if carried else ends.agg(F.lit(1).alias("_one")).drop("_one")


def instruction_to_block(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Block of every node that can be reached from one: (graph_id, id, block).

    Blocks hold themselves, then AST children of blocks, then neighbours over all
    edges in both directions until nothing is added.  On ties the smallest block
    wins; the order of edges plays no role.  Buckets as in :func:`bfs_reach`.
    """
    frontier = cut_bucketed(nodes.where(F.col("type") == "BLOCK").select(
        "graph_id", "id", F.col("id").alias("block")), NODE)
    ends = lambda a, b, kept: kept.select("graph_id", F.col(a).alias("id"), F.col(b).alias("next"))
    children = ends("src", "dst", edges.where(F.col("etype") == rules.EDGE_AST))
    links = cut_bucketed(ends("src", "dst", edges).unionByName(ends("dst", "src", edges)), NODE)

    def step(over: DataFrame, start: DataFrame, placed: list[DataFrame]) -> DataFrame:
        found = reached_next(over, start, F.min("block").alias("block"))
        return cut_bucketed(without(found, placed, NODE), NODE)

    pieces = [frontier, step(children, frontier, [frontier])]
    # The first full round starts from all placed nodes.
    frontier = reduce(DataFrame.unionByName, pieces)
    rows = 1
    while rows:
        frontier = step(links, frontier, pieces)
        rows = frontier.count()
        if rows:
            pieces.append(frontier)
        if len(pieces) > KEEP_PIECES:
            pieces = [cut_bucketed(reduce(DataFrame.unionByName, pieces), NODE)]
    return reduce(DataFrame.unionByName, pieces)


def collapse_to_blocks(nodes: DataFrame, edges: DataFrame, placed: DataFrame,
                       zero_is_absent: bool = True) -> DataFrame:
    """Edges between blocks and methods, distinct and without self loops.

    ``zero_is_absent`` keeps the published behaviour that a block with id 0
    counts as no block.
    """
    ok = (lambda c: c.isNotNull() & (c != 0)) if zero_is_absent else (lambda c: c.isNotNull())
    block = lambda end: placed.select("graph_id", F.col("id").alias(end),
                                      F.col("block").alias(f"{end}_block"))
    kind = lambda end: nodes.select("graph_id", F.col("id").alias(end),
                                    F.col("type").alias(f"{end}_type"))
    wide = edges
    for end in ("src", "dst"):
        wide = (wide.join(kind(end), ["graph_id", end])
                .join(block(end), ["graph_id", end], "left"))
    sb, db, etype = F.col("src_block"), F.col("dst_block"), F.col("etype")
    from_method, to_method = F.col("src_type") == "METHOD", F.col("dst_type") == "METHOD"
    pair = lambda a, b, kind_: F.struct(a.alias("src"), b.alias("dst"), kind_.alias("etype"))
    flow = etype.isin(rules.EDGE_CFG, rules.EDGE_DATA) & ok(sb) & ok(db) & (sb != db)
    calls = etype == rules.EDGE_CALLS
    owns = (etype == rules.EDGE_AST) & from_method & (F.col("dst_type") == "BLOCK")
    new = first_match([
        (flow, pair(sb, db, etype)),
        (calls & from_method & to_method, pair(F.col("src"), F.col("dst"), etype)),
        (calls & ok(sb) & to_method, pair(sb, F.col("dst"), etype)),
        (owns, pair(F.col("src"), F.col("dst"), F.lit(rules.EDGE_CFG)))])
    return (wide.select("graph_id", new.alias("_e")).where(F.col("_e").isNotNull())
            .select("graph_id", "_e.*").distinct())


def block_composition(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Instruction counts per block by operator, else control, else node type."""
    key = F.coalesce("operator_type", "control_type", "type")
    return (nodes.where(~F.col("type").isin("BLOCK", "METHOD"))
            .join(placed, ["graph_id", "id"])
            .groupBy("graph_id", "block", key.alias("key"))
            .agg(F.count(F.lit(1)).alias("n")))


def rank_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its distance to a method and its place by it.

    Distances are undirected; a graph without methods starts from its first node,
    and unreached nodes follow in id order.
    """
    starts = nodes.groupBy("graph_id").agg(
        F.min("id").alias("_first"), F.bool_or(F.col("type") == "METHOD").alias("_has"))
    starts = (nodes.join(starts, "graph_id")
              .where(F.when(F.col("_has"), F.col("type") == "METHOD")
                     .otherwise(F.col("id") == F.col("_first"))).select("graph_id", "id"))
    distance = bfs_reach(edges, starts, directed=False)
    ranked = nodes.select("graph_id", "id").join(distance, ["graph_id", "id"], "left").select(
        "graph_id", "id", F.coalesce("distance", F.lit(2147483647)).alias("distance"))
    return number_rows(ranked, ["distance", "id"], ["graph_id"], "place")
