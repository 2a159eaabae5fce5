"""Graph documents and feature bundles.

A graph is stored as JSON records, one per node, edge and graph header, with
absent optional fields left out.  Records of one graph share ``graph_id``, so a
large graph is many rows rather than one document cell; ``graph_documents``
nests them in lists of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracefold.operators.ordering import running_total

PIECE_BYTES = 1 << 20

NODE_SCHEMA = ("id bigint, type string, name string, code string, line bigint, "
               "`order` bigint, signature string, is_external boolean, value string, "
               "value_type string, control_type string, operator_type string, "
               "attributes map<string,string>")
EDGE_SCHEMA = "source bigint, target bigint, type string, attributes map<string,string>"
HEADER_SCHEMA = "source_file string, file_type string, metadata map<string,string>"


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def node_json(nodes: DataFrame) -> Column:
    text = lambda n: F.nullif(_optional(nodes, n), F.lit(""))
    attributes = _optional(nodes, "attributes", "map<string,string>")
    value = _optional(nodes, "value")
    return F.to_json(F.struct(
        F.col("id"), F.col("type"), F.coalesce(_optional(nodes, "name"), F.lit("")).alias("name"),
        F.coalesce(_optional(nodes, "code"), F.lit("")).alias("code"),
        F.coalesce(_optional(nodes, "line", "bigint"), F.lit(0)).alias("line"),
        F.coalesce(_optional(nodes, "order", "bigint"), F.lit(0)).alias("order"),
        text("signature").alias("signature"),
        F.when(_optional(nodes, "is_external", "boolean"), F.lit(True)).alias("is_external"),
        value.alias("value"),
        F.when(value.isNotNull(), F.coalesce(_optional(nodes, "value_type"), F.lit("")))
        .alias("value_type"),
        text("control_type").alias("control_type"), text("operator_type").alias("operator_type"),
        F.when(F.size(attributes) > 0, attributes).alias("attributes")))


def edge_json(edges: DataFrame) -> Column:
    attributes = _optional(edges, "attributes", "map<string,string>")
    return F.to_json(F.struct(
        F.col("src").alias("source"), F.col("dst").alias("target"), F.col("etype").alias("type"),
        F.when(F.size(attributes) > 0, attributes).alias("attributes")))


def graph_records(nodes: DataFrame, edges: DataFrame,
                  graphs: DataFrame | None = None) -> DataFrame:
    """(graph_id, part, json) with part ``node``, ``edge`` or ``graph``."""
    rows = nodes.select("graph_id", F.lit("node").alias("part"), node_json(nodes).alias("json")) \
        .unionByName(edges.select("graph_id", F.lit("edge").alias("part"),
                                  edge_json(edges).alias("json")))
    if graphs is not None:
        rows = rows.unionByName(graphs.select("graph_id", F.lit("graph").alias("part"), F.to_json(
            F.struct("source_file", "file_type", "metadata")).alias("json")))
    return rows


def graph_write(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    records.write.mode(mode).partitionBy("part").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("graph_id bigint, json string, part string").parquet(path)


def graph_read(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables; absent fields get their defaults."""
    node = F.from_json("json", NODE_SCHEMA)
    nodes = (records.where(F.col("part") == "node").select("graph_id", node.alias("n"))
             .select("graph_id", "n.*")
             .fillna({"name": "", "code": "", "line": 0, "order": 0, "is_external": False}))
    edges = (records.where(F.col("part") == "edge")
             .select("graph_id", F.from_json("json", EDGE_SCHEMA).alias("e"))
             .select("graph_id", F.col("e.source").alias("src"), F.col("e.target").alias("dst"),
                     F.col("e.type").alias("etype"), "e.attributes"))
    return nodes, edges


def graph_documents(records: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(graph_id, part, piece, document): every graph as JSON lists of its records.

    The records of a part are ordered by their text and start a new list every
    ``piece_bytes`` bytes, so a cell is bounded by that and one record, whatever the
    size of the graph.  ``piece`` ascends in that order and skips numbers after a
    record that is longer than a piece.
    """
    size = F.octet_length("json") + 1
    placed = running_total(records.withColumn("_copy", F.monotonically_increasing_id()),
                           ["json", "_copy"], ["graph_id", "part"], {"_before": size})
    piece = F.floor(F.col("_before") / piece_bytes).alias("piece")
    return placed.groupBy("graph_id", "part", piece).agg(F.concat(
        F.lit("["), F.array_join(F.array_sort(F.collect_list("json")), ","), F.lit("]"))
        .alias("document"))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Records of the pieces, the reverse of :func:`graph_documents`."""
    def part(kind: str, schema: str) -> DataFrame:
        parsed = F.from_json("document", f"array<struct<{_fields(schema)}>>")
        return (documents.where(F.col("part") == kind)
                .select("graph_id", "part", F.explode(parsed).alias("r"))
                .select("graph_id", "part", F.to_json("r").alias("json")))
    return (part("node", NODE_SCHEMA).unionByName(part("edge", EDGE_SCHEMA))
            .unionByName(part("graph", HEADER_SCHEMA)))


def _fields(schema: str) -> str:
    """``name type`` pairs written as ``name:type`` for a nested struct."""
    depth, out, current = 0, [], ""
    for char in schema:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += char
    return ", ".join(f.strip().replace(" ", ":", 1) for f in out + [current])


# --- feature bundles -------------------------------------------------------------------

def with_feature_defaults(features: DataFrame, byte_len: int = 1024, api_len: int = 256,
                          node_dim: int = 320) -> DataFrame:
    """Missing parts of a feature bundle become zeros, a missing label 0."""
    def part(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(_optional(features, name, kind), default).alias(name)
    return features.select(
        "file_id",
        part("node_mean", "array<double>", F.array_repeat(F.lit(0.0), node_dim)),
        part("byte_means", "array<double>", F.array_repeat(F.lit(0.0), byte_len)),
        part("api_tokens", "array<int>", F.array_repeat(F.lit(0), api_len)),
        part("label", "int", F.lit(0)))


def feature_read(spark: SparkSession, path: str) -> DataFrame:
    return with_feature_defaults(spark.read.parquet(path))
