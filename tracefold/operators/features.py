"""Graph, byte and file features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold import rules
from tracefold.functions.hashing import bucket_columns, buckets_of, clean_api, name_ngrams
from tracefold.functions.literals import first_match, lookup
from tracefold.operators import content
from tracefold.sources.chunks import chunked

SCALE = 5.0


def log_scaled(count: Column, scale: float = SCALE) -> Column:
    return F.log1p(count) / scale


#: First bucket of each number that holds 64 buckets as bits.
LOWS = range(0, rules.HASH_BUCKETS, 64)


def bucket_bit(bucket: Column, low: int) -> Column:
    """The bit of a bucket in the number that starts at ``low``; 0 when it lies in another."""
    return F.when(bucket.between(low, low + 63), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (bucket - low).cast("int"))).otherwise(0)


def bucket_masks(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Hash buckets of a text over each key, as bits of the numbers ``_m0`` and ``_m64``.

    They are combined before the shuffle, so a hot key costs no more than another.
    """
    def mask(low: int) -> Column:
        bits = [bucket_bit(F.col(b), low) for b in ("_b0", "_b1", "_b2")]
        return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])

    masks = bucket_columns(df, keys, text).select(
        *keys, *[mask(low).alias(f"_m{low}") for low in LOWS])
    return masks.groupBy(*keys).agg(*[F.bit_or(f"_m{low}").alias(f"_m{low}") for low in LOWS])


def mask_buckets(prefix: str) -> Column:
    """Sorted list of the buckets held as bits; missing numbers have none."""
    return F.concat(*[F.filter(
        F.sequence(F.lit(low).cast("bigint"),
                   F.lit(min(low + 63, rules.HASH_BUCKETS - 1)).cast("bigint")),
        lambda i: F.getbit(F.col(f"{prefix}{low}"), (i - low).cast("int")) == 1) for low in LOWS])


def collect_buckets(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Distinct hash buckets of a text over each key."""
    return bucket_masks(df, keys, text).select(*keys, mask_buckets("_m").alias("buckets"))


def mask_columns(buckets: Column, prefix: str) -> list[Column]:
    """A list of buckets as the numbers ``prefix0`` and ``prefix64``."""
    return [F.aggregate(buckets, F.lit(0).cast("bigint"),
                        lambda held, b: held.bitwiseOR(bucket_bit(b, low))).alias(f"{prefix}{low}")
            for low in LOWS]


def mask_slots(prefix: str) -> list[Column]:
    """0 or 1 for each of the 68 buckets held as bits; missing numbers have none."""
    return [F.coalesce(F.getbit(F.col(f"{prefix}{i // 64 * 64}"), F.lit(i % 64)), F.lit(0))
            for i in range(rules.HASH_BUCKETS)]


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and per-type degrees of every node with edges.

    Each edge gives one row per end, so one aggregate covers all counts.
    """
    ends = edges.select("graph_id", "etype", F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit("out").alias("side")),
        F.struct(F.col("dst").alias("id"), F.lit("in").alias("side")))).alias("_e"))
    flat = ends.select("graph_id", "_e.id", "_e.side", "etype")
    per_type = [F.count_if((F.col("side") == side) & (F.col("etype") == etype))
                .alias(f"{side}_{i}")
                for side in ("in", "out") for i, etype in enumerate(rules.EDGE_TYPES)]
    return flat.groupBy("graph_id", "id").agg(
        F.count_if(F.col("side") == "in").alias("in_degree"),
        F.count_if(F.col("side") == "out").alias("out_degree"), *per_type)


def degree_features(edges: DataFrame) -> DataFrame:
    counts = degrees(edges)
    return counts.select("graph_id", "id", *[
        log_scaled(F.col(c)).alias(c) for c in counts.columns if c not in ("graph_id", "id")],
        log_scaled(F.col("in_degree") + F.col("out_degree")).alias("both_degree"))


def method_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks, instructions, calls and cyclomatic complexity per METHOD."""
    ends = lambda end: nodes.select(
        "graph_id", F.col("id").alias(end), F.col("type").alias(f"{end}_type"),
        F.col("is_external").alias(f"{end}_external"),
        F.col("num_instructions").alias(f"{end}_size"))
    wide = (edges.join(ends("src").where(F.col("src_type") == "METHOD"), ["graph_id", "src"])
            .join(ends("dst"), ["graph_id", "dst"]))
    body = (F.col("etype") == rules.EDGE_CFG) & (F.col("dst_type") == "BLOCK")
    call = F.col("etype") == rules.EDGE_CALLS
    facts = wide.groupBy("graph_id", F.col("src").alias("id")).agg(
        F.count_if(body).alias("blocks"),
        F.coalesce(F.sum(F.when(body, F.col("dst_size"))), F.lit(0)).alias("instructions"),
        F.count_if(call).alias("call_out"),
        F.count_if(call & F.col("dst_external")).alias("api_calls"),
        F.count_if(F.col("etype").isin(rules.EDGE_CFG, rules.EDGE_CALLS, rules.EDGE_DATA))
        .alias("_out"))
    cyclomatic = F.when(F.col("blocks") > 0, F.greatest(
        F.col("_out") - F.col("blocks") + 2, F.lit(1))).otherwise(0)
    return facts.select("graph_id", "id", "blocks", "instructions", "call_out", "api_calls",
                        cyclomatic.alias("cyclomatic"))


def method_features(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "graph_id", "id", F.least(F.col("cyclomatic") / 30.0, F.lit(1.0)).alias("cyclomatic"),
        log_scaled(F.col("api_calls")).alias("api_calls"),
        log_scaled(F.col("instructions"), 8.0).alias("instructions"),
        log_scaled(F.col("blocks")).alias("blocks"),
        log_scaled(F.col("call_out")).alias("call_out"))


def map_total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, v: a + v)


def block_metric_columns(counts: Column, num_instructions: Column) -> dict[str, Column]:
    """Entropy, ratios and size of a block from its instruction-count map."""
    counts = F.coalesce(counts, F.create_map().cast("map<string,bigint>"))
    total = F.greatest(map_total(counts), F.lit(1))
    entropy = F.aggregate(
        F.filter(F.map_values(counts), lambda v: v > 0), F.lit(0.0),
        lambda a, v: a - v / total * F.log2(v / total))
    of = lambda *names: sum((F.coalesce(F.try_element_at(counts, F.lit(n)), F.lit(0))
                             for n in names), F.lit(0)) / total
    return {"entropy": F.least(entropy / 4.0, F.lit(1.0)),
            "jumps": of("BRANCH", "CBRANCH", "RETURN"),
            "memory": of("LOAD", "STORE"),
            "calls": of("CALL"),
            "size": F.least(F.coalesce(num_instructions, total) / 50.0, F.lit(1.0))}


def block_metrics(nodes: DataFrame) -> DataFrame:
    columns = block_metric_columns(F.col("inst_counts"), F.col("num_instructions"))
    return nodes.where(F.col("type") == "BLOCK").select(
        "graph_id", "id", *[c.alias(n) for n, c in columns.items()])


def composition_slots(composition: DataFrame) -> DataFrame:
    """(graph_id, block, slot, value) of the known instruction keys.

    There are 44 keys for 32 slots: the last twelve run into slots 132–143.
    """
    slots = {k: rules.SLOTS["composition"] + i for i, k in enumerate(rules.COMPOSITION_KEYS)}
    return (composition.withColumn("slot", lookup(F.col("key"), slots))
            .where(F.col("slot").isNotNull())
            .select("graph_id", "block", "slot",
                    F.least(F.col("n") / 10.0, F.lit(1.0)).alias("value")))


def multi_hash(texts: DataFrame) -> DataFrame:
    """Distinct buckets (md5, sha1, polynomial) of each text."""
    return texts.select("text_id", F.explode(buckets_of(F.col("text"))).alias("bucket"))


def name_buckets(name: Column) -> Column:
    """Buckets of the 3-grams of a cleaned name; an empty name has none."""
    grams = F.array_distinct(F.flatten(F.transform(name_ngrams(name), lambda gram: buckets_of(gram))))
    return F.when(F.coalesce(name, F.lit("")) != "", grams).otherwise(
        F.array().cast("array<bigint>"))


def is_suspicious_api(name: Column) -> Column:
    return F.coalesce(clean_api(name).isin(rules.SUSPICIOUS_API_NAMES), F.lit(False))


def suspicious_apis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, id, api) of suspicious external APIs, at the caller and at the API itself."""
    bad = nodes.where((F.col("type") == "METHOD") & F.col("is_external")
                      & is_suspicious_api(F.col("name"))).select(
        "graph_id", F.col("id").alias("dst"), clean_api(F.col("name")).alias("api"))
    callers = (edges.where(F.col("etype") == rules.EDGE_CALLS).join(bad, ["graph_id", "dst"])
               .join(nodes.where(F.col("type") == "METHOD")
                     .select("graph_id", F.col("id").alias("src")), ["graph_id", "src"])
               .select("graph_id", F.col("src").alias("id"), "api"))
    own = bad.select("graph_id", F.col("dst").alias("id"), "api")
    return callers.unionByName(own).distinct().where(F.col("api") != "")


def suspicious_api_fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Buckets of suspicious external APIs, at the caller and at the API itself."""
    return collect_buckets(suspicious_apis(nodes, edges), ["graph_id", "id"], F.col("api"))


IMPORT_BITS = [f"import_bits{low}" for low in LOWS]


def global_features(files: DataFrame, items: DataFrame) -> DataFrame:
    """Import bag and metadata scalars per file.

    ``files`` has arch, subsystem, file_type and timestamp; ``items`` holds the
    capped imports, exports and strings as (file_id, kind, pos, value).  The bag is
    given as a list and as the bits it is made of.
    """
    clean = clean_api(F.col("value"))
    bag = bucket_masks(items.where((F.col("kind") == "imports") & (clean != "")),
                       ["file_id"], clean)
    counts = items.groupBy("file_id").agg(*[
        F.count_if(F.col("kind") == kind).alias(f"_{kind}") for kind in rules.METADATA_KINDS])
    arch = F.lower(F.coalesce("arch", F.lit("")))
    arch_code = first_match([
        (F.contains(arch, F.lit("x86")) | (arch == "i386"), F.lit(1.0)),
        (F.contains(arch, F.lit("x64")) | F.contains(arch, F.lit("amd64")), F.lit(2.0 / 3.0)),
        (F.contains(arch, F.lit("arm")), F.lit(1.0 / 3.0))], F.lit(0.0))
    ts = F.coalesce("timestamp", F.lit(0))
    n = lambda kind: F.coalesce(F.col(f"_{kind}"), F.lit(0))
    return (files.join(counts, "file_id", "left").join(bag, "file_id", "left").select(
        "file_id",
        mask_buckets("_m").alias("import_buckets"), *[F.col(f"_m{low}").alias(m) for low, m in zip(LOWS, IMPORT_BITS)],
        arch_code.alias("arch_code"),
        F.least(F.coalesce("subsystem", F.lit(0)) / 10.0, F.lit(1.0)).alias("subsystem_code"),
        F.coalesce(lookup(F.lower(F.coalesce("file_type", F.lit(""))), rules.FILE_TYPE_CODES),
                   F.lit(rules.FILE_TYPE_CODE_DEFAULT)).alias("type_code"),
        F.when(ts > 0, F.least(ts / 2e9, F.lit(1.0))).otherwise(0.0).alias("time_code"),
        log_scaled(n("imports"), 8.0).alias("import_code"),
        log_scaled(n("strings"), 9.0).alias("string_code"),
        log_scaled(n("exports"), 6.0).alias("export_code")))


GLOBAL_SCALARS = ["arch_code", "subsystem_code", "type_code", "time_code", "import_code",
                  "string_code", "export_code"]


def node_features(nodes: DataFrame, edges: DataFrame, graph_facts: DataFrame) -> DataFrame:
    """The 320 feature slots of every node.

    Slots are built as pieces of one array per node row; only the aggregates by
    node and by graph are shuffled.  ``graph_facts`` comes from
    :func:`global_features` with ``graph_id`` as the key.

    Buckets travel as bits.  Names and graphs are joined first and nodes last, so the
    slots of a frequent name or a large graph are not built in one task.
    """
    key = ["graph_id", "id"]
    flow = edges.where(F.col("etype").isin(rules.EDGE_CFG, rules.EDGE_CALLS, rules.EDGE_DATA))
    metrics = method_metrics(nodes, flow).select(
        *key, "cyclomatic", "api_calls", "instructions", "blocks")
    print_ = bucket_masks(suspicious_apis(nodes, flow), key, F.col("api")).select(
        *key, *[F.col(f"_m{low}").alias(f"_bad{low}") for low in LOWS])
    # Names repeat across graphs, so every distinct name is hashed once.
    names = nodes.select("name").distinct().withColumn("_name", name_buckets(F.col("name"))).select(
        "name", *mask_columns(F.col("_name"), "_name"))
    facts = graph_facts.select("graph_id", *GLOBAL_SCALARS, *IMPORT_BITS)
    wide = (nodes.join(names, "name", "left").join(facts, "graph_id", "left")
            .join(degrees(flow), key, "left").join(metrics, key, "left").join(print_, key, "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    is_block, is_method = F.col("type") == "BLOCK", F.col("type") == "METHOD"
    counts = F.coalesce("inst_counts", F.create_map().cast("map<string,bigint>"))
    block = block_metric_columns(F.col("inst_counts"), F.col("num_instructions"))
    call_type = rules.EDGE_TYPES.index(rules.EDGE_CALLS)
    call_out = log_scaled(zero(f"out_{call_type}"))
    composition = [F.least(F.coalesce(F.try_element_at(counts, F.lit(k)), F.lit(0)) / 10.0,
                           F.lit(1.0)) for k in rules.COMPOSITION_KEYS]
    method_slots = [F.least(zero("cyclomatic") / 30.0, F.lit(1.0)),
                    log_scaled(zero("api_calls")), log_scaled(zero("instructions"), 8.0),
                    log_scaled(zero("blocks")), call_out] + [F.lit(0.0)] * 5
    # Slots 132–135 of a block keep spilled composition values, 136–141 are metrics
    # and the last two spilled values lie under the API fingerprint.
    block_slots = composition[32:36] + [call_out] + list(block.values())
    bad = mask_slots("_bad")
    piece = lambda columns: F.array(*[c.cast("double") for c in columns])
    bad_slots = F.when(is_block, piece(composition[42:44] + bad[2:])).otherwise(piece(bad))
    vector = F.concat(
        piece([(F.col("type") == t) for t in rules.NODE_TYPES]),
        piece([log_scaled(zero("in_degree")), log_scaled(zero("out_degree")),
               log_scaled(zero("in_degree") + zero("out_degree"))]),
        piece([log_scaled(zero(f"in_{i}")) for i in range(8)]),
        piece([log_scaled(zero(f"out_{i}")) for i in range(8)]),
        piece([F.coalesce("is_external", F.lit(False)),
               F.when(zero("line") > 0, F.least(F.col("line") / 1000.0, F.lit(1.0)))
               .otherwise(0.0)]),
        piece(mask_slots("_name")),
        F.when(is_block, piece(composition[:32])).otherwise(piece([F.lit(0.0)] * 32)),
        F.when(is_method, piece(method_slots)).when(is_block, piece(block_slots))
        .otherwise(piece([F.lit(0.0)] * 10)),
        bad_slots, piece(mask_slots("import_bits")),
        piece([zero(c) for c in GLOBAL_SCALARS]), piece([F.lit(0.0)] * 35))
    return wide.select("graph_id", "id", "type", vector.alias("features"))


# --- bytes ------------------------------------------------------------------------------

def byte_chunk_means(files: DataFrame) -> DataFrame:
    """Means of all overlapping 512-byte windows of a content table: (file_id, pos, mean) rows."""
    return content.byte_chunk_means(chunked(files))


def byteplot_geometry(files: DataFrame) -> DataFrame:
    """Width by size and the height that holds all bytes."""
    n = F.coalesce(F.octet_length("content"), F.lit(0))
    width = first_match([(n < limit, F.lit(w)) for limit, w in rules.PLOT_WIDTHS],
                        F.lit(rules.PLOT_WIDTH_MAX))
    return files.select("file_id", n.alias("size"), width.alias("width"),
                        F.ceil(n / width).cast("int").alias("height"))


def byteplot_rows(files: DataFrame) -> DataFrame:
    """Pixel rows of the byte plot; the last row is padded with zeros."""
    n = F.octet_length("content")
    width = first_match([(n < limit, F.lit(w)) for limit, w in rules.PLOT_WIDTHS],
                        F.lit(rules.PLOT_WIDTH_MAX))
    cells = F.transform(
        F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1),
        lambda r: F.substring(F.col("content"), r * width + 1, width))
    rows = files.where(n > 0).select("file_id", width.alias("width"),
                                     F.posexplode(cells).alias("row", "pixels"))
    return rows.select("file_id", "row", "width", F.expr(
        "rpad(pixels, width, X'00')").alias("pixels"))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def cache_key(path: Column) -> Column:
    return F.substring(F.md5(path.cast("binary")), 1, 16)


def dedupe_content(files: DataFrame, known: DataFrame | None = None,
                   scope: list[str] | None = None, order: str = "file_id") -> DataFrame:
    """First file of each content hash (per ``scope``), without known hashes.

    Content stays where it is: only hashes and keys are shuffled.  Files without
    content have no hash and stay.
    """
    scope = scope or []
    hashed = files.withColumn("sha256", content_hash(F.col("content"))).drop("content")
    keys = scope + ["sha256"]
    firsts = hashed.where("sha256 IS NOT NULL").groupBy(*keys).agg(F.min(order).alias("_first"))
    firsts = firsts.select("_first", *[F.col(k).alias(f"_k_{k}") for k in keys])
    met = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    kept = (hashed.join(firsts, met, "left")
            .where(F.col("sha256").isNull() | (F.col(order) == F.col("_first")))
            .drop("_first", *[f"_k_{k}" for k in keys]))
    if known is not None:
        kept = kept.join(known.select("sha256").distinct(), "sha256", "left_anti")
    return kept


# --- attention helpers --------------------------------------------------------------------

def segment_softmax(scores: DataFrame, keys: list[str], floor_zero: bool = True) -> DataFrame:
    """Softmax of ``score`` over each key, with the maximum subtracted.

    ``floor_zero`` keeps the maximum at zero or above and adds 1e-12 to the sum;
    the other form adds 1e-8.  Maximum and sum are aggregates joined back, so a
    hot key is never gathered into one task.
    """
    top = F.max("score")
    peak = scores.groupBy(*keys).agg(
        (F.greatest(top, F.lit(0.0)) if floor_zero else top).alias("_m"))
    shifted = scores.join(peak, keys).withColumn("_e", F.exp(F.col("score") - F.col("_m")))
    total = shifted.groupBy(*keys).agg(F.sum("_e").alias("_t"))
    eps = 1e-12 if floor_zero else 1e-8
    return (shifted.join(total, keys)
            .withColumn("weight", F.col("_e") / (F.col("_t") + eps)).drop("_m", "_e", "_t"))


def weighted_pool(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of weight · vector per key and dimension."""
    return (vectors.select(*keys, "weight", F.posexplode("vector").alias("dim", "value"))
            .groupBy(*keys, "dim").agg(F.sum(F.col("weight") * F.col("value")).alias("value")))


def unit_hash(seed: int, *parts: Column) -> Column:
    """Repeatable number in [0, 1) from a seed and key columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / (1 << 32)


def drop_edges(edges: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Keep edges whose seeded hash is at least ``rate``."""
    return edges.where(unit_hash(seed, F.col("graph_id"), F.col("src"), F.col("dst"),
                                 F.col("etype")) >= rate)


def mask_features(features: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    """Set feature values to zero where the seeded hash is below ``rate``."""
    return features.withColumn("value", F.when(
        unit_hash(seed, F.col("node_id"), F.col("dim")) >= rate, F.col("value")).otherwise(0.0))
