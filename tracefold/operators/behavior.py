"""Import, export, instruction and opcode rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracefold import rules
from tracefold.functions.bytes import (hex_address, little_endian_signed,
                                       opcode_positions)
from tracefold.functions.literals import lookup, present
from tracefold.operators.layout import explode_findings, finding
from tracefold.operators.ordering import fill_forward, ordered_md5
from tracefold.session import among, cut


def behavior_of(func: Column) -> Column:
    """Behaviour categories of an API name (exact case), as an array."""
    return present([F.when(func.isin(names), F.lit(category))
                    for category, names in rules.BEHAVIOR_APIS.items()])


def classify_imports(imports: DataFrame) -> DataFrame:
    """One row per (import, behaviour category)."""
    return imports.select("*", F.explode(behavior_of(F.col("func"))).alias("category"))


def import_label() -> Column:
    return F.concat("dll", F.lit("!"), "func",
                    F.when(F.col("delayed"), " (delayed)").otherwise(""))


def category_hit_labels(imports: DataFrame) -> DataFrame:
    """Labels of the hits behind :func:`category_hits`, one row per hit."""
    return classify_imports(imports).select("file_id", "category", "delayed", "seq",
                                            import_label().alias("label"))


def category_hits(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Hit count of every behaviour category for every file, zero included.

    The seven categories are columns of one aggregate, so files without hits
    need no category grid, and no list of hits is gathered into one row.
    """
    func = F.col("func")
    facts = imports.groupBy("file_id").agg(*[
        F.count_if(func.isin(names)).alias(category)
        for category, names in rules.BEHAVIOR_APIS.items()])
    counts = F.array(*[F.struct(F.lit(c).alias("category"),
                                F.coalesce(F.col(c), F.lit(0)).alias("hit_count"))
                       for c in rules.BEHAVIOR_APIS])
    return (files.select("file_id").join(facts, "file_id", "left")
            .select("file_id", F.explode(counts).alias("_r"))
            .select("file_id", "_r.category", "_r.hit_count"))


def suspicious_apis(imports: DataFrame) -> DataFrame:
    """Imports with any behaviour category, and the category list."""
    return (imports.withColumn("categories", behavior_of(F.col("func")))
            .where(F.size("categories") > 0)
            .select("file_id", "seq", "dll", "func", "delayed", "categories"))


def import_totals(files: DataFrame, imports: DataFrame) -> DataFrame:
    """DLL entries (normal and delayed apart) and functions, ordinals included."""
    facts = imports.groupBy("file_id").agg(
        F.countDistinct("dll", "delayed").alias("_dlls"),
        F.count(F.lit(1)).alias("_funcs"))
    return (files.select("file_id").join(facts, "file_id", "left")
            .select("file_id", F.coalesce("_dlls", F.lit(0)).alias("total_dlls"),
                    F.coalesce("_funcs", F.lit(0)).alias("total_functions")))


def imphash(imports: DataFrame) -> DataFrame:
    """MD5 of the ordered, comma-joined ``dll.func`` list of each file."""
    base = F.regexp_replace(F.lower("dll"), r"\.(dll|ocx|sys)$", "")
    func = F.coalesce(F.lower("func"), F.concat(F.lit("ord"), F.col("ordinal").cast("string")))
    return ordered_md5(imports.where(~F.col("delayed")), "file_id", "seq",
                       F.concat(base, F.lit("."), func), ",", "imphash")


def suspicious_exports(exports: DataFrame) -> DataFrame:
    name = F.col("name")
    return (exports.where(name.isin(rules.SUSPICIOUS_EXPORTS))
            .select("file_id", "seq", "name", "ordinal",
                    F.concat(F.lit("'"), name, F.lit("' is a known suspicious export name"))
                    .alias("reason")))


def dll_intent(exports: DataFrame) -> DataFrame:
    name = F.col("name")
    facts = exports.groupBy("file_id").agg(
        *[F.bool_or(F.coalesce(name.isin(markers), F.lit(False))).alias(f"_{intent}")
          for intent, markers in rules.EXPORT_INTENTS],
        F.count_if(name.isNull()).alias("ordinal_only"),
        F.count(F.lit(1)).alias("total_exports"))
    proxy = ((F.col("ordinal_only") > rules.PROXY_MIN_ORDINALS)
             & (F.col("ordinal_only") > F.col("total_exports") * rules.PROXY_MIN_SHARE))
    found = present([F.when(F.col(f"_{intent}"), F.lit(intent))
                     for intent, _ in rules.EXPORT_INTENTS]
                    + [F.when(proxy, F.lit("proxy_dll"))])
    return facts.select("file_id", "total_exports", "ordinal_only",
                        F.when(F.size(found) > 0, found)
                        .otherwise(F.array(F.lit("generic_library"))).alias("dll_intent"))


def behavior_chains(imports: DataFrame) -> DataFrame:
    """Behaviour chains of which at least 60 % of the steps are imported.

    A step is matched when it occurs inside an imported name; of several
    matching names the smallest is reported.
    """
    api = F.when(F.col("address").isNotNull() & ~F.col("delayed"), F.col("func"))
    steps = sorted({s for _, _, chain in rules.BEHAVIOR_CHAINS for s in chain})
    facts = imports.groupBy("file_id").agg(*[
        F.min(F.when(F.contains(api, F.lit(step)), api)).alias(step) for step in steps])

    def report(name: str, severity: str, chain: list[str]) -> Column:
        matched = present([F.col(step) for step in chain])
        unmet = lambda step: ~F.exists(matched, lambda m: F.contains(m, F.lit(step)))
        missing = present([F.when(unmet(step), F.lit(step)) for step in chain])
        share = F.size(matched) / F.lit(len(chain))
        return F.when(share >= rules.CHAIN_MIN_SHARE, F.struct(
            F.lit(name).alias("signature_name"), F.lit(severity).alias("severity"),
            F.floor(share * 100).cast("int").alias("confidence"),
            matched.alias("matched_apis"), missing.alias("missing_apis")))

    return (facts.select("file_id", F.explode(present(
        [report(*chain) for chain in rules.BEHAVIOR_CHAINS])).alias("_r"))
        .select("file_id", "_r.*"))


def is_prologue() -> Column:
    return (((F.col("mnemonic") == "push") & (F.col("op_str") == "ebp"))
            | ((F.col("mnemonic") == "sub") & F.contains("op_str", F.lit("rsp"))))


def api_call_graph(instructions: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls to imported addresses, attributed to the function they occur in.

    The current function is the last prologue before the call.  When an address
    starts several functions only calls after its last prologue count.
    """

    start = F.when(is_prologue(), F.struct(F.col("idx").alias("start_idx"),
                                           F.col("address").alias("start_address")))
    placed = fill_forward(instructions, ["file_id"], "idx", {"start": start})
    targets = (imports.where(F.col("func").isNotNull() & F.col("address").isNotNull()
                             & ~F.col("delayed"))
               .groupBy("file_id", hex_address(F.col("address")).alias("_target"))
               .agg(F.max_by("func", "seq").alias("api")))
    # The latest prologue per start address is found on prologue rows alone.
    last = (instructions.where(is_prologue()).groupBy("file_id", "address")
            .agg(F.max("idx").alias("_last")).withColumnRenamed("address", "_start"))
    calls = (placed.where(F.col("mnemonic") == "call")
             .select("file_id", "idx", F.col("start.start_idx").alias("_idx"),
                     F.col("start.start_address").alias("_start"),
                     F.regexp_extract("op_str", "0x[0-9a-f]+", 0).alias("_target"))
             .join(targets, ["file_id", "_target"])
             .join(last, ["file_id", "_start"], "left")
             .where(F.col("_idx").isNull() | (F.col("_idx") == F.col("_last"))))
    func = F.when(F.col("_start").isNull(), "unknown_offset").otherwise(
        F.concat(F.lit("func_"), hex_address(F.col("_start"))))
    return calls.select("file_id", func.alias("func"), "idx", "api")


def cfg_metrics(instructions: DataFrame) -> DataFrame:
    """Function, block and indirect-branch counts per file (one aggregate)."""
    m, immediate = F.col("mnemonic"), F.startswith("op_str", F.lit("0x"))
    ends = F.startswith(m, F.lit("j")) | m.isin("call", "ret")
    facts = instructions.groupBy("file_id").agg(
        F.count_if(is_prologue()).alias("_functions"),
        F.count_if(ends).alias("basic_block_count"),
        F.count_if((m == "call") & ~immediate).alias("indirect_calls"),
        F.count_if((m == "jmp") & ~immediate).alias("indirect_jumps"))
    return facts.select(
        "file_id", F.greatest("_functions", F.lit(1)).alias("function_count"),
        "basic_block_count", "indirect_calls", "indirect_jumps",
        F.col("basic_block_count").alias("complexity_score"),
        (F.col("indirect_jumps") > 25).alias("high_indirect_jumps"),
        ((F.col("basic_block_count") > 50) & (F.col("_functions") == 0))
        .alias("stripped_prologues"))


def cfg_findings(instructions: DataFrame) -> DataFrame:
    jumps = F.col("indirect_jumps").cast("string")
    return explode_findings(cfg_metrics(instructions), ["file_id"], [
        finding(F.col("high_indirect_jumps"), "high_indirect_jumps", "medium",
                F.concat(F.lit("indirect jumps: "), jumps)),
        finding(F.col("stripped_prologues"), "stripped_prologues", "medium",
                F.lit("many blocks without a known function start"))])


def evasion_score(files: DataFrame, imports: DataFrame,
                  instructions: DataFrame) -> DataFrame:
    """Weighted distinct evasion evidence per file, in four lists."""
    func, weight = F.col("func"), rules.EVASION_WEIGHTS
    kinds = {"anti_debug": rules.ANTI_DEBUG_APIS, "timing": rules.TIMING_APIS,
             "input": rules.INPUT_APIS}
    apis = imports.where(~F.col("delayed")).groupBy("file_id").agg(*[
        F.array_sort(F.collect_set(F.when(func.isin(names), func))).alias(f"_{kind}")
        for kind, names in kinds.items()])
    seen = instructions.groupBy("file_id").agg(
        F.bool_or(F.col("mnemonic") == "rdtsc").alias("_rdtsc"),
        F.bool_or(F.col("mnemonic") == "cpuid").alias("_cpuid"))
    # Bytes above 0x7F keep their value, ASCII letters fold: the same markers match.
    probe = F.lower(F.decode(F.col("content"), "ISO-8859-1"))
    markers = present([F.when(F.contains("_probe", F.lit(m)), F.lit(f"string_marker:{m}"))
                       for m in rules.VM_MARKERS])
    base = (files.select("file_id", probe.alias("_probe"))
            .select("file_id", markers.alias("_vm"))
            .join(apis, "file_id", "left").join(seen, "file_id", "left"))
    none = F.array().cast("array<string>")
    items = lambda c: F.coalesce(F.col(c), none)
    flag = lambda c, name: F.when(F.coalesce(F.col(c), F.lit(False)), F.array(F.lit(name))) \
        .otherwise(none)
    parts = {
        "anti_debug_apis": items("_anti_debug"),
        "timing_checks": F.concat(items("_timing"), flag("_rdtsc", "rdtsc")),
        "vm_detection": F.concat(F.col("_vm"), flag("_cpuid", "cpuid")),
        "sandbox_evasion": items("_input"),
    }
    score = (F.size(items("_anti_debug")) * weight["anti_debug"]
             + F.size(items("_input")) * weight["input"]
             + F.size(items("_timing")) * weight["timing"]
             + F.size("_vm") * weight["vm_marker"]
             + F.size(flag("_rdtsc", "rdtsc")) * weight["rdtsc"]
             + F.size(flag("_cpuid", "cpuid")) * weight["cpuid"])
    return base.select("file_id", *[c.alias(n) for n, c in parts.items()],
                       F.least(score, F.lit(100)).alias("evasion_score"))


def code_patterns(code: DataFrame) -> DataFrame:
    """Call, return and branch opcodes at every position, with their targets.

    Positions come from one vectorised pass; operands are cut out before the
    rows are exploded, so content is never copied per match.
    """
    size = F.octet_length("data")

    def found(byte: int, kind: str, width: int) -> Column:
        inside = F.filter(opcode_positions("data", F.lit(byte)), lambda p: p + width < size)
        return F.transform(inside, lambda p: F.struct(
            p.cast("bigint").alias("pos"), F.lit(kind).alias("type"),
            F.lit(width).alias("width"),
            F.hex(F.substring(F.col("data"), p + 2, F.lit(max(width, 1)))).alias("operand")))

    hits = [found(*opcode) for opcode in rules.OPCODES]
    rows = (code.where(size >= 2)
            .select("file_id", "seq", "base_addr",
                    F.explode(F.concat(*hits)).alias("_h"))
            .select("file_id", "seq", (F.col("base_addr") + F.col("_h.pos")).alias("address"),
                    "_h.type", "_h.width", "_h.operand"))
    offset = (F.when(F.col("width") == 4, little_endian_signed(F.col("operand"), 4))
              .when(F.col("width") == 1, little_endian_signed(F.col("operand"), 1)))
    return rows.select("file_id", "seq", "address", "type",
                       (F.col("address") + 1 + F.col("width") + offset).alias("target"))


def map_pcode(ops: DataFrame) -> DataFrame:
    """P-code name → instruction type → operator type."""
    kind = F.coalesce(lookup(F.col("pcode"), rules.PCODE_TYPES), F.lit("UNKNOWN"))
    operator = lookup(F.col("inst_type"), rules.OPERATOR_OF_TYPE)
    return (ops.withColumn("inst_type", kind)
            .withColumn("operator_type", F.concat(F.lit("<operator>."), operator)))


def deep_report(files: DataFrame, parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(file_id, part, error, body): what every analyzer part found in every file.

    A finding is one row with its fields as JSON in ``body``; a file without findings in
    a part has one row with a null body.  Each part is written on its own, so one that
    fails, in planning or in running, gives its ``error`` in the row of every file and
    does not stop the others.  Findings of files that are not in ``files`` are in no row, so
    they are dropped where the plan of the part meets its tables, before they are put in order
    or become JSON and are written.
    """
    def rows(name: str, found: DataFrame, error: Column) -> DataFrame:
        return found.select("file_id", F.lit(name).alias("part"),
                            error.cast("string").alias("error"), "body")

    ids = cut(files.select("file_id"))
    known = ids.distinct()
    done = []
    for name, build in parts.items():
        try:
            part = among(build(), known)
            fields = [c for c in part.columns if c != "file_id"]
            body = cut(part.select("file_id", F.to_json(F.struct(*fields)).alias("body")))
            done.append(rows(name, ids.join(body, "file_id", "left"), F.lit(None)))
        except Exception as exc:  # a broken analyzer must not lose the others
            failed = ids.withColumn("body", F.lit(None).cast("string"))
            error = (str(exc).splitlines() or [""])[0] or type(exc).__name__
            done.append(rows(name, failed, F.lit(error)))
    return reduce(DataFrame.unionByName, done)
