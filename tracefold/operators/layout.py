"""Header, section, overlay, memory and resource rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold import rules
from tracefold.functions.bytes import (byte_entropy, entropy_class, hex_address,
                                       hex_padded)
from tracefold.functions.literals import (contains_any, contains_any_bytes,
                                          first_match, lookup, present, raw)
from tracefold.operators import content
from tracefold.operators.ordering import number_rows
from tracefold.sources.chunks import chunk_store, chunked


def finding(condition: Column, kind: str, severity: str, detail: Column) -> Column:
    return F.when(condition, F.struct(F.lit(kind).alias("type"),
                                      F.lit(severity).alias("severity"),
                                      detail.alias("detail")))


def explode_findings(df: DataFrame, keys: list[str], entries: list[Column]) -> DataFrame:
    return (df.select(*keys, F.explode(present(entries)).alias("_f"))
            .select(*keys, "_f.type", "_f.severity", "_f.detail"))


def has_bit(flags: Column, bit: int) -> Column:
    return flags.cast("bigint").bitwiseAND(F.lit(bit).cast("bigint")) != 0


# --- headers ------------------------------------------------------------------

def decode_flags(headers: DataFrame) -> DataFrame:
    flags = present([F.when(has_bit(F.col("characteristics"), bit), F.lit(name))
                     for bit, name in rules.CHARACTERISTIC_BITS])
    return headers.select("*", flags.alias("characteristic_flags"), *[
        has_bit(F.col("dll_chars"), bit).alias(name)
        for name, bit in rules.SECURITY_BITS.items()])


def named(value: Column, names: dict[int, str], shown: Column) -> Column:
    return F.coalesce(lookup(value.cast("bigint"), names),
                      F.concat(F.lit("UNKNOWN("), shown, F.lit(")")))


def decode_enums(headers: DataFrame) -> DataFrame:
    machine, magic, sub = F.col("machine"), F.col("opt_magic"), F.col("subsystem")
    prefixed = lambda c: F.concat(F.lit("0x"), hex_padded(c))
    return headers.select(
        "*",
        named(machine, rules.MACHINE_NAMES, prefixed(machine)).alias("machine_name"),
        named(magic, rules.OPTIONAL_MAGIC_NAMES, prefixed(magic)).alias("magic_name"),
        named(sub, rules.SUBSYSTEM_NAMES, sub.cast("string")).alias("subsystem_name"),
        F.coalesce(lookup(machine.cast("bigint"), rules.ARCH_NAMES),
                   F.concat(F.lit("unknown_"), F.lower(F.hex(machine.cast("bigint")))))
        .alias("arch"))


def iso_time(epoch: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.lit("+00:00"))


def header_anomalies(headers: DataFrame, now: Column) -> DataFrame:
    """One row per header anomaly; ``now`` is epoch seconds."""
    ts, stored, computed = F.col("timestamp"), F.col("checksum"), F.col("checksum_computed")
    magic, chars = F.col("e_magic"), F.col("dll_chars")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return explode_findings(headers, ["file_id"], [
        finding(magic != rules.DOS_MAGIC, "invalid_dos_magic", "critical",
                text("DOS e_magic is ", hex_address(magic), ", expected 0x5a4d")),
        finding(ts > now, "future_timestamp", "high",
                text("TimeDateStamp ", iso_time(ts), " is in the future")),
        finding(ts == 0, "zero_timestamp", "medium",
                F.lit("link time is empty")),
        finding(stored == 0, "missing_checksum", "medium",
                F.lit("no checksum stored")),
        finding((stored != 0) & (computed != stored), "checksum_mismatch", "high",
                text("Stored checksum ", hex_address(stored), " != computed ",
                     hex_address(computed))),
        finding(~has_bit(chars, rules.SECURITY_BITS["aslr"]), "aslr_disabled", "medium",
                F.lit("no address randomisation")),
        finding(~has_bit(chars, rules.SECURITY_BITS["dep"]), "dep_disabled", "medium",
                F.lit("data pages may execute"))])


def entry_point_outside(headers: DataFrame, sections: DataFrame) -> DataFrame:
    """Files whose non-zero entry point lies in no section (range anti join)."""
    spans = sections.select(
        F.col("file_id").alias("_file"), F.col("va").alias("_start"),
        (F.col("va") + F.greatest("virtual_size", "raw_size")).alias("_end"))
    ep = F.col("ep_rva")
    return (headers.where(ep != 0)
            .join(spans, (F.col("file_id") == F.col("_file")) & (ep >= F.col("_start"))
                  & (ep < F.col("_end")), "left_anti")
            .select("file_id", F.lit("suspicious_entry_point").alias("type"),
                    F.lit("high").alias("severity"),
                    F.concat(F.lit("Entry point "), hex_address(ep),
                             F.lit(" lies in no section")).alias("detail")))


# --- entropy and packing ----------------------------------------------------------

def section_entropy(section_bytes: DataFrame) -> DataFrame:
    """Entropy per (file, section); narrow, no shuffle."""
    return section_bytes.select("file_id", "seq",
                                F.round(byte_entropy("data"), 4).alias("entropy"))


def file_entropy(files: DataFrame) -> DataFrame:
    """Whole-file entropy and its class; an empty file is of unknown class."""
    measured = files.select(*[c for c in files.columns if c != "content"],
                            F.octet_length("content").alias("_size"),
                            byte_entropy("content").alias("_entropy"))
    return (measured
            .withColumn("file_entropy", F.round("_entropy", 4))
            .withColumn("entropy_class", F.when(F.coalesce("_size", F.lit(0)) == 0, "unknown")
                        .otherwise(entropy_class(F.col("_entropy"))))
            .drop("_size", "_entropy"))


def one_decimal(value: Column) -> Column:
    """Text with one decimal of a positive number, rounded by its exact binary value.

    ``n / 20`` is the midpoint between the two candidates.  Its distance to the
    value is computed without rounding error, and a true tie goes to even.
    """
    tenths = F.floor(value * 10)
    n = (tenths * 2 + 1).cast("double")
    below = (n - value * 16) - value * 4
    up = F.when(below < 0, 1).when(below == 0, tenths % 2).otherwise(0)
    tenths = tenths + up
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"))


def section_flags(sections: DataFrame) -> DataFrame:
    flags = {name: has_bit(F.col("flags"), bit) for name, bit in rules.SECTION_BITS.items()}
    rwx = flags["readable"] & flags["writable"] & flags["executable"]
    return sections.select("*", *[c.alias(n) for n, c in flags.items()], rwx.alias("rwx"))


def section_red_flags(sections: DataFrame) -> DataFrame:
    name, entropy = F.col("name"), F.col("entropy")
    virt, size = F.col("virtual_size"), F.col("raw_size")
    ratio = F.greatest(virt, size) / F.greatest(F.least(virt, size), F.lit(1))
    quoted = F.concat(F.lit("Section '"), name, F.lit("'"))
    both = (size > 0) & (virt > 0)
    entries = [
        finding(F.col("rwx"), "rwx_section", "high",
                F.concat(quoted, F.lit(" can be read, written and executed"))),
        finding(entropy > rules.HIGH_SECTION_ENTROPY, "high_entropy", "high",
                F.concat(quoted, F.lit(" entropy "), F.format_string("%.4f", entropy),
                         F.lit(" is above 7.2"))),
        finding(both & (ratio > rules.SIZE_RATIO_LIMIT), "size_mismatch", "medium",
                F.concat(quoted, F.lit(" virtual/raw size ratio "),
                         one_decimal(ratio), F.lit("x (virt="),
                         virt.cast("string"), F.lit(", raw="), size.cast("string"), F.lit(")"))),
        finding(~both & (size == 0) & (virt > rules.LARGE_EMPTY_SECTION),
                "size_mismatch", "medium",
                F.concat(quoted, F.lit(" has zero raw size but large virtual size ("),
                         virt.cast("string"), F.lit(")"))),
        finding((name != "") & ~name.isin(rules.KNOWN_SECTIONS), "unusual_section_name", "low",
                F.concat(F.lit("unknown section name '"), name, F.lit("'"))),
    ]
    return explode_findings(section_flags(sections), ["file_id", "seq", "name"], entries)


def packing_likelihood(files: DataFrame, sections: DataFrame) -> DataFrame:
    """Score per file; a file without sections counts as having one."""
    facts = section_flags(sections).groupBy("file_id").agg(
        F.count_if(F.col("entropy") > rules.HIGH_SECTION_ENTROPY).alias("_high"),
        F.count_if("rwx").alias("_rwx"), F.count(F.lit(1)).alias("_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.coalesce("_total", F.lit(1))
    score = (F.least(zero("_high") * 25, F.lit(50)) + F.least(zero("_rwx") * 20, F.lit(40))
             + F.when(total <= 2, 10).otherwise(0))
    return (files.select("file_id").join(facts, "file_id", "left")
            .select("file_id", total.alias("total_sections"),
                    F.least(score, F.lit(100)).alias("packing_likelihood")))


def packer_names(name: Column) -> Column:
    """Packers whose markers occur in one lower-cased section name."""
    return present([F.when(contains_any(name, parts), F.lit(packer))
                    for packer, parts in rules.PACKER_MARKERS])


def packing_score(files: DataFrame, sections: DataFrame) -> DataFrame:
    """Packer name, entropy and section-count heuristics; needs ``file_entropy``."""
    hits = {p: F.bool_or(contains_any(F.lower("name"), parts))
            for p, parts in rules.PACKER_MARKERS}
    facts = sections.groupBy("file_id").agg(
        *[c.alias(f"_p_{p}") for p, c in hits.items()],
        F.count_if(F.col("entropy") > rules.HIGH_SECTION_ENTROPY).alias("_high"),
        F.count(F.lit(1)).alias("_total"))
    packers = present([F.when(F.col(f"_p_{p}"), F.lit(p)) for p, _ in rules.PACKER_MARKERS])
    score = (F.when(F.size("detected_packers") > 0, 50).otherwise(0)
             + F.when(F.col("file_entropy") > rules.HIGH_FILE_ENTROPY, 30).otherwise(0)
             + F.coalesce("_high", F.lit(0)) * 20
             + F.when(F.coalesce("_total", F.lit(0)) < 3, 10).otherwise(0))
    return (files.select("file_id", "file_entropy").join(facts, "file_id", "left")
            .withColumn("detected_packers", packers)
            .select("file_id", "detected_packers",
                    F.least(score, F.lit(100)).alias("packing_score")))


def section_entropies(sections: DataFrame) -> DataFrame:
    """Entropy per lower-cased section name; the last section of a name wins."""
    return sections.groupBy("file_id", F.lower("name").alias("name")).agg(
        F.max_by(F.round("entropy", 4), "seq").alias("entropy"))


def section_entropies_map(sections: DataFrame) -> DataFrame:
    """The same as one map per file, for reports."""
    return section_entropies(sections).groupBy("file_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "entropy"))))
        .alias("section_entropies"))


def packer_fingerprint(sections: DataFrame) -> DataFrame:
    name = F.lower("name")
    facts = sections.groupBy("file_id").agg(*[
        F.bool_or(contains_any(name, parts)).alias(f"_{packer}")
        for packer, parts in rules.PACKER_FIRST_MATCH])
    found = first_match([(F.col(f"_{p}"), F.lit(p)) for p, _ in rules.PACKER_FIRST_MATCH],
                        F.lit("none"))
    return facts.select("file_id", found.alias("packer"))


def compiler_fingerprint(headers: DataFrame, sections: DataFrame,
                         files: DataFrame | None = None) -> DataFrame:
    """Compiler by section names, rich header and a marker in the content."""
    name = F.lower("name")
    tests = {
        "go": name.isin(".gopclntab", "go.buildid") | F.startswith(name, F.lit(".go")),
        "code": name == "code", "data": name == "data", "bss": name == "bss",
        "mingw": (name == ".idata$") | F.startswith(name, F.lit(".mingw")),
        "text": name == ".text", "rdata": name == ".rdata", "dotdata": name == ".data",
    }
    facts = sections.groupBy("file_id").agg(
        *[F.bool_or(test).alias(f"_{key}") for key, test in tests.items()])
    base = headers.select("file_id", "rich_attr").join(facts, "file_id", "left")
    if files is None:
        base = base.withColumn("_rust", F.lit(False))
    else:
        marks = [m.encode().hex() for m in rules.RUST_MARKERS]
        base = base.join(files.select("file_id", contains_any_bytes(F.col("content"), marks)
                                      .alias("_rust")), "file_id", "left")
    has = lambda key: F.coalesce(F.col(f"_{key}"), F.lit(False))
    compiler = first_match([
        (has("go"), F.lit(rules.COMPILER_GO)),
        (has("code") & has("data") & has("bss"), F.lit(rules.COMPILER_DELPHI)),
        (has("mingw"), F.lit(rules.COMPILER_MINGW)),
        (F.col("rich_attr"), F.lit(rules.COMPILER_MSVC)),
        (has("text") & has("rdata") & has("dotdata"), F.lit(rules.COMPILER_STANDARD)),
        (has("rust"), F.lit(rules.COMPILER_RUST))], F.lit("unknown"))
    return base.select("file_id", compiler.alias("compiler"))


def rich_entries(values: DataFrame) -> DataFrame:
    """Tool id and build of every value; counts in the flat list decode too."""
    value = F.col("value").cast("bigint")
    return values.select("file_id", "pos", F.shiftright(value, 16).alias("tool_id"),
                         value.bitwiseAND(F.lit(0xFFFF).cast("bigint")).alias("build"))


def linker_anomalies(headers: DataFrame, compilers: DataFrame,
                     packers: DataFrame) -> DataFrame:
    base = (headers.select("file_id", "rich_present", "timestamp")
            .join(compilers, "file_id").join(packers, "file_id", "left")
            .withColumn("packer", F.coalesce("packer", F.lit("none"))))
    rich, packer = F.col("rich_present"), F.col("packer")
    return explode_findings(base, ["file_id"], [
        finding(~packer.isin("none", "UPX") & ~rich, "packed_binary", "medium",
                F.concat(F.lit("packer found: "), packer)),
        finding((F.col("compiler") == rules.COMPILER_MSVC) & ~rich, "missing_rich_header",
                "low", F.lit("compiled by MSVC without a rich header")),
        finding(F.col("timestamp") < rules.YEAR_2000_EPOCH, "pre_2000_timestamp", "medium",
                F.lit("link time before 2000"))])


# --- overlay, memory, resources -----------------------------------------------------

def overlay(files: DataFrame, sections: DataFrame) -> DataFrame:
    """Data after the last section; the content lies in buckets and the offsets come to it."""
    return content.overlay(chunk_store(chunked(files)), sections)


def memory_map(headers: DataFrame, sections: DataFrame) -> DataFrame:
    start = F.col("image_base") + F.col("va")
    return (sections.join(headers.select("file_id", "image_base"), "file_id")
            .select("file_id", "seq", "name", hex_address(start).alias("start"),
                    hex_address(start + F.col("virtual_size")).alias("end"),
                    "virtual_size", hex_address(F.col("va")).alias("rva")))


def reloc_iat_counts(files: DataFrame, relocations: DataFrame,
                     imports: DataFrame) -> DataFrame:
    """Relocation and (non-delayed) import entries per file."""
    relocs = relocations.groupBy("file_id").agg(F.count(F.lit(1)).alias("_r"))
    iat = imports.where(~F.col("delayed")).groupBy("file_id").agg(
        F.count(F.lit(1)).alias("_i"))
    return (files.select("file_id").join(relocs, "file_id", "left")
            .join(iat, "file_id", "left")
            .select("file_id", F.col("_r").isNotNull().alias("has_relocations"),
                    F.coalesce("_r", F.lit(0)).alias("relocation_count"),
                    F.col("_i").isNotNull().alias("has_iat"),
                    F.coalesce("_i", F.lit(0)).alias("iat_entries")))


def tls_callbacks(pointers: DataFrame) -> DataFrame:
    """Pointers before the first zero of each file."""
    stops = pointers.where(F.col("ptr") == 0).groupBy("file_id").agg(
        F.min("idx").alias("_stop"))
    return (pointers.join(stops, "file_id", "left")
            .where(F.col("_stop").isNull() | (F.col("idx") < F.col("_stop")))
            .select("file_id", "idx", hex_address(F.col("ptr")).alias("callback")))


def is_embedded_pe(data: Column) -> Column:
    return (F.startswith(data, raw("4D5A"))
            | F.contains(data, raw(rules.EMBEDDED_PE_MARK)))


def resource_tree(resources: DataFrame) -> DataFrame:
    """Every resource with its place in its file."""
    return number_rows(resources, ["seq"], ["file_id"], "place")


def embedded_resources(resources: DataFrame) -> DataFrame:
    """One high-severity row per resource that holds an executable."""
    return (resources.where(is_embedded_pe(F.col("data")))
            .select("file_id", "seq", F.lit("embedded_pe_in_resource").alias("type"),
                    F.lit("high").alias("severity"),
                    F.concat(F.lit("executable inside resource "), "res_type",
                             F.lit("/"), "res_name", F.lit(" ("),
                             F.col("size").cast("string"), F.lit(" bytes)")).alias("detail")))


def version_spoofing(version_info: DataFrame) -> DataFrame:
    """Company names that imitate a known one, one row per look-alike hit."""
    pick = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    wide = version_info.groupBy("file_id").agg(
        pick("CompanyName").alias("company"), pick("ProductName").alias("product"))
    low = lambda c: F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))))
    company, product = low("company"), low("product")
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    entries = [
        finding(F.contains(company, F.lit(typo)) & (company != right),
                "company_name_spoofing", "high",
                F.concat(F.lit("company '"), shown("company"),
                         F.lit(f"' looks like '{right}'")))
        for right, typos in rules.COMPANY_LOOKALIKES for typo in typos]
    entries.append(finding(
        F.contains(company, F.lit("microsoft")) & (product != "")
        & ~F.contains(product, F.lit("microsoft")) & ~F.contains(product, F.lit("windows")),
        "suspicious_metadata_alignment", "medium",
        F.concat(F.lit("Company is '"), shown("company"), F.lit("' but product is '"),
                 shown("product"), F.lit("'"))))
    return explode_findings(wide, ["file_id"], entries)


def signature_trust(certificates: DataFrame) -> DataFrame:
    """Trust score from parsed certificate columns."""
    signed, parsed = F.col("is_signed"), F.col("parsed")
    base = F.when(F.col("verified"), rules.TRUST_VERIFIED).otherwise(rules.TRUST_FAILED)
    own = F.coalesce(F.col("issuer") == F.col("subject"), F.lit(False))
    capped = F.when(own, F.least(base, F.lit(rules.TRUST_SELF_SIGNED_CAP))).otherwise(base)
    return certificates.select(
        "file_id", signed.alias("is_signed"),
        (signed & (~parsed | F.col("verified"))).alias("certificate_valid"),
        (signed & parsed & own).alias("self_signed"),
        F.when(~signed, 0).when(~parsed, rules.TRUST_SIGNED).otherwise(capped)
        .alias("trust_score"))


def entropy_band(entropy: Column) -> Column:
    return first_match([(entropy >= 7.2, F.lit("high")), (entropy >= 5.0, F.lit("compressed"))],
                       F.lit("normal"))


def risk_band(score: Column) -> Column:
    return first_match([(score >= 80, F.lit("critical")), (score >= 60, F.lit("high")),
                        (score >= 35, F.lit("medium"))], F.lit("low"))
