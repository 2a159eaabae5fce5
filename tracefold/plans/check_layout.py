"""Queries over headers, sections, imports, exports and instructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import rules
from tracefold.operators import behavior, content, layout, text_rules
from tracefold.plans.catalog import query
from tracefold.plans.views import Tables, literal, values
from tracefold.session import among, cut
from tracefold.sources.chunks import chunk_store, chunked

NOW = 1_600_000_000


def sql_list(items) -> str:
    return ", ".join(literal(i) for i in items)


def any_contains(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {literal(p)})" for p in parts) + ")"


def entropy_sql(source: str, keys: str, content: str) -> str:
    """Entropy per key by counting hex pairs; empty content gives no row."""
    return f"""
SELECT {keys}, abs(sum(c / n * log2(c / n))) AS entropy FROM (
  SELECT {keys}, b, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY {keys}) AS n
  FROM (SELECT {keys}, unnest(regexp_extract_all(hex({content}), '..')) AS b FROM {source}) u
  GROUP BY {keys}, b) v GROUP BY {keys}"""


# --- headers ----------------------------------------------------------------------

FLAG_LIST = ", ".join(f"CASE WHEN characteristics & {b} <> 0 THEN {literal(n)} END"
                      for b, n in rules.CHARACTERISTIC_BITS)


@query("decode_flags", f"""
SELECT file_id, array_to_string(list_filter([{FLAG_LIST}], lambda x: x IS NOT NULL), ',') AS flags,
       {', '.join(f'dll_chars & {b} <> 0 AS {n}' for n, b in rules.SECURITY_BITS.items())}
FROM {{headers}}""")
def _(t):
    return layout.decode_flags(t("headers")).select(
        "file_id", F.array_join("characteristic_flags", ",").alias("flags"),
        *rules.SECURITY_BITS)


@query("decode_enums", f"""
SELECT file_id,
       coalesce(m.name, 'UNKNOWN(0x' || CASE WHEN length(hex(machine)) < 4
                THEN lpad(hex(machine), 4, '0') ELSE hex(machine) END || ')') AS machine_name,
       coalesce(g.name, 'UNKNOWN(0x' || lpad(hex(opt_magic), 4, '0') || ')') AS magic_name,
       coalesce(s.name, 'UNKNOWN(' || CAST(subsystem AS VARCHAR) || ')') AS subsystem_name,
       coalesce(a.name, 'unknown_' || lower(hex(machine))) AS arch
FROM {{headers}} LEFT JOIN {{machines}} m ON machine = m.id LEFT JOIN {{magics}} g ON opt_magic = g.id
LEFT JOIN {{subsystems}} s ON subsystem = s.id LEFT JOIN {{archs}} a ON machine = a.id""", {
    "machines": values("id, name", list(rules.MACHINE_NAMES.items())),
    "magics": values("id, name", list(rules.OPTIONAL_MAGIC_NAMES.items())),
    "subsystems": values("id, name", list(rules.SUBSYSTEM_NAMES.items())),
    "archs": values("id, name", list(rules.ARCH_NAMES.items()))})
def _(t):
    return layout.decode_enums(t("headers")).select(
        "file_id", "machine_name", "magic_name", "subsystem_name", "arch")


@query("header_anomalies", f"""
SELECT file_id, 'invalid_dos_magic' AS type, 'critical' AS severity,
       'DOS e_magic is 0x' || lower(hex(e_magic)) || ', expected 0x5a4d' AS detail
FROM {{headers}} WHERE e_magic <> 23117
UNION ALL SELECT file_id, 'future_timestamp', 'high', 'TimeDateStamp ' ||
       strftime(make_timestamp(CAST(timestamp AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S')
       || '+00:00 is in the future' FROM {{headers}} WHERE timestamp > {NOW}
UNION ALL SELECT file_id, 'zero_timestamp', 'medium',
       'link time is empty' FROM {{headers}} WHERE timestamp = 0
UNION ALL SELECT file_id, 'missing_checksum', 'medium',
       'no checksum stored' FROM {{headers}} WHERE checksum = 0
UNION ALL SELECT file_id, 'checksum_mismatch', 'high', 'Stored checksum 0x' || lower(hex(checksum))
       || ' != computed 0x' || lower(hex(checksum_computed)) FROM {{headers}}
       WHERE checksum <> 0 AND checksum <> checksum_computed
UNION ALL SELECT file_id, 'aslr_disabled', 'medium', 'no address randomisation'
       FROM {{headers}} WHERE dll_chars & 64 = 0
UNION ALL SELECT file_id, 'dep_disabled', 'medium', 'data pages may execute'
       FROM {{headers}} WHERE dll_chars & 256 = 0""")
def _(t):
    return layout.header_anomalies(t("headers"), F.lit(NOW))


@query("entry_point_outside", """
SELECT file_id, 'suspicious_entry_point' AS type, 'high' AS severity, 'Entry point 0x' ||
       lower(hex(ep_rva)) || ' lies in no section' AS detail
FROM {headers} h WHERE ep_rva <> 0 AND NOT EXISTS (
  SELECT 1 FROM {sections} s WHERE s.file_id = h.file_id AND ep_rva >= va
  AND ep_rva < va + greatest(virtual_size, raw_size))""")
def _(t):
    return layout.entry_point_outside(t("headers"), t("sections"))


# --- entropy and packing --------------------------------------------------------------

@query("section_entropy", """
SELECT s.file_id, s.seq, coalesce(round(entropy, 4), 0) AS entropy
FROM {section_bytes} s LEFT JOIN {e} ON s.file_id = e.file_id AND s.seq = e.seq""",
       {"e": entropy_sql("{section_bytes}", "file_id, seq", "data")})
def _(t):
    return layout.section_entropy(t("section_bytes"))


FILE_ENTROPY = {"e": entropy_sql("{files}", "file_id", "content")}
ENTROPY_CLASS = """CASE WHEN entropy IS NULL THEN 'unknown' WHEN entropy < 1 THEN 'mostly empty'
    WHEN entropy < 5 THEN 'normal code/data' WHEN entropy < 7 THEN 'compressed/encoded'
    ELSE 'encrypted/packed' END"""


@query("file_entropy", f"""
SELECT f.file_id, coalesce(round(entropy, 4), 0) AS file_entropy, {ENTROPY_CLASS} AS entropy_class
FROM {{files}} f LEFT JOIN {{e}} ON f.file_id = e.file_id""", FILE_ENTROPY)
def _(t):
    return layout.file_entropy(t("files")).select("file_id", "file_entropy", "entropy_class")


@query("section_flags", f"""
SELECT file_id, seq, {', '.join(f'flags & {b} <> 0 AS {n}' for n, b in rules.SECTION_BITS.items())},
       flags & 3758096384 = 3758096384 AS rwx FROM {{sections}}""")
def _(t):
    return layout.section_flags(t("sections")).select("file_id", "seq", *rules.SECTION_BITS, "rwx")


@query("section_red_flags", f"""
SELECT file_id, seq, name, 'rwx_section' AS type, 'high' AS severity,
       'Section ''' || name || ''' can be read, written and executed' AS detail
FROM {{sections}} WHERE flags & 3758096384 = 3758096384
UNION ALL SELECT file_id, seq, name, 'high_entropy', 'high', 'Section ''' || name || ''' entropy ' ||
       printf('%.4f', entropy) || ' is above 7.2'
FROM {{sections}} WHERE entropy > 7.2
UNION ALL SELECT file_id, seq, name, 'size_mismatch', 'medium', 'Section ''' || name ||
       ''' virtual/raw size ratio ' || printf('%.1f', greatest(virtual_size, raw_size) /
       least(virtual_size, raw_size)) || 'x (virt=' || virtual_size || ', raw=' || raw_size || ')'
FROM {{sections}} WHERE raw_size > 0 AND virtual_size > 0
     AND greatest(virtual_size, raw_size) > 3 * least(virtual_size, raw_size)
UNION ALL SELECT file_id, seq, name, 'size_mismatch', 'medium', 'Section ''' || name ||
       ''' has zero raw size but large virtual size (' || virtual_size || ')'
FROM {{sections}} WHERE raw_size = 0 AND virtual_size > 4096
UNION ALL SELECT file_id, seq, name, 'unusual_section_name', 'low',
       'unknown section name ''' || name || ''''
FROM {{sections}} WHERE name <> '' AND name NOT IN ({sql_list(rules.KNOWN_SECTIONS)})""")
def _(t):
    return layout.section_red_flags(t("sections"))


@query("packing_likelihood", """
SELECT f.file_id, coalesce(n, 1) AS total_sections,
       CAST(least(least(25 * coalesce(high, 0), 50) + least(20 * coalesce(rwx, 0), 40)
            + CASE WHEN coalesce(n, 1) <= 2 THEN 10 ELSE 0 END, 100) AS BIGINT) AS packing_likelihood
FROM {file_keys} f LEFT JOIN (
  SELECT file_id, count(*) AS n, count(*) FILTER (WHERE entropy > 7.2) AS high,
         count(*) FILTER (WHERE flags & 3758096384 = 3758096384) AS rwx
  FROM {sections} GROUP BY file_id) s ON f.file_id = s.file_id""")
def _(t):
    return layout.packing_likelihood(t("file_keys"), t("sections"))


PACKER_COLUMNS = ", ".join(
    f"bool_or({any_contains('lower(name)', parts)}) AS p{i}"
    for i, (_, parts) in enumerate(rules.PACKER_MARKERS))
PACKER_NAMES = "list_filter([" + ", ".join(
    f"CASE WHEN p{i} THEN {literal(p)} END" for i, (p, _) in enumerate(rules.PACKER_MARKERS)
) + "], lambda x: x IS NOT NULL)"


@query("packing_score", f"""
SELECT file_id, array_to_string(packers, ',') AS detected_packers,
       CAST(least(CASE WHEN len(packers) > 0 THEN 50 ELSE 0 END
            + CASE WHEN coalesce(entropy, 0) > 7 THEN 30 ELSE 0 END + 20 * coalesce(high, 0)
            + CASE WHEN coalesce(n, 0) < 3 THEN 10 ELSE 0 END, 100) AS BIGINT) AS packing_score
FROM (SELECT f.file_id, e.entropy, n, high, {PACKER_NAMES} AS packers
      FROM {{files}} f LEFT JOIN {{e}} ON f.file_id = e.file_id LEFT JOIN (
        SELECT file_id, count(*) AS n, count(*) FILTER (WHERE entropy > 7.2) AS high, {PACKER_COLUMNS}
        FROM {{sections}} GROUP BY file_id) s ON f.file_id = s.file_id) x""", FILE_ENTROPY)
def _(t):
    return layout.packing_score(layout.file_entropy(t("files")), t("sections")).select(
        "file_id", F.array_join("detected_packers", ",").alias("detected_packers"),
        "packing_score")


@query("section_entropies", """
SELECT file_id, lower(name) AS name, arg_max(round(entropy, 4), seq) AS entropy
FROM {sections} GROUP BY file_id, lower(name)""")
def _(t):
    return layout.section_entropies(t("sections"))


@query("packer_fingerprint", f"""
SELECT file_id, CASE {' '.join(
    f"WHEN bool_or({any_contains('lower(name)', parts)}) THEN {literal(p)}"
    for p, parts in rules.PACKER_FIRST_MATCH)} ELSE 'none' END AS packer
FROM {{sections}} GROUP BY file_id""")
def _(t):
    return layout.packer_fingerprint(t("sections"))


COMPILERS = """
SELECT h.file_id, rich_present, h.timestamp, CASE
    WHEN bool_or(name LIKE '.go%' OR name = 'go.buildid') THEN 'Go'
    WHEN bool_or(lower(name) = 'code') AND bool_or(lower(name) = 'data')
         AND bool_or(lower(name) = 'bss') THEN 'Delphi'
    WHEN bool_or(name = '.idata$' OR name LIKE '.mingw%') THEN 'MinGW (GCC)'
    WHEN rich_attr THEN 'Microsoft Visual C++ (MSVC)'
    WHEN bool_or(name = '.text') AND bool_or(name = '.rdata') AND bool_or(name = '.data')
         THEN 'Standard C/C++ (MSVC or compatible)'
    WHEN any_value(rust) THEN 'Rust' ELSE 'unknown' END AS compiler
FROM {headers} h LEFT JOIN {compiler_sections} s ON h.file_id = s.file_id
LEFT JOIN (SELECT file_id, regexp_matches(hex(content),
    '^(..)*(727573745F70616E6963|7374643A3A70616E69636B696E67)') AS rust FROM {files}) r
     ON h.file_id = r.file_id
GROUP BY h.file_id, rich_present, rich_attr, h.timestamp"""


@query("compiler_fingerprint", "SELECT file_id, compiler FROM {c}", {"c": COMPILERS})
def _(t):
    return layout.compiler_fingerprint(t("headers"), t("compiler_sections"), t("files"))


@query("rich_entries", """
SELECT file_id, pos, value >> 16 AS tool_id, value & 65535 AS build FROM {rich_values}""")
def _(t):
    return layout.rich_entries(t("rich_values"))


@query("linker_anomalies", f"""
SELECT c.file_id, 'packed_binary' AS type, 'medium' AS severity,
       'packer found: ' || packer AS detail
FROM {{c}} JOIN {{p}} ON c.file_id = p.file_id WHERE packer NOT IN ('none', 'UPX') AND NOT rich_present
UNION ALL SELECT file_id, 'missing_rich_header', 'low',
       'compiled by MSVC without a rich header'
FROM {{c}} WHERE compiler = 'Microsoft Visual C++ (MSVC)' AND NOT rich_present
UNION ALL SELECT file_id, 'pre_2000_timestamp', 'medium',
       'link time before 2000'
FROM {{c}} WHERE timestamp < 946684800""", {"c": COMPILERS, "p": f"""
SELECT file_id, CASE {' '.join(
    f"WHEN bool_or({any_contains('lower(name)', parts)}) THEN {literal(p)}"
    for p, parts in rules.PACKER_FIRST_MATCH)} ELSE 'none' END AS packer
FROM {{sections}} GROUP BY file_id"""})
def _(t):
    return layout.linker_anomalies(
        t("headers"),
        layout.compiler_fingerprint(t("headers"), t("compiler_sections"), t("files")),
        layout.packer_fingerprint(t("sections")))


# --- overlay, memory, resources -------------------------------------------------------

OVERLAY = """
SELECT f.file_id, coalesce(pe_end, 0) AS pe_end, octet_length(content) AS n,
       substr(hex(content), CAST(2 * coalesce(pe_end, 0) + 1 AS BIGINT)) AS tail
FROM {files} f LEFT JOIN (SELECT file_id, max(raw_ptr + raw_size) AS pe_end
    FROM {overlay_sections} GROUP BY file_id) s ON f.file_id = s.file_id"""
TAIL_ENTROPY = """
SELECT file_id, abs(sum(c / n * log2(c / n))) AS entropy FROM (
  SELECT file_id, b, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY file_id) AS n
  FROM (SELECT file_id, unnest(regexp_extract_all(tail, '..')) AS b FROM o WHERE n - pe_end > 64) u
  GROUP BY file_id, b) v GROUP BY file_id"""


@query("overlay", """
SELECT o.file_id, n - pe_end > 64 AS has_overlay,
       CASE WHEN n - pe_end > 64 THEN n - pe_end ELSE 0 END AS overlay_size,
       CASE WHEN n - pe_end > 64 THEN pe_end ELSE 0 END AS overlay_offset,
       coalesce(round(entropy, 4), 0) AS overlay_entropy,
       n - pe_end > 64 AND (tail LIKE '4D5A%' OR regexp_matches(tail, '^(..)*50450000'))
           AS embedded_pe,
       CASE WHEN n - pe_end <= 64 THEN 'none' WHEN tail LIKE '504B0304%' THEN 'ZIP'
            WHEN tail LIKE '526172211A07%' THEN 'RAR' WHEN tail LIKE '377ABCAF271C%' THEN '7z'
            WHEN tail LIKE '1F8B08%' THEN 'GZIP' ELSE 'none' END AS archive_detected
FROM {o} LEFT JOIN {te} ON o.file_id = te.file_id""", {"o": OVERLAY, "te": TAIL_ENTROPY})
def _(t):
    return layout.overlay(t("files"), t("overlay_sections"))


#: Small enough that the documents of every size take several chunks.
SMALL_CHUNK = 1024


@query("chunk_entropy", """
SELECT f.file_id, CAST(octet_length(content) AS BIGINT) AS bytes, coalesce(round(entropy, 4), 0) AS entropy
FROM {files} f LEFT JOIN {e} ON f.file_id = e.file_id""", FILE_ENTROPY)
def _(t):
    found = content.content_entropy(chunked(t("files"), SMALL_CHUNK))
    return found.withColumn("entropy", F.round("entropy", 4))


@query("chunk_section_entropy", """
SELECT s.file_id, s.seq, coalesce(round(entropy, 4), 0) AS entropy
FROM {overlay_sections} s JOIN {files} f ON f.file_id = s.file_id
LEFT JOIN {e} ON s.file_id = e.file_id AND s.seq = e.seq""", {
    "cuts": """
SELECT s.file_id, seq, unhex(substr(hex(content), CAST(2 * raw_ptr + 1 AS BIGINT), CAST(2 * raw_size AS BIGINT))) AS data
FROM {overlay_sections} s JOIN {files} f ON f.file_id = s.file_id""",
    "e": entropy_sql("{cuts}", "file_id, seq", "data")})
def _(t):
    chunks = chunk_store(chunked(t("files"), SMALL_CHUNK))
    sections = among(t("overlay_sections"), cut(t("files").select("file_id")))
    return content.section_entropy(chunks, sections, SMALL_CHUNK)


@query("memory_map", """
SELECT s.file_id, seq, name, '0x' || lower(hex(image_base + va)) AS start,
       '0x' || lower(hex(image_base + va + virtual_size)) AS "end", virtual_size,
       '0x' || lower(hex(va)) AS rva
FROM {sections} s JOIN {headers} h ON s.file_id = h.file_id""")
def _(t):
    return layout.memory_map(t("headers"), t("sections"))


@query("reloc_iat_counts", """
SELECT f.file_id, r.n IS NOT NULL AS has_relocations, coalesce(r.n, 0) AS relocation_count,
       i.n IS NOT NULL AS has_iat, coalesce(i.n, 0) AS iat_entries
FROM {file_keys} f
LEFT JOIN (SELECT file_id, count(*) AS n FROM {relocations} GROUP BY file_id) r ON f.file_id = r.file_id
LEFT JOIN (SELECT file_id, count(*) AS n FROM {imports} WHERE NOT delayed GROUP BY file_id) i
     ON f.file_id = i.file_id""")
def _(t):
    return layout.reloc_iat_counts(t("file_keys"), t("relocations"), t("imports"))


@query("tls_callbacks", """
SELECT file_id, idx, '0x' || lower(hex(ptr)) AS callback FROM (
  SELECT *, min(ptr) OVER (PARTITION BY file_id ORDER BY idx) AS low FROM {tls_pointers}) p
WHERE low <> 0""")
def _(t):
    return layout.tls_callbacks(t("tls_pointers"))


@query("resource_tree", """
SELECT file_id, seq, res_type, res_name,
       row_number() OVER (PARTITION BY file_id ORDER BY seq) - 1 AS place FROM {resources}""")
def _(t):
    return layout.resource_tree(t("resources")).select(
        "file_id", "seq", "res_type", "res_name", "place")


@query("embedded_resources", """
SELECT file_id, seq, 'embedded_pe_in_resource' AS type, 'high' AS severity,
       'executable inside resource ' || res_type || '/' || res_name || ' (' || size ||
       ' bytes)' AS detail
FROM {resources} WHERE hex(data) LIKE '4D5A%' OR regexp_matches(hex(data), '^(..)*50450000')""")
def _(t):
    return layout.embedded_resources(t("resources"))


WIDE_VERSIONS = """
SELECT file_id, max(value) FILTER (WHERE key = 'CompanyName') AS company,
       max(value) FILTER (WHERE key = 'ProductName') AS product,
       trim(lower(max(value) FILTER (WHERE key = 'CompanyName'))) AS c,
       trim(lower(max(value) FILTER (WHERE key = 'ProductName'))) AS p
FROM {version_info} GROUP BY file_id"""


@query("version_spoofing", """
SELECT file_id, 'company_name_spoofing' AS type, 'high' AS severity,
       'company ''' || company || ''' looks like ''' || goal || '''' AS detail
FROM {w} JOIN {lookalikes} ON contains(c, typo) AND c <> goal
UNION ALL SELECT file_id, 'suspicious_metadata_alignment', 'medium',
       'Company is ''' || company || ''' but product is ''' || product || ''''
FROM {w} WHERE contains(c, 'microsoft') AND p <> '' AND NOT contains(p, 'microsoft')
     AND NOT contains(p, 'windows')""", {
    "w": WIDE_VERSIONS,
    "lookalikes": values("goal, typo", [(g, x) for g, xs in rules.COMPANY_LOOKALIKES for x in xs])})
def _(t):
    return layout.version_spoofing(t("version_info"))


@query("signature_trust", """
SELECT file_id, is_signed, is_signed AND (NOT parsed OR verified) AS certificate_valid,
       is_signed AND parsed AND issuer = subject AS self_signed,
       CASE WHEN NOT is_signed THEN 0 WHEN NOT parsed THEN 50
            WHEN verified AND issuer = subject THEN 30 WHEN verified THEN 80 ELSE 20 END AS trust_score
FROM {certificates}""")
def _(t):
    return layout.signature_trust(t("certificates"))


@query("entropy_band", """
SELECT file_id, seq, CASE WHEN entropy >= 7.2 THEN 'high' WHEN entropy >= 5 THEN 'compressed'
       ELSE 'normal' END AS band FROM {sections}""")
def _(t):
    return t("sections").select("file_id", "seq", layout.entropy_band(F.col("entropy")).alias("band"))


@query("risk_band", """
SELECT id, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high'
       WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END AS band FROM {analyses}""")
def _(t):
    return t("analyses").select("id", layout.risk_band(F.col("risk_score")).alias("band"))


# --- imports and exports ----------------------------------------------------------------

BEHAVIORS = {"beh": values("api, category", [
    (a, c) for c, names in rules.BEHAVIOR_APIS.items() for a in names])}
CATEGORIES = {"cats": values("category", [(c,) for c in rules.BEHAVIOR_APIS])}


@query("classify_imports", """
SELECT file_id, seq, func, category FROM {imports} JOIN {beh} ON func = api""", BEHAVIORS)
def _(t):
    return behavior.classify_imports(t("imports")).select("file_id", "seq", "func", "category")


@query("category_hits", """
SELECT f.file_id, c.category, count(h.seq) AS hit_count FROM {file_keys} f CROSS JOIN {cats} c
LEFT JOIN (SELECT file_id, seq, category FROM {imports} JOIN {beh} ON func = api) h
     ON h.file_id = f.file_id AND h.category = c.category
GROUP BY f.file_id, c.category""", BEHAVIORS | CATEGORIES)
def _(t):
    return behavior.category_hits(t("file_keys"), t("imports"))


@query("category_hit_labels", """
SELECT file_id, category, delayed, seq, dll || '!' || func || CASE WHEN delayed THEN ' (delayed)'
       ELSE '' END AS label FROM {imports} JOIN {beh} ON func = api""", BEHAVIORS)
def _(t):
    return behavior.category_hit_labels(t("imports"))


@query("suspicious_apis", """
SELECT file_id, seq, dll, func, delayed, string_agg(category, ',') AS categories
FROM {imports} JOIN {beh} ON func = api GROUP BY file_id, seq, dll, func, delayed""", BEHAVIORS)
def _(t):
    return behavior.suspicious_apis(t("imports")).withColumn(
        "categories", F.array_join("categories", ","))


@query("import_totals", """
SELECT f.file_id, count(DISTINCT dll || CAST(delayed AS VARCHAR)) AS total_dlls,
       count(i.file_id) AS total_functions
FROM {file_keys} f LEFT JOIN {imports} i ON f.file_id = i.file_id GROUP BY f.file_id""")
def _(t):
    return behavior.import_totals(t("file_keys"), t("imports"))


@query("imphash", r"""
SELECT file_id, md5(string_agg(regexp_replace(lower(dll), '\.(dll|ocx|sys)$', '') || '.' ||
       coalesce(lower(func), 'ord' || ordinal), ',' ORDER BY seq)) AS imphash
FROM {imports} WHERE NOT delayed GROUP BY file_id""")
def _(t):
    return behavior.imphash(t("imports"))


@query("suspicious_exports", f"""
SELECT file_id, seq, name, ordinal, '''' || name || ''' is a known suspicious export name' AS reason
FROM {{exports}} WHERE name IN ({sql_list(rules.SUSPICIOUS_EXPORTS)})""")
def _(t):
    return behavior.suspicious_exports(t("exports"))


INTENTS = ", ".join(f"CASE WHEN bool_or(coalesce(name, '') IN ({sql_list(ms)})) THEN {literal(i)} END"
                    for i, ms in rules.EXPORT_INTENTS)


@query("dll_intent", f"""
SELECT file_id, total_exports, ordinal_only,
       CASE WHEN len(found) > 0 THEN array_to_string(found, ',') ELSE 'generic_library' END AS dll_intent
FROM (SELECT file_id, count(*) AS total_exports, count(*) FILTER (WHERE name IS NULL) AS ordinal_only,
             list_filter([{INTENTS}, CASE WHEN count(*) FILTER (WHERE name IS NULL) > 10 AND
                 count(*) FILTER (WHERE name IS NULL) > count(*) * 0.7 THEN 'proxy_dll' END],
                 lambda x: x IS NOT NULL) AS found
      FROM {{exports}} GROUP BY file_id) x""")
def _(t):
    return behavior.dll_intent(t("exports")).withColumn(
        "dll_intent", F.array_join("dll_intent", ","))


CHAINS = {"chains": values("sig, severity, pos, step", [
    (n, s, i, step) for n, s, chain in rules.BEHAVIOR_CHAINS for i, step in enumerate(chain)])}


@query("behavior_chains", """
SELECT file_id, sig AS signature_name, severity, CAST(floor(100 * count(api) / count(*)) AS INT) AS confidence,
       string_agg(api, ',' ORDER BY pos) AS matched,
       coalesce(string_agg(CASE WHEN api IS NULL THEN step END, ',' ORDER BY pos), '') AS missing
FROM (SELECT k.file_id, sig, severity, pos, step, min(func) AS api
      FROM (SELECT DISTINCT file_id FROM {imports}) k CROSS JOIN {chains}
      LEFT JOIN {imports} i ON i.file_id = k.file_id AND contains(i.func, step)
           AND address IS NOT NULL AND NOT delayed
      GROUP BY k.file_id, sig, severity, pos, step) x
GROUP BY file_id, sig, severity HAVING count(api) / count(*) >= 0.6""", CHAINS)
def _(t):
    return behavior.behavior_chains(t("imports")).select(
        "file_id", "signature_name", "severity", "confidence",
        F.array_join("matched_apis", ",").alias("matched"),
        F.array_join("missing_apis", ",").alias("missing"))


# --- instructions --------------------------------------------------------------------------

PROLOGUE = "(mnemonic = 'push' AND op_str = 'ebp' OR mnemonic = 'sub' AND contains(op_str, 'rsp'))"


@query("api_call_graph", f"""
SELECT p.file_id, CASE WHEN start IS NULL THEN 'unknown_offset' ELSE 'func_0x' || lower(hex(start)) END
       AS func, idx, api
FROM (SELECT *, last_value(CASE WHEN {PROLOGUE} THEN address END IGNORE NULLS)
             OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS start
      FROM {{instructions}}) p
JOIN (SELECT file_id, address AS target, arg_max(func, seq) AS api FROM {{imports}}
      WHERE func IS NOT NULL AND address IS NOT NULL AND NOT delayed GROUP BY file_id, address) i
     ON i.file_id = p.file_id AND regexp_extract(op_str, '0x[0-9a-f]+') = '0x' || lower(hex(target))
WHERE mnemonic = 'call'""")
def _(t):
    return behavior.api_call_graph(t("instructions"), t("imports"))


@query("cfg_metrics", f"""
SELECT file_id, greatest(f, 1) AS function_count, b AS basic_block_count, ic AS indirect_calls,
       ij AS indirect_jumps, b AS complexity_score, ij > 25 AS high_indirect_jumps,
       b > 50 AND f = 0 AS stripped_prologues
FROM (SELECT file_id, count(*) FILTER (WHERE {PROLOGUE}) AS f,
             count(*) FILTER (WHERE mnemonic LIKE 'j%' OR mnemonic IN ('call', 'ret')) AS b,
             count(*) FILTER (WHERE mnemonic = 'call' AND op_str NOT LIKE '0x%') AS ic,
             count(*) FILTER (WHERE mnemonic = 'jmp' AND op_str NOT LIKE '0x%') AS ij
      FROM {{instructions}} GROUP BY file_id) x""")
def _(t):
    return behavior.cfg_metrics(t("instructions"))


EVASION_APIS = {"ev": values("api, list, w", [
    *[(a, "anti_debug_apis", 15) for a in rules.ANTI_DEBUG_APIS],
    *[(a, "timing_checks", 10) for a in rules.TIMING_APIS],
    *[(a, "sandbox_evasion", 20) for a in rules.INPUT_APIS]]),
    "marks": values("mark", [(m,) for m in rules.VM_MARKERS]),
    "found": """
SELECT DISTINCT file_id, list, func AS item, w FROM {imports} JOIN {ev} ON func = api WHERE NOT delayed
UNION SELECT file_id, 'vm_detection', 'string_marker:' || mark, 15 FROM {files} JOIN {marks}
      ON regexp_matches(hex(content), '(?i)^(..)*(' || array_to_string(list_transform(
         regexp_extract_all(mark, '.'), lambda c: '(' || hex(encode(c)) || '|' ||
         hex(encode(upper(c))) || ')'), '') || ')')
UNION SELECT DISTINCT file_id, 'timing_checks', 'rdtsc', 15 FROM {instructions} WHERE mnemonic = 'rdtsc'
UNION SELECT DISTINCT file_id, 'vm_detection', 'cpuid', 10 FROM {instructions} WHERE mnemonic = 'cpuid'"""}


@query("evasion_score", """
SELECT f.file_id, count(item) FILTER (WHERE list = 'anti_debug_apis') AS anti_debug_apis,
       count(item) FILTER (WHERE list = 'timing_checks') AS timing_checks,
       count(item) FILTER (WHERE list = 'vm_detection') AS vm_detection,
       count(item) FILTER (WHERE list = 'sandbox_evasion') AS sandbox_evasion,
       coalesce(string_agg(item, ',' ORDER BY item), '') AS evidence,
       CAST(least(coalesce(sum(w), 0), 100) AS BIGINT) AS evasion_score
FROM {files} f LEFT JOIN {found} d ON f.file_id = d.file_id GROUP BY f.file_id""", EVASION_APIS)
def _(t):
    lists = ["anti_debug_apis", "timing_checks", "vm_detection", "sandbox_evasion"]
    scored = behavior.evasion_score(t("files"), t("imports"), t("instructions"))
    return scored.select("file_id", *[F.size(c).alias(c) for c in lists], F.array_join(
        F.array_sort(F.concat(*lists)), ",").alias("evidence"), "evasion_score")


OPCODE_ROWS = """
SELECT file_id, seq, base_addr, i AS pos, substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS op,
       substr(h, CAST(2 * i + 3 AS BIGINT), 8) AS arg, n
FROM (SELECT file_id, seq, base_addr, hex(data) AS h, octet_length(data) AS n,
             unnest(range(octet_length(data))) AS i FROM {code}) x"""
LE32 = ("CAST('0x' || arg[7:8] || arg[5:6] || arg[3:4] || arg[1:2] AS BIGINT)")


@query("code_patterns", f"""
SELECT file_id, seq, base_addr + pos AS address, 'CALL' AS type,
       base_addr + pos + 5 + CASE WHEN {LE32} >= 2147483648 THEN {LE32} - 4294967296 ELSE {LE32} END
       AS target FROM {{ops}} WHERE op = 'E8' AND pos + 4 < n
UNION ALL SELECT file_id, seq, base_addr + pos, 'RETURN', NULL FROM {{ops}} WHERE op = 'C3'
UNION ALL SELECT file_id, seq, base_addr + pos, 'BRANCH',
       base_addr + pos + 5 + CASE WHEN {LE32} >= 2147483648 THEN {LE32} - 4294967296 ELSE {LE32} END
       FROM {{ops}} WHERE op = 'E9' AND pos + 4 < n
UNION ALL SELECT file_id, seq, base_addr + pos, 'BRANCH', base_addr + pos + 2 +
       CASE WHEN CAST('0x' || arg[1:2] AS BIGINT) >= 128 THEN CAST('0x' || arg[1:2] AS BIGINT) - 256
            ELSE CAST('0x' || arg[1:2] AS BIGINT) END
       FROM {{ops}} WHERE op = 'EB' AND pos + 1 < n""", {"ops": OPCODE_ROWS})
def _(t):
    return behavior.code_patterns(t("code"))


@query("map_pcode", """
SELECT file_id, seq, coalesce(p.kind, 'UNKNOWN') AS inst_type,
       coalesce('<operator>.' || o.op, '') AS operator_type
FROM {pcode_ops} x LEFT JOIN {pk} p ON x.pcode = p.pcode LEFT JOIN {ok} o ON p.kind = o.kind""", {
    "pk": values("pcode, kind", list(rules.PCODE_TYPES.items())),
    "ok": values("kind, op", list(rules.OPERATOR_OF_TYPE.items()))})
def _(t):
    return behavior.map_pcode(t("pcode_ops")).select(
        "file_id", "seq", "inst_type", F.coalesce("operator_type", F.lit("")).alias("operator_type"))


@query("cfg_findings", """
SELECT file_id, 'high_indirect_jumps' AS type, 'medium' AS severity,
       'indirect jumps: ' || n
       AS detail
FROM (SELECT file_id, count(*) AS n FROM {instructions}
      WHERE mnemonic = 'jmp' AND op_str NOT LIKE '0x%' GROUP BY file_id) x WHERE n > 25
UNION ALL SELECT file_id, 'stripped_prologues', 'medium', 'many blocks without a known function start'
FROM (SELECT file_id FROM {instructions} GROUP BY file_id HAVING
      count(*) FILTER (WHERE mnemonic LIKE 'j%' OR mnemonic IN ('call', 'ret')) > 50 AND
      count(*) FILTER (WHERE mnemonic = 'push' AND op_str = 'ebp' OR mnemonic = 'sub'
                       AND contains(op_str, 'rsp')) = 0) y""")
def _(t):
    return behavior.cfg_findings(t("instructions"))


#: Tables that several analyzers read, and one that meets the content.
REPORT_TABLES = ["file_keys", "headers", "sections", "imports", "instructions", "compiler_sections",
                 "overlay_sections"]


def report_parts(t: Tables) -> dict:
    """Operators of the 15 analyzers by the analyzer's name, and a part that fails."""
    files, keys, headers, sections = t("files"), t("file_keys"), t("headers"), t("sections")
    imports, exports, instructions = t("imports"), t("exports"), t("instructions")
    compilers = lambda: layout.compiler_fingerprint(headers, t("compiler_sections"), files)
    return {
        "headers": lambda: layout.decode_enums(headers),
        "headers.flags": lambda: layout.decode_flags(headers),
        "headers.anomalies": lambda: layout.header_anomalies(headers, F.lit(NOW)),
        "headers.entry_point": lambda: layout.entry_point_outside(headers, sections),
        "sections": lambda: layout.section_flags(sections),
        "sections.entropy": lambda: layout.section_entropy(t("section_bytes")),
        "sections.red_flags": lambda: layout.section_red_flags(sections),
        "imports": lambda: behavior.import_totals(keys, imports),
        "imports.hash": lambda: behavior.imphash(imports),
        "imports.suspicious": lambda: behavior.suspicious_apis(imports),
        "imports.categories": lambda: behavior.category_hits(keys, imports),
        "imports.chains": lambda: behavior.behavior_chains(imports),
        "exports": lambda: behavior.dll_intent(exports),
        "exports.suspicious": lambda: behavior.suspicious_exports(exports),
        "strings": lambda: text_rules.categorize_strings(text_rules.extract_strings(files)),
        "resources": lambda: layout.resource_tree(t("resources").drop("data")),
        "resources.embedded": lambda: layout.embedded_resources(t("resources")),
        "resources.version": lambda: layout.version_spoofing(t("version_info")),
        "entropy": lambda: layout.file_entropy(files).select("file_id", "file_entropy", "entropy_class"),
        "entropy.packing": lambda: layout.packing_likelihood(keys, sections),
        "cfg": lambda: behavior.cfg_metrics(instructions),
        "cfg.findings": lambda: behavior.cfg_findings(instructions),
        "api_call_graph": lambda: behavior.api_call_graph(instructions, imports),
        "signatures": lambda: text_rules.scan_signatures(files),
        "signatures.rules": lambda: text_rules.scan_rules(files),
        "packer": lambda: layout.packer_fingerprint(sections),
        "packer.score": lambda: layout.packing_score(layout.file_entropy(files), sections).drop("content"),
        "debug_features": lambda: layout.linker_anomalies(
            headers, compilers(), layout.packer_fingerprint(sections)),
        "debug_features.compiler": compilers,
        "debug_features.rich": lambda: layout.rich_entries(t("rich_values")),
        "debug_features.evasion": lambda: behavior.evasion_score(files, imports, instructions),
        "certificate": lambda: layout.signature_trust(t("certificates")),
        "overlay": lambda: layout.overlay(files, t("overlay_sections")),
        "memory_layout": lambda: layout.memory_map(headers, sections),
        "memory_layout.counts": lambda: layout.reloc_iat_counts(keys, t("relocations"), imports),
        "memory_layout.tls": lambda: layout.tls_callbacks(t("tls_pointers")),
        "broken": lambda: headers.select("file_id", "no_such_column"),
    }


@query("deep_report", f"""
SELECT f.file_id, {ENTROPY_CLASS} AS entropy_class, coalesce(n, 0) AS total_functions, 1 AS failed_parts
FROM {{files}} f LEFT JOIN {{e}} ON f.file_id = e.file_id
LEFT JOIN (SELECT file_id, count(*) AS n FROM {{imports}} GROUP BY file_id) i ON f.file_id = i.file_id""",
       FILE_ENTROPY)
def _(t):
    ids = cut(t("files").select("file_id"))
    t.keep("files")  # content is read by nine parts
    for name in REPORT_TABLES:
        t.keep(name, ids)
    report = behavior.deep_report(t("files"), report_parts(t))
    shown = F.col("part").isin("entropy", "imports") | F.col("error").isNotNull()
    field = lambda part, name: F.max(F.when(
        F.col("part") == part, F.get_json_object("body", f"$.{name}")))
    return report.where(shown).groupBy("file_id").agg(
        field("entropy", "entropy_class").alias("entropy_class"),
        F.coalesce(field("imports", "total_functions").cast("bigint"), F.lit(0)).alias("total_functions"),
        F.count_if(F.col("error").isNotNull()).cast("int").alias("failed_parts"))
