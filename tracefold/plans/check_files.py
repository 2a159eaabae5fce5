"""Queries over listings, file identity, routing, names and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import rules
from tracefold.operators import features, identity
from tracefold.plans.catalog import query
from tracefold.plans.views import literal, values
from tracefold.sources import files as listing_ops

MAGIC = values("rank, prefix, kind", [(i, p, k) for i, (p, k) in enumerate(rules.MAGIC_PREFIXES)])
EXTS = values("ext, kind", list(rules.type_of_extension().items()))
TYPES = values("kind, category", list(rules.category_of_type().items()))
SUFFIX = r"regexp_extract(name, '^.+(\.[^.]+)$', 1)"
IDENT = f"""
SELECT f.file_id, f.name, f.content, m.kind AS magic, coalesce(e.kind, 'unknown') AS ext,
       coalesce(m.kind, e.kind, 'unknown') AS file_type
FROM {{files}} f
LEFT JOIN (SELECT file_id, min_by(kind, rank) AS kind FROM {{files}}
           JOIN magic ON starts_with(hex(content), prefix) GROUP BY file_id) m
     ON f.file_id = m.file_id
LEFT JOIN exts e ON lower({SUFFIX}) = e.ext"""
BASE = {"magic": MAGIC, "exts": EXTS, "types": TYPES, "ident": IDENT}


def sql_list(items: list[str]) -> str:
    return ", ".join(literal(i) for i in items)


@query("scan_files", f"""
SELECT path, name, size FROM {{listing}}
WHERE left(name, 1) <> '.' AND {SUFFIX} NOT IN ('.json', '.msgpack', '.cpg')
  AND ltrim(lower({SUFFIX}), '.') IN ('exe', 'dll', 'js', 'gz')""")
def _(t):
    return listing_ops.scan_files(t("listing"), ["exe", ".DLL", "JS", "gz"])


@query("number_files", """
SELECT path, i AS file_index, CASE WHEN length(CAST(i AS VARCHAR)) < 6
       THEN lpad(CAST(i AS VARCHAR), 6, '0') ELSE CAST(i AS VARCHAR) END AS index_name
FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM {listing}) x""")
def _(t):
    return listing_ops.number_files(t("listing"))


@query("dataset_stats", f"""
SELECT coalesce(ext, '(all)') AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
       round(sum(size) / 1048576e0, 6) AS megabytes
FROM (SELECT CASE WHEN {SUFFIX} = '' THEN '(none)' ELSE lower({SUFFIX}) END AS ext, size
      FROM {{listing}} WHERE left(name, 1) <> '.') x GROUP BY ROLLUP (ext)""")
def _(t):
    return listing_ops.dataset_stats(t("listing")).withColumn(
        "megabytes", F.round("megabytes", 6))


@query("top_extensions", f"""
SELECT ext, count(*) AS files FROM (
  SELECT CASE WHEN {SUFFIX} = '' THEN '(none)' ELSE lower({SUFFIX}) END AS ext
  FROM {{listing}} WHERE left(name, 1) <> '.') x GROUP BY ext ORDER BY files DESC, ext LIMIT 5""")
def _(t):
    return listing_ops.top_extensions(t("listing"), 5).select("ext", "files")


def _batch(t):
    return t("orders").select(
        F.col("o_orderkey").cast("string").alias("path"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 4).alias("num_nodes"),
        F.when(F.col("o_orderkey") % 11 == 0, "boom").alias("error"))


@query("batch_summary", """
SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS successful,
       count(*) FILTER (WHERE NOT ok) AS failed, count(*) / 20e0 AS files_per_second
FROM (SELECT o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey % 4 <> 0 AS ok
      FROM {orders}) x""")
def _(t):
    return listing_ops.batch_summary(_batch(t), 20.0)


@query("batch_errors", """
SELECT CAST(o_orderkey AS VARCHAR) AS path,
       CASE WHEN o_orderkey % 11 = 0 THEN 'boom' WHEN o_orderkey % 7 = 0
            THEN 'CPG generation returned None' ELSE 'Empty CPG (0 nodes)' END AS error
FROM {orders} WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 OR o_custkey % 4 = 0""")
def _(t):
    return listing_ops.batch_outcomes(_batch(t)).where(~F.col("success")).drop("success")


# --- identity -----------------------------------------------------------------------

@query("identify_magic", "SELECT file_id, coalesce(magic, 'none') AS magic_type FROM {ident}", BASE)
def _(t):
    return identity.identify_magic(t("files")).select(
        "file_id", F.coalesce("magic_type", F.lit("none")).alias("magic_type"))


@query("identify_extension", "SELECT file_id, ext AS ext_type FROM {ident}", BASE)
def _(t):
    return identity.identify_extension(t("files")).select("file_id", "ext_type")


@query("identify", """
SELECT file_id, file_type, category, CASE WHEN magic IS NULL THEN 0.7e0 ELSE 0.9e0 END AS confidence,
       magic IS NOT NULL AND ext <> 'unknown' AND ext <> magic AS is_polyglot,
       CASE WHEN magic IS NOT NULL AND ext <> 'unknown' AND ext <> magic THEN ext ELSE '' END
           AS secondary
FROM {ident} JOIN {types} ON file_type = kind""", BASE)
def _(t):
    return identity.identify(t("files")).select(
        "file_id", "file_type", "category", "confidence", "is_polyglot",
        F.array_join("secondary_types", ",").alias("secondary"))


@query("refine_pe", """
SELECT file_id, file_type, category FROM (
  SELECT i.file_id, CASE WHEN file_type <> 'exe' THEN file_type
      WHEN characteristics & 8192 <> 0 THEN 'dll' WHEN subsystem = 1 THEN 'sys'
      WHEN ext IN ('dll', 'sys', 'scr', 'cpl') THEN ext ELSE 'exe' END AS file_type
  FROM {ident} i LEFT JOIN {headers} h ON i.file_id = h.file_id
  WHERE magic = 'exe' OR file_type <> 'exe'
  UNION ALL SELECT file_id, file_type FROM {ident} WHERE magic IS DISTINCT FROM 'exe' AND file_type = 'exe') x
JOIN {types} ON file_type = kind""", BASE)
def _(t):
    return identity.refine_pe(identity.identify(t("files")), t("headers")).select(
        "file_id", "file_type", "category")


@query("refine_zip", f"""
SELECT file_id, CASE WHEN file_type <> 'zip' THEN file_type
    WHEN man AND dex THEN 'apk' WHEN jar THEN 'jar'
    WHEN office AND word THEN CASE WHEN ext = 'docm' THEN 'docm' ELSE 'docx' END
    WHEN office AND xl THEN CASE WHEN ext = 'xlsm' THEN 'xlsm' ELSE 'xlsx' END
    WHEN office AND ppt THEN 'pptx' WHEN ext IN ({sql_list(rules.ZIP_HINT_TYPES)}) THEN ext
    ELSE 'zip' END AS file_type
FROM {{ident}} LEFT JOIN (
  SELECT container_id, bool_or(member_path = 'AndroidManifest.xml') AS man,
         bool_or(member_path = 'classes.dex') AS dex,
         bool_or(member_path LIKE '%.class' OR member_path = 'META-INF/MANIFEST.MF') AS jar,
         bool_or(member_path = '[Content_Types].xml') AS office,
         bool_or(contains(member_path, 'word/')) AS word,
         bool_or(contains(member_path, 'xl/')) AS xl,
         bool_or(contains(member_path, 'ppt/')) AS ppt
  FROM {{zip_members}} GROUP BY container_id) m ON file_id = container_id""", BASE)
def _(t):
    return identity.refine_zip(identity.identify(t("files")), t("zip_members")).select(
        "file_id", "file_type")


@query("refine_ole", """
SELECT file_id, CASE WHEN file_type <> 'doc' OR magic IS DISTINCT FROM 'doc' THEN file_type
    WHEN msi THEN 'msi' WHEN word THEN 'doc' WHEN xls THEN 'xls' WHEN ppt THEN 'ppt'
    WHEN ext IN ('doc', 'xls', 'ppt', 'msi') THEN ext ELSE 'doc' END AS file_type
FROM {ident} LEFT JOIN (
  SELECT file_id AS fid, bool_or(stream = '_Tables') AS msi, bool_or(stream = 'WordDocument') AS word,
         bool_or(stream IN ('Workbook', 'Book')) AS xls,
         bool_or(stream = 'PowerPoint Document') AS ppt
  FROM {ole_streams} GROUP BY file_id) s ON file_id = fid""", BASE)
def _(t):
    return identity.refine_ole(identity.identify(t("files")), t("ole_streams")).select(
        "file_id", "file_type")


@query("type_flags", """
SELECT file_id, category IN ('archive', 'installer') AS is_container,
       category IN ('native_binary', 'managed_code', 'script', 'launcher') AS is_executable
FROM {ident} JOIN {types} ON file_type = kind""", BASE)
def _(t):
    return identity.type_flags(identity.identify(t("files"))).select(
        "file_id", "is_container", "is_executable")


ROUTES = values("kind, route", [(k, r) for r, kinds in rules.ROUTE_TYPES.items() for k in kinds])
TEXTUAL = "octet_length(content) > 0 AND NOT regexp_matches(hex(content), '^(..)*00')"


@query("route", f"""
SELECT file_id, coalesce(r.route, CASE WHEN txt THEN 'script' ELSE 'unsupported' END) AS route,
       CASE WHEN r.route IS NULL AND txt THEN coalesce(nullif(ltrim(lower({SUFFIX}), '.'), ''), 'text')
            ELSE file_type END AS file_type,
       CASE WHEN r.route IS NULL AND txt THEN 'script' ELSE category END AS category,
       CASE WHEN r.route IS NULL AND txt THEN 0.8e0 WHEN magic IS NULL THEN 0.7e0 ELSE 0.9e0 END
           AS confidence
FROM (SELECT *, {TEXTUAL} AS txt FROM {{ident}}) i
JOIN {{types}} ty ON i.file_type = ty.kind LEFT JOIN {{routes}} r ON i.file_type = r.kind""",
       BASE | {"routes": ROUTES})
def _(t):
    return identity.route(identity.identify(t("files"))).select(
        "file_id", "route", "file_type", "category", "confidence")


@query("safe_member_path", """
SELECT container_id, member_seq, CASE member_path
    WHEN '/abs/./x/../y' THEN 'abs/y' WHEN 'docs/' THEN 'docs' ELSE
    CASE WHEN member_path LIKE '%/./x/../y/..' THEN 'abs' ELSE member_path END END AS safe_path
FROM {zip_members}
WHERE member_path NOT LIKE '%/' AND ltrim(member_path, '/') NOT LIKE '..%'""")
def _(t):
    return identity.safe_member_path(t("zip_members")).select(
        "container_id", "member_seq", "safe_path")


@query("safe_disk_path", """
SELECT entry_id, CASE WHEN contains(folder, '..') OR contains(base, '..') THEN NULL
                      WHEN folder IN ('', '.') THEN base ELSE regexp_replace(folder, '/+$', '') || '/' || base END AS safe_path
FROM (SELECT entry_id, replace(ltrim(directory, '/' || chr(92)), chr(92), '/') AS folder,
             string_split(replace(name, chr(92), '/'), '/')[-1] AS base FROM {disk_entries}) x""")
def _(t):
    return t("disk_entries").select(
        "entry_id", identity.safe_disk_path(F.col("directory"), F.col("name")).alias("safe_path"))


@query("safe_file_name", r"""
SELECT page_id, coalesce(nullif(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ''),
       'unnamed') AS safe, regexp_replace(url, '[^\pL\pN._-]', '', 'g') AS upload FROM {pages}""")
def _(t):
    return t("pages").select("page_id", identity.safe_file_name(F.col("url")).alias("safe"),
                             identity.upload_file_name(F.col("url")).alias("upload"))


@query("looks_like_script", f"""
SELECT file_id, list_bool_or(list_transform([{sql_list(
    [m.encode().hex().upper() for m in rules.SCRIPT_MARKERS])}],
    lambda m: regexp_matches(hex(content), '^(..)*' || m))) AS is_script
FROM (SELECT page_id AS file_id, encode(html) AS content FROM {{pages}}
      UNION ALL SELECT file_id, encode(code) AS content FROM {{macros}}) x""")
def _(t):
    both = t("pages").select(F.col("page_id").alias("file_id"), F.encode("html", "UTF-8")
                             .alias("content")).unionByName(
        t("macros").select("file_id", F.encode("code", "UTF-8").alias("content")))
    return both.select("file_id", identity.looks_like_script(F.col("content")).alias("is_script"))


@query("file_info", """
SELECT file_id, file_type, category,
       magic IS NOT NULL AND ext <> 'unknown' AND ext <> magic AS is_polyglot,
       category IN ('archive', 'installer') AS is_container,
       category IN ('native_binary', 'script', 'office_ole', 'rich_doc', 'launcher') AS has_lifter
FROM {ident} JOIN {types} ON file_type = kind""", BASE)
def _(t):
    return identity.file_info(identity.identify(t("files"))).select(
        "file_id", "file_type", "category", "is_polyglot", "is_container", "has_lifter")


@query("label_by_folder", """
SELECT file_id, CASE WHEN lower(path) LIKE '/corpus/malware/%' OR
       lower(path) LIKE '/corpus/malicious%' THEN 1 ELSE 0 END AS label FROM {files}""")
def _(t):
    return t("files").select("file_id", identity.label_by_folder(F.col("path")).alias("label"))


@query("label_by_path", """
SELECT file_id, coalesce(toxic, CASE WHEN lower(path) LIKE '%/benign/%' OR lower(path) LIKE '%/benigns/%'
       THEN 0 WHEN lower(path) LIKE '%/malware/%' OR lower(path) LIKE '%/malwares/%' THEN 1
       ELSE 0 END) AS label
FROM {files} LEFT JOIN {labels} ON file_id = doc_id""")
def _(t):
    return identity.label_by_path(t("files"), t("samples")).select("file_id", "label")


@query("dedupe_content", """
SELECT min(file_id) AS file_id, sha256(content) AS sha256 FROM {files}
WHERE sha256(content) NOT IN (SELECT sha256(content) FROM {files} WHERE file_id % 10 = 0)
GROUP BY sha256(content)""")
def _(t):
    files = t("files").select("file_id", "content")
    known = files.where(F.col("file_id") % 10 == 0).select(
        features.content_hash(F.col("content")).alias("sha256"))
    return features.dedupe_content(files, known).select("file_id", "sha256")


@query("cache_key", "SELECT file_id, left(md5(path), 16) AS cache_key FROM {files}")
def _(t):
    return t("files").select("file_id", features.cache_key(F.col("path")).alias("cache_key"))
