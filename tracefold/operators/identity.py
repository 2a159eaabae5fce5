"""File identification, routing, names and labels (narrow projections)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold import rules
from tracefold.functions.literals import any_of, first_match, lookup, raw


def suffix(name: Column) -> Column:
    """Last suffix with its dot; a leading dot or a trailing dot is no suffix."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def magic_type(content: Column) -> Column:
    """Type of the first matching header prefix, else the ISO mark, else null."""
    mark, offset, iso = rules.ISO_MARK
    tests = [(F.startswith(content, raw(prefix)), F.lit(kind))
             for prefix, kind in rules.MAGIC_PREFIXES]
    is_iso = ((F.octet_length(content) > offset + 5)
              & (F.substring(content, offset + 1, 5) == raw(mark)))
    return first_match(tests + [(is_iso, F.lit(iso))])


def extension_type(name: Column) -> Column:
    return F.coalesce(lookup(F.lower(suffix(name)), rules.type_of_extension()),
                      F.lit("unknown"))


def category_of(file_type: Column) -> Column:
    return F.coalesce(lookup(file_type, rules.category_of_type()), F.lit("unknown"))


def identify_magic(files: DataFrame) -> DataFrame:
    return files.withColumn("magic_type", magic_type(F.col("content")))


def identify_extension(files: DataFrame) -> DataFrame:
    return files.withColumn("ext_type", extension_type(F.col("name")))


def identify(files: DataFrame) -> DataFrame:
    """Type, category, confidence and polyglot flag before refinement."""
    magic, ext = F.col("magic_type"), F.col("ext_type")
    polyglot = magic.isNotNull() & (ext != "unknown") & (ext != magic)
    return (identify_extension(identify_magic(files))
            .withColumn("file_type", F.coalesce(magic, ext))
            .withColumn("category", category_of(F.col("file_type")))
            .withColumn("confidence", F.when(magic.isNotNull(), 0.9).otherwise(0.7))
            .withColumn("is_polyglot", polyglot)
            .withColumn("secondary_types",
                        F.when(polyglot, F.array(ext)).otherwise(F.array().cast("array<string>"))))


def refine_pe(files: DataFrame, headers: DataFrame) -> DataFrame:
    """Split executables into exe / dll / sys / scr / cpl by header and hint."""
    facts = headers.select("file_id", "characteristics", "subsystem")
    is_dll = F.col("characteristics").bitwiseAND(F.lit(0x2000)) != 0
    refined = first_match(
        [(is_dll, F.lit("dll")), (F.col("subsystem") == 1, F.lit("sys")),
         (F.col("ext_type").isin(rules.PE_HINT_TYPES), F.col("ext_type"))],
        F.lit("exe"))
    # Tested before the join: content that nobody reads later is not shuffled.
    starts = F.startswith(F.col("content"), raw("4D5A"))
    return (files.withColumn("_starts", starts).join(facts, "file_id", "left")
            .withColumn("file_type", F.when((F.col("file_type") == "exe") & F.col("_starts"), refined)
                        .otherwise(F.col("file_type")))
            .withColumn("category", category_of(F.col("file_type")))
            .drop("characteristics", "subsystem", "_starts"))


def refine_zip(files: DataFrame, members: DataFrame) -> DataFrame:
    """Recognise packages inside ZIP files from their member names."""
    name, hint = F.col("member_path"), F.col("ext_type")
    facts = members.groupBy(F.col("container_id").alias("file_id")).agg(
        F.bool_or(name == "AndroidManifest.xml").alias("_manifest"),
        F.bool_or(name == "classes.dex").alias("_dex"),
        F.bool_or(F.endswith(name, F.lit(".class"))
                  | (name == "META-INF/MANIFEST.MF")).alias("_jar"),
        F.bool_or(name == "[Content_Types].xml").alias("_office"),
        F.bool_or(F.contains(name, F.lit("word/"))).alias("_word"),
        F.bool_or(F.contains(name, F.lit("xl/"))).alias("_xl"),
        F.bool_or(F.contains(name, F.lit("ppt/"))).alias("_ppt"))
    office = F.col("_office")
    refined = first_match(
        [(F.col("_manifest") & F.col("_dex"), F.lit("apk")),
         (F.col("_jar"), F.lit("jar")),
         (office & F.col("_word"), F.when(hint == "docm", "docm").otherwise("docx")),
         (office & F.col("_xl"), F.when(hint == "xlsm", "xlsm").otherwise("xlsx")),
         (office & F.col("_ppt"), F.lit("pptx")),
         (hint.isin(rules.ZIP_HINT_TYPES), hint)],
        F.lit("zip"))
    return (files.join(facts, "file_id", "left")
            .withColumn("file_type", F.when(F.col("file_type") == "zip", refined)
                        .otherwise(F.col("file_type")))
            .withColumn("category", category_of(F.col("file_type")))
            .drop(*[c for c in facts.columns if c.startswith("_")]))


def refine_ole(files: DataFrame, streams: DataFrame) -> DataFrame:
    """Recognise installer and office files inside OLE compound documents."""
    name, hint = F.col("stream"), F.col("ext_type")
    facts = streams.groupBy("file_id").agg(
        F.bool_or(name.isin(rules.OLE_INSTALLER_STREAMS)).alias("_msi"),
        F.bool_or(name == "WordDocument").alias("_doc"),
        F.bool_or(name.isin("Workbook", "Book")).alias("_xls"),
        F.bool_or(name == "PowerPoint Document").alias("_ppt"))
    refined = first_match(
        [(F.col("_msi"), F.lit("msi")), (F.col("_doc"), F.lit("doc")),
         (F.col("_xls"), F.lit("xls")), (F.col("_ppt"), F.lit("ppt")),
         (hint.isin(rules.OLE_HINT_TYPES), hint)],
        F.lit("doc"))
    starts = F.startswith(F.col("content"), raw("D0CF11E0"))
    return (files.withColumn("_starts", starts).join(facts, "file_id", "left")
            .withColumn("file_type", F.when((F.col("file_type") == "doc") & F.col("_starts"), refined)
                        .otherwise(F.col("file_type")))
            .withColumn("category", category_of(F.col("file_type")))
            .drop("_msi", "_doc", "_xls", "_ppt", "_starts"))


def is_container(category: Column) -> Column:
    return category.isin(rules.CONTAINER_CATEGORIES)


def is_executable(category: Column) -> Column:
    return category.isin(rules.EXECUTABLE_CATEGORIES)


def type_flags(files: DataFrame) -> DataFrame:
    return (files.withColumn("is_container", is_container(F.col("category")))
            .withColumn("is_executable", is_executable(F.col("category"))))


def route(files: DataFrame) -> DataFrame:
    """Analysis route of identified files, with the text fallback."""
    text = (F.octet_length("content") > 0) & ~F.contains("content", raw("00"))
    ext = F.lower(F.regexp_replace(suffix(F.col("name")), r"^\.+", ""))
    known = first_match([(F.col("file_type").isin(types), F.lit(name))
                         for name, types in rules.ROUTE_TYPES.items()])
    fallback = F.col("_known").isNull() & text
    return (files.withColumn("_known", known)
            .withColumn("route", F.coalesce("_known", F.when(text, "script")
                                            .otherwise("unsupported")))
            .withColumn("file_type", F.when(fallback, F.when(ext == "", "text").otherwise(ext))
                        .otherwise(F.col("file_type")))
            .withColumn("category", F.when(fallback, "script").otherwise(F.col("category")))
            .withColumn("confidence", F.when(fallback, 0.8).otherwise(F.col("confidence")))
            .drop("_known"))


def normal_path(path: Column) -> Column:
    """Collapse ``.``, ``..`` and empty parts of a relative path."""
    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        skip = part.isin("", ".")
        return (F.when(skip, done)
                .when(up, F.slice(done, F.lit(1), F.size(done) - 1))
                .otherwise(F.array_append(done, part)))
    # The guard keeps element_at away from the empty array.
    def guarded(done: Column, part: Column) -> Column:
        return F.when((F.size(done) == 0) & ~part.isin("", "."), F.array(part)).when(
            F.size(done) == 0, done).otherwise(step(done, part))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), guarded)
    joined = F.array_join(parts, "/")
    return F.when(joined == "", ".").otherwise(joined)


def safe_member_path(members: DataFrame) -> DataFrame:
    """Skip directories and drop escaping paths."""
    bare = F.regexp_replace("member_path", r"^[/\\]+", "")
    return (members.where(~F.endswith("member_path", F.lit("/")))
            .withColumn("safe_path", normal_path(bare))
            .where(~F.startswith("safe_path", F.lit(".."))))


def safe_disk_path(directory: Column, name: Column) -> Column:
    """Disk-image variant: any ``..`` rejects the entry (null)."""
    folder = F.replace(F.regexp_replace(directory, r"^[/\\]+", ""), F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    joined = F.when(folder.isin("", "."), base).otherwise(
        F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), base))
    return F.when(~F.contains(folder, F.lit("..")) & ~F.contains(base, F.lit("..")), joined)


def safe_file_name(name: Column) -> Column:
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    return F.when(clean == "", "unnamed").otherwise(clean)


def upload_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")


def looks_like_script(content: Column) -> Column:
    return any_of(F.contains(content, raw(m.encode().hex())) for m in rules.SCRIPT_MARKERS)


def file_info(files: DataFrame) -> DataFrame:
    """Summary of an identified file."""
    return type_flags(files).withColumn(
        "has_lifter", F.col("category").isin(rules.LIFTER_CATEGORIES))


def label_by_folder(path: Column) -> Column:
    """1 when the parent folder name says malware or malicious."""
    folder = F.lower(F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit("")))
    bad = F.contains(folder, F.lit("malware")) | F.contains(folder, F.lit("malicious"))
    return F.when(bad, 1).otherwise(0)


def label_by_path(files: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Known label first, then the path, then benign."""
    path = F.lower("path")
    inferred = first_match(
        [(path.rlike(r"[/\\]benigns?[/\\]"), F.lit(0)),
         (path.rlike(r"[/\\]malwares?[/\\]"), F.lit(1))], F.lit(0))
    if labels is None:
        return files.withColumn("label", inferred)
    known = labels.select("file_id", F.col("label").alias("_label"))
    return (files.join(known, "file_id", "left")
            .withColumn("label", F.coalesce("_label", inferred)).drop("_label"))
