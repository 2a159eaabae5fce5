"""Verdicts, indicators and the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracefold import rules
from tracefold.functions.literals import first_match
from tracefold.operators.ordering import text_pieces
from tracefold.operators.text_rules import url_domain


def aggregate_verdict(analyses: DataFrame, parts: DataFrame) -> DataFrame:
    """Verdict and report of each analysis from its parts (executables before scripts).

    Any MALWARE part decides; risk and confidence are maxima.  An analysis without parts is
    BENIGN with fixed text.  A report is one cell here; :func:`verdict_reports` has it in pieces.
    """
    entry = F.struct(scripts_last().alias("after"), "part_seq", part_report().alias("text"))
    facts = parts.where(F.col("analysis_id").isNotNull()).groupBy("analysis_id").agg(
        F.bool_or(F.col("verdict") == "MALWARE").alias("_bad"),
        F.max("risk_score").alias("_risk"), F.max("confidence").alias("_conf"),
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "")
        .alias("_report"))
    return analyses.select("analysis_id").join(facts, "analysis_id", "left").select(
        "analysis_id",
        F.when(F.col("_bad"), "MALWARE").otherwise("BENIGN").alias("verdict"),
        F.greatest(F.coalesce("_risk", F.lit(0.0)), F.lit(0.0)).alias("risk_score"),
        F.when(F.col("_bad").isNull(), 100.0)
        .otherwise(F.greatest(F.col("_conf"), F.lit(0.0))).alias("confidence"),
        F.coalesce("_report", F.lit(rules.EMPTY_REPORT)).alias("report_markdown"))


def part_report() -> Column:
    return F.concat(F.lit("\n\n# "), F.when(F.col("kind") == "pe", "PE").otherwise("Script"),
                    F.lit(" Analysis: "), "file_name", F.lit("\n"),
                    F.coalesce("report_markdown", F.lit("")))


def scripts_last() -> Column:
    return F.coalesce(F.col("kind") != "pe", F.lit(True))


def verdict_reports(analyses: DataFrame, parts: DataFrame, rows: int = 1024) -> DataFrame:
    """(analysis_id, scripts, piece, report_markdown): the report of each analysis in order.

    Executables come before scripts; pieces of bounded size follow each other without a
    separator.  An analysis without parts has one piece of fixed text.
    """
    pieces = text_pieces(parts.withColumn("scripts", scripts_last()), ["analysis_id", "scripts"], "part_seq",
                         part_report(), "", rows)
    return (analyses.select("analysis_id").join(pieces, "analysis_id", "left")
            .select("analysis_id", F.coalesce("scripts", F.lit(False)).alias("scripts"),
                    F.coalesce("piece", F.lit(0)).cast("bigint").alias("piece"),
                    F.coalesce("text", F.lit(rules.EMPTY_REPORT)).alias("report_markdown")))


def iocs_from_strings(categorized: DataFrame) -> DataFrame:
    """URL and address strings as indicator rows."""
    pick = lambda i: first_match([(F.col("category") == c, F.lit(v[i]))
                                  for c, v in rules.IOC_CONTEXTS.items()])
    return (categorized.where(F.col("category").isin(list(rules.IOC_CONTEXTS)))
            .select("file_id", pick(0).alias("ioc_type"), F.col("s").alias("ioc_value"),
                    pick(1).alias("context")))


def get_by_id(analyses: DataFrame, analysis_id) -> DataFrame:
    return analyses.where(F.col("id") == analysis_id)


def get_by_hash(analyses: DataFrame, file_hash: str) -> DataFrame:
    return analyses.where(F.col("file_hash") == file_hash)


def recent_analyses(analyses: DataFrame, limit: int = 50) -> DataFrame:
    """Newest analyses (ties by id); planned as a top-k, without a full sort."""
    return analyses.orderBy(F.desc("created_at"), "id").limit(limit)


def search_ioc(iocs: DataFrame, analyses: DataFrame, value: str) -> DataFrame:
    """Analyses that hold an indicator; rows without an analysis vanish."""
    hits = iocs.where(F.col("ioc_value") == value)
    return hits.join(analyses, hits.analysis_id == analyses.id).select(
        "id", "file_name", "verdict", "risk_score", "ioc_type", "context")


def entity_history(iocs: DataFrame, analyses: DataFrame, ioc_type: str,
                   value: str) -> DataFrame:
    """Analyses where an entity was seen, newest first."""
    hits = iocs.where((F.col("ioc_type") == ioc_type) & (F.col("ioc_value") == value)) \
        .select("analysis_id", "context", "created_at")
    facts = analyses.select(F.col("id").alias("analysis_id"), "file_name", "verdict",
                            "risk_score")
    return hits.join(facts, "analysis_id").orderBy(F.desc("created_at"), "analysis_id")


def related_entities(iocs: DataFrame, value: str) -> DataFrame:
    """Other indicators in the analyses that hold ``value``."""
    seen = iocs.where(F.col("ioc_value") == value).select("analysis_id").distinct()
    return (iocs.where(F.col("ioc_value") != value)
            .join(seen, "analysis_id", "left_semi")
            .select("ioc_type", "ioc_value", "context", "analysis_id"))


def related_counts(iocs: DataFrame, watched: DataFrame) -> DataFrame:
    """How many analyses each indicator shares with any watched value.

    The batch form for a watch list (column ``ioc_value``): a semi join and one
    count, so co-occurring pairs are never written out.
    """
    seen = (iocs.join(watched.select("ioc_value").distinct(), "ioc_value", "left_semi")
            .select("analysis_id").distinct())
    return (iocs.join(watched.select("ioc_value").distinct(), "ioc_value", "left_anti")
            .join(seen, "analysis_id", "left_semi")
            .groupBy("ioc_type", "ioc_value")
            .agg(F.countDistinct("analysis_id").alias("shared_analyses")))


def high_risk_entities(iocs: DataFrame, level: int = rules.HIGH_RISK_LEVEL) -> DataFrame:
    columns = ["ioc_type", "ioc_value", "context", "threat_level", "analysis_id"]
    return (iocs.where(F.col("threat_level") >= level).select(*columns).distinct()
            .orderBy(F.desc("threat_level")))


# --- knowledge base ------------------------------------------------------------------------

KB_COLUMNS = ["category", "key", "count", "last_seen_file", "sample_size"]


def kb_findings(families: DataFrame, debug_apis: DataFrame, urls: DataFrame) -> DataFrame:
    """Entries learned from analyses: family → latest file, API and domain counts."""
    none = lambda t: F.lit(None).cast(t)
    latest = families.groupBy(F.col("family").alias("key")).agg(
        F.max_by(F.struct("file_name", "file_size"), "seq").alias("_f")).select(
        F.lit("malware_families").alias("category"), "key", none("bigint").alias("count"),
        F.col("_f.file_name").alias("last_seen_file"),
        F.col("_f.file_size").alias("sample_size"))

    def counted(df: DataFrame, category: str, key: Column) -> DataFrame:
        return (df.select(key.alias("key")).where(F.col("key").isNotNull())
                .groupBy("key").agg(F.count(F.lit(1)).alias("count"))
                .select(F.lit(category).alias("category"), "key", "count",
                        none("string").alias("last_seen_file"),
                        none("bigint").alias("sample_size")))

    return (latest.unionByName(counted(debug_apis, "evasion_techniques", F.col("api")))
            .unionByName(counted(urls, "ioc_patterns", url_domain(F.col("url")))))


def kb_update(kb: DataFrame, findings: DataFrame) -> DataFrame:
    """Old entries with new findings: counts add up, latest-file fields replace."""
    new = findings.select("category", "key", *[F.col(c).alias(f"_{c}") for c in KB_COLUMNS[2:]])
    count = F.when(F.col("count").isNotNull() | F.col("_count").isNotNull(),
                   F.coalesce("count", F.lit(0)) + F.coalesce("_count", F.lit(0)))
    return kb.join(new, ["category", "key"], "full").select(
        "category", "key", count.alias("count"),
        F.coalesce("_last_seen_file", "last_seen_file").alias("last_seen_file"),
        F.coalesce("_sample_size", "sample_size").alias("sample_size"))


def kb_merge(kb: DataFrame, findings: DataFrame) -> DataFrame:
    """Merge findings by the kind of the entry they meet.

    Entries are (category, key, kind, items, fields, scalar) with kind ``list``,
    ``struct`` or ``scalar``; findings are (category, key, seq, kind, field,
    value).  A list takes values it lacks, in order; a struct updates fields; a
    scalar is overwritten.  A finding for a new key brings its own kind.
    """
    key = ["category", "key"]
    by_value = findings.groupBy(*key, "value").agg(F.min("seq").alias("seq"))
    items = by_value.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("seq", "value"))), lambda e: e["value"]).alias("_items"))
    by_field = findings.where(F.col("field").isNotNull()).groupBy(*key, "field").agg(
        F.max_by("value", "seq").alias("value"))
    fields = by_field.groupBy(*key).agg(F.map_from_entries(F.collect_list(
        F.struct("field", "value"))).alias("_fields"))
    last = findings.groupBy(*key).agg(F.max_by("value", "seq").alias("_scalar"),
                                      F.min_by("kind", "seq").alias("_kind"))
    new = last.join(items, key).join(fields, key, "left")
    empty_map = F.create_map().cast("map<string,string>")
    empty_list = F.array().cast("array<string>")
    old_fields, new_fields = F.coalesce("fields", empty_map), F.coalesce("_fields", empty_map)
    kept = F.map_filter(old_fields, lambda k, v: ~F.map_contains_key(new_fields, k))
    joined = kb.join(new, key, "full").withColumn("_k", F.coalesce("kind", "_kind"))
    is_kind = lambda k: F.col("_k") == k
    return joined.select(
        *key, F.col("_k").alias("kind"),
        F.when(is_kind("list"), F.array_union(F.coalesce("items", empty_list),
                                              F.coalesce("_items", empty_list))).alias("items"),
        F.when(is_kind("struct"), F.map_concat(kept, new_fields)).alias("fields"),
        F.when(is_kind("scalar"), F.coalesce("_scalar", "scalar")).alias("scalar"))


def kb_query(kb: DataFrame, category: str, keyword: str | None = None) -> DataFrame:
    """Entries of a category whose key or value holds the keyword, any case."""
    rows = kb.where(F.col("category") == category)
    if keyword is None:
        return rows
    value = F.lower(F.concat_ws(" ", F.col("count").cast("string"), "last_seen_file",
                                F.col("sample_size").cast("string")))
    needle = F.lit(keyword.lower())
    return rows.where(F.contains(F.lower("key"), needle) | F.contains(value, needle))


def known_keys(kb: DataFrame, category: str) -> DataFrame:
    """Known families (``malware_families``) or techniques (``ttps``)."""
    return kb.where(F.col("category") == category).select("key")
