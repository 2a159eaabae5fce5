"""The analysis store: analyses, indicators and agent results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracefold import rules
from tracefold.session import cut
from tracefold.sources import commits
from tracefold.sources.commits import bucket_of

ANALYSIS_SCHEMA = ("id string, file_hash string, file_name string, file_type string, "
                   "verdict string, confidence double, risk_score double, "
                   "full_results_json string, report_markdown string, created_at timestamp")
IOC_SCHEMA = ("analysis_id string, ioc_type string, ioc_value string, context string, "
              "threat_level int, created_at timestamp")
AGENT_SCHEMA = ("analysis_id string, agent_name string, result_json string, "
                "created_at timestamp")


def upsert_analyses(stored: DataFrame, incoming: DataFrame,
                    order: list[str] | None = None) -> DataFrame:
    """State after inserting ``incoming`` in order, each replacing clashing rows.

    A row is replaced by any later row with its id or its file hash, so it stays
    exactly when it is the last of both.  Equal order values are told apart by a
    written arrival number; rows without a hash clash by id only.  Both tests are
    small aggregates joined back, without gathering the rows of a key.
    """
    order = order or ["created_at", "id"]
    rows = cut(stored.withColumn("_late", F.lit(0)).unionByName(
        incoming.withColumn("_late", F.lit(1)))
        .withColumn("_n", F.monotonically_increasing_id()))
    rows = rows.withColumn("_at", F.struct("_late", *order, "_n"))
    last = lambda key, name: (rows.where(F.col(key).isNotNull()).groupBy(key)
                              .agg(F.max("_at").alias(name)))
    return (rows.join(last("id", "_id_at"), "id", "left")
            .join(last("file_hash", "_hash_at"), "file_hash", "left")
            .where((F.col("_id_at").isNull() | (F.col("_at") == F.col("_id_at")))
                   & (F.col("_hash_at").isNull() | (F.col("_at") == F.col("_hash_at"))))
            .select(*stored.columns))


def ioc_rows(iocs: DataFrame) -> DataFrame:
    """Indicator rows ready to append; a missing threat level becomes 5."""
    return iocs.withColumn("threat_level", F.coalesce(
        "threat_level", F.lit(rules.DEFAULT_THREAT_LEVEL)))


def agent_rows(results: DataFrame, columns: list[str]) -> DataFrame:
    """Agent result rows with the given columns as one JSON text."""
    return results.select("analysis_id", "agent_name",
                          F.to_json(F.struct(*columns)).alias("result_json"), "created_at")


def append_iocs(iocs: DataFrame, root: str, token: str | None = None) -> bool:
    """Commit indicator rows to the store; a token that is known adds nothing."""
    names = [field.split(" ")[0] for field in IOC_SCHEMA.split(", ")]
    return commits.append(ioc_rows(iocs).select(*names), root, "iocs", token)


def append_agent_results(results: DataFrame, columns: list[str], root: str, token: str | None = None) -> bool:
    return commits.append(agent_rows(results, columns), root, "agents", token)


def read_iocs(spark: SparkSession, root: str) -> DataFrame:
    return commits.read_kind(spark, root, "iocs", IOC_SCHEMA, commits.last_commit(spark, root)[1])


def read_agent_results(spark: SparkSession, root: str) -> DataFrame:
    return commits.read_kind(spark, root, "agents", AGENT_SCHEMA, commits.last_commit(spark, root)[1])


# --- analyses on disk ------------------------------------------------------------------------

#: Long texts lie apart from the other columns and are written once.
TEXTS = ["full_results_json", "report_markdown"]
KEY_SCHEMA = ("id string, file_hash string, file_name string, file_type string, verdict string, "
              "confidence double, risk_score double, created_at timestamp, text_id string, bucket int")
TEXT_SCHEMA = "text_id string, full_results_json string, report_markdown string"
PLACE_SCHEMA = "id string, at int, bucket int"
#: Files of one bucket, so that a bucket is not one task's work.
FILES = 4


def store_analyses(incoming: DataFrame, root: str, order: list[str] | None = None,
                   buckets: int = commits.BUCKETS) -> list[int]:
    """Upsert rows of :data:`ANALYSIS_SCHEMA` into the store; the buckets that were rewritten.

    A new store is dealt into ``buckets``; later writes keep the number of the first one.

    Key rows lie in buckets by file hash, and an index tells the bucket of every id.  Only
    buckets that hold a clashing hash or id are read, replaced by new folders, and committed
    together with the texts of the incoming rows.  Texts of rows that stay are never read.
    """
    spark = incoming.sparkSession
    number, entries = commits.last_commit(spark, root)
    version = commits.new_version()
    count = next((e[1] for e in entries if e[0] == "buckets"), None)
    if count is None:
        count, entries = buckets, [*entries, ("buckets", buckets, None, None)]
    new = cut(incoming.withColumns({"text_id": F.expr("uuid()"), "bucket": bucket_of("file_hash", "id", buckets=count),
                                    "at": bucket_of("id", buckets=count)}))
    keys = new.drop(*TEXTS)
    # Numbers of buckets: bounded lists.
    used = keys.agg(F.collect_set("bucket"), F.collect_set("at")).first()
    hashes, ids = set(used[0]), set(used[1])
    places = commits.read_kind(spark, root, "places", PLACE_SCHEMA, entries).where(F.col("bucket").isin(*ids, -1))
    hashes |= {r[0] for r in places.join(keys.select("id"), "id", "left_semi").select("at").distinct().collect()}
    touched = sorted(hashes)
    names = [field.split(" ")[0] for field in KEY_SCHEMA.split(", ")]
    stored = commits.read_kind(spark, root, "keys", KEY_SCHEMA, entries, touched).select(*names)
    state = upsert_analyses(stored, keys.select(*names), order)
    (state.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(FILES)))
     .write.partitionBy("bucket").parquet(f"{root}/keys/version={version}"))
    new.select("text_id", *TEXTS).write.parquet(f"{root}/texts/version={version}")
    (keys.select("id", F.col("bucket").alias("at"), F.col("at").alias("bucket")).distinct().repartition("bucket")
     .write.partitionBy("bucket").parquet(f"{root}/places/version={version}"))
    kept = [e for e in entries if not (e[0] == "keys" and e[1] in hashes)]
    commits.commit(spark, root, number + 1, [
        *kept, *(("keys", b, version, None) for b in commits.written_buckets(spark, f"{root}/keys/version={version}")),
        ("texts", None, version, None), ("places", None, version, None)])
    return touched


def read_analyses(spark: SparkSession, root: str, texts: bool = True) -> DataFrame:
    """Stored analyses, with their long texts only when asked for."""
    entries = commits.last_commit(spark, root)[1]
    keys = commits.read_kind(spark, root, "keys", KEY_SCHEMA, entries)
    if texts:
        keys = keys.join(commits.read_kind(spark, root, "texts", TEXT_SCHEMA, entries), "text_id")
    return keys.drop("text_id", "bucket", "version")


def delete_analysis(analyses: DataFrame, ids: DataFrame) -> DataFrame:
    """Analyses without the given ids.

    Indicator rows stay behind as orphans; :func:`delete_children` removes them
    as well, which differs from the reference behaviour.
    """
    return analyses.join(ids.select("id").distinct(), "id", "left_anti")


def delete_children(children: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("id").alias("analysis_id")).distinct()
    return children.join(gone, "analysis_id", "left_anti")
