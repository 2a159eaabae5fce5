"""Queries over the store, indicators, knowledge, evaluation and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracefold import rules
from tracefold.operators import evaluate, features, intel
from tracefold.plans.catalog import query
from tracefold.plans.views import literal
from tracefold.session import ensure_checkpoint_dir
from tracefold.sources import store
from tracefold.streaming import events as progress, ingest

# --- store -------------------------------------------------------------------------


def fresh_root(spark) -> str:
    """A new folder beside the checkpoints, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}"


def _reported(df):
    """Analyses with texts that tell which row they belong to."""
    mark = F.concat_ws("|", "id", "file_hash", "file_name", F.col("risk_score").cast("int"))
    return df.withColumns({"full_results_json": F.to_json(F.struct("id", "verdict")),
                           "report_markdown": F.concat(F.lit("# "), mark),
                           "created_at": F.col("created_at").cast("timestamp")})


STORED = """
SELECT id, file_hash, file_name, verdict, risk_score,
       '# ' || concat_ws('|', id, file_hash, file_name, CAST(risk_score AS INT)) AS report_markdown FROM (
  SELECT *, max(pos) OVER (PARTITION BY id) AS id_at, max(pos) OVER (PARTITION BY file_hash) AS hash_at
  FROM (SELECT *, row_number() OVER (ORDER BY late, created_at, id, risk_score, file_hash) AS pos FROM (
    SELECT *, 0 AS late FROM {analyses} UNION ALL SELECT *, 1 FROM {incoming}) u) v) w
WHERE pos = id_at AND pos = hash_at"""


@query("store_analyses", STORED)
def _(t):
    order = ["created_at", "id", "risk_score", "file_hash"]
    root = fresh_root(t.spark)
    store.store_analyses(_reported(t("analyses")), root, order, buckets=8)
    store.store_analyses(_reported(t("incoming")), root, order)
    return store.read_analyses(t.spark, root).select(
        "id", "file_hash", "file_name", "verdict", "risk_score", "report_markdown")


@query("store_iocs", """
SELECT analysis_id, ioc_type, ioc_value, context, coalesce(threat_level, 5) AS threat_level FROM {iocs}""")
def _(t):
    root = fresh_root(t.spark)
    hot = F.coalesce(F.col("ioc_type") == "url", F.lit(False))
    store.append_iocs(t("iocs").where(hot), root, "first")
    store.append_iocs(t("iocs").where(~hot), root, "second")
    store.append_iocs(t("iocs").where(~hot), root, "second")  # a repeated batch adds nothing
    return store.read_iocs(t.spark, root).select("analysis_id", "ioc_type", "ioc_value", "context", "threat_level")


@query("store_agent_results", """
SELECT id AS analysis_id, 'coordinator' AS agent_name,
       '{' || '"verdict":"' || verdict || '","file_name":"' || file_name || '"}' AS result_json
FROM {analyses}""")
def _(t):
    rows = t("analyses").select(F.col("id").alias("analysis_id"), F.lit("coordinator").alias("agent_name"),
                                "verdict", "file_name", F.col("created_at").cast("timestamp").alias("created_at"))
    root = fresh_root(t.spark)
    for verdict in ("MALWARE", "BENIGN"):
        store.append_agent_results(rows.where(F.col("verdict") == verdict), ["verdict", "file_name"], root, verdict)
    return store.read_agent_results(t.spark, root).select("analysis_id", "agent_name", "result_json")


@query("ingest_files", """
SELECT o.sha256, o.path, f.name, f.size, CASE WHEN coalesce(f.size, 0) = 0 THEN 'failed' ELSE 'completed' END AS status
FROM {firsts} o JOIN {uploads} f ON f.sha256 = o.sha256 AND f.path = o.path AND f.early = o.early
WHERE o.early OR NOT EXISTS (SELECT 1 FROM {firsts} e WHERE e.early AND e.sha256 = o.sha256)""", {
    "uploads": """
SELECT sha256(content) AS sha256, path, name, size, path LIKE '/corpus/malware/%' AS early FROM {files}""",
    "firsts": "SELECT sha256, early, min(path) AS path FROM {uploads} GROUP BY sha256, early"})
def _(t):
    root = fresh_root(t.spark)
    early = F.col("path").startswith("/corpus/malware/")
    ingest.ingest_batch(t("files").where(early), root, "uploads", 0, 1)
    for _ in range(2):  # the second batch comes twice, as after a failure
        ingest.ingest_batch(t("files").where(~early), root, "uploads", 1, 1)
    return ingest.read_store(t.spark, root).select("sha256", "path", "name", "size", "status")


@query("delete_analysis", """
SELECT id, file_hash FROM {analyses} WHERE id NOT IN (SELECT analysis_id FROM {iocs} WHERE threat_level = 9)""")
def _(t):
    gone = t("iocs").where("threat_level = 9").select(F.col("analysis_id").alias("id"))
    return store.delete_analysis(t("analyses"), gone).select("id", "file_hash")


@query("delete_children", """
SELECT analysis_id, count(*) AS n FROM {iocs} WHERE analysis_id NOT IN (
  SELECT id FROM {analyses} WHERE verdict = 'MALWARE') GROUP BY analysis_id""")
def _(t):
    gone = t("analyses").where("verdict = 'MALWARE'").select("id")
    return store.delete_children(t("iocs"), gone).groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("n"))


# --- verdicts and indicators -----------------------------------------------------------

@query("aggregate_verdict", f"""
SELECT a.id AS analysis_id, CASE WHEN bad THEN 'MALWARE' ELSE 'BENIGN' END AS verdict,
       coalesce(risk, 0) AS risk_score, coalesce(conf, 100) AS confidence,
       coalesce(rep, {literal(rules.EMPTY_REPORT)}) AS report_markdown
FROM {{analyses}} a LEFT JOIN (
  SELECT analysis_id, bool_or(verdict = 'MALWARE') AS bad, max(risk_score) AS risk,
         max(confidence) AS conf, string_agg(chr(10) || chr(10) || '# ' || CASE kind WHEN 'pe' THEN 'PE'
         ELSE 'Script' END || ' Analysis: ' || file_name || chr(10) || report_markdown, ''
         ORDER BY kind, part_seq) AS rep
  FROM {{parts}} GROUP BY analysis_id) p ON a.id = p.analysis_id""")
def _(t):
    analyses = t("analyses").select(F.col("id").alias("analysis_id"))
    return intel.aggregate_verdict(analyses, t("parts"))


@query("verdict_reports", f"""
SELECT a.id AS analysis_id, coalesce(scripts, FALSE) AS scripts, CAST(coalesce(piece, 0) AS BIGINT) AS piece,
       coalesce(rep, {literal(rules.EMPTY_REPORT)}) AS report_markdown
FROM {{analyses}} a LEFT JOIN (
  SELECT analysis_id, kind <> 'pe' AS scripts, part_seq // 2 AS piece,
         string_agg(chr(10) || chr(10) || '# ' || CASE kind WHEN 'pe' THEN 'PE'
         ELSE 'Script' END || ' Analysis: ' || file_name || chr(10) || report_markdown, '' ORDER BY part_seq) AS rep
  FROM {{parts}} GROUP BY ALL) p ON a.id = p.analysis_id""")
def _(t):
    analyses = t("analyses").select(F.col("id").alias("analysis_id"))
    return intel.verdict_reports(analyses, t("parts"), 2)


@query("get_by_id", "SELECT id, file_hash, verdict FROM {analyses} WHERE id = 'a77'")
def _(t):
    return intel.get_by_id(t("analyses"), "a77").select("id", "file_hash", "verdict")


@query("get_by_hash", "SELECT id, file_hash, verdict FROM {analyses} WHERE file_hash = 'f42'")
def _(t):
    return intel.get_by_hash(t("analyses"), "f42").select("id", "file_hash", "verdict")


@query("recent_analyses", """
SELECT id, file_name, verdict, risk_score FROM {analyses} ORDER BY created_at DESC, id LIMIT 50""")
def _(t):
    return intel.recent_analyses(t("analyses")).select("id", "file_name", "verdict", "risk_score")


@query("search_ioc", """
SELECT a.id, file_name, verdict, risk_score, ioc_type, context
FROM {iocs} i JOIN {analyses} a ON i.analysis_id = a.id WHERE ioc_value = 'v17'""")
def _(t):
    return intel.search_ioc(t("iocs"), t("analyses"), "v17")


@query("entity_history", """
SELECT analysis_id, file_name, verdict, risk_score, context, CAST(i.created_at AS VARCHAR)[1:10] AS day
FROM {iocs} i JOIN {analyses} a ON i.analysis_id = a.id WHERE ioc_type = 'ip' AND ioc_value = 'v21'""")
def _(t):
    return intel.entity_history(t("iocs"), t("analyses"), "ip", "v21").withColumn(
        "day", F.date_format("created_at", "yyyy-MM-dd")).drop("created_at")


@query("related_entities", """
SELECT ioc_type, ioc_value, context, analysis_id FROM {iocs} WHERE ioc_value <> 'v33' AND analysis_id IN (
  SELECT analysis_id FROM {iocs} WHERE ioc_value = 'v33')""")
def _(t):
    return intel.related_entities(t("iocs"), "v33")


@query("related_counts", """
SELECT ioc_type, ioc_value, count(DISTINCT analysis_id) AS shared_analyses FROM {iocs}
WHERE ioc_value NOT IN (SELECT 'v' || p_partkey FROM {part} WHERE p_size = 7) AND analysis_id IN (
  SELECT analysis_id FROM {iocs} WHERE ioc_value IN (SELECT 'v' || p_partkey FROM {part} WHERE p_size = 7))
GROUP BY ioc_type, ioc_value""")
def _(t):
    watched = t("part").where("p_size = 7").select(
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("ioc_value"))
    return intel.related_counts(t("iocs"), watched)


@query("high_risk_entities", """
SELECT DISTINCT ioc_type, ioc_value, context, threat_level, analysis_id FROM {iocs} WHERE threat_level >= 7""")
def _(t):
    return intel.high_risk_entities(t("iocs"))


# --- knowledge ------------------------------------------------------------------------------

def _findings(t):
    return intel.kb_findings(t("families"), t("debug_hits"), t("pages").select("url"))


FINDINGS = {"fnd": """
SELECT 'malware_families' AS category, family AS key, CAST(NULL AS BIGINT) AS count,
       arg_max(file_name, seq) AS last_seen_file, arg_max(file_size, seq) AS sample_size
FROM {families} GROUP BY family
UNION ALL SELECT 'evasion_techniques', api, count(*), NULL, NULL FROM {debug_hits} GROUP BY api
UNION ALL SELECT 'ioc_patterns', split_part(split_part(url, '//', 2), '/', 1) AS d, count(*), NULL, NULL
FROM {pages} WHERE contains(url, '//') GROUP BY d"""}


def _kb_shown(df):
    return df.select("category", "key", F.coalesce("count", F.lit(-1)).alias("count"),
                     F.coalesce("last_seen_file", F.lit("")).alias("last_seen_file"),
                     F.coalesce("sample_size", F.lit(-1)).alias("sample_size"))


@query("kb_update", """
SELECT coalesce(k.category, f.category) AS category, coalesce(k.key, f.key) AS key,
       CASE WHEN k.count IS NULL AND f.count IS NULL THEN -1
            ELSE coalesce(k.count, 0) + coalesce(f.count, 0) END AS count,
       coalesce(f.last_seen_file, k.last_seen_file, '') AS last_seen_file,
       coalesce(f.sample_size, k.sample_size, -1) AS sample_size
FROM {kb} k FULL JOIN {fnd} f ON k.category = f.category AND k.key = f.key""", FINDINGS)
def _(t):
    return _kb_shown(intel.kb_update(t("kb"), _findings(t)))


KB_MERGED = """
SELECT coalesce(o.key, n.key) AS key, coalesce(o.kind, n.kind) AS kind,
       CASE coalesce(o.kind, n.kind) WHEN 'list' THEN concat_ws(',', o.value, n.added)
            WHEN 'struct' THEN concat_ws(',', CASE WHEN o.value IS NOT NULL THEN 'base=' || o.value END, n.fields)
            ELSE coalesce(n.latest, o.value) END AS value
FROM {kb_entries} o FULL JOIN (
  SELECT k.key, any_value(k.kind) AS kind, arg_max(k.value, k.seq) AS latest,
         any_value(a.added) AS added, any_value(f.fields) AS fields
  FROM {kb_new} k
  LEFT JOIN (SELECT key, string_agg(value, ',' ORDER BY seq) AS added FROM (
      SELECT n.key, n.value, min(seq) AS seq FROM {kb_new} n LEFT JOIN {kb_entries} e
             ON n.key = e.key AND n.value = e.value WHERE e.key IS NULL GROUP BY n.key, n.value) x
      GROUP BY key) a ON a.key = k.key
  LEFT JOIN (SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS fields FROM (
      SELECT key, field, arg_max(value, seq) AS value FROM {kb_new} WHERE field IS NOT NULL
      GROUP BY key, field) y GROUP BY key) f ON f.key = k.key
  GROUP BY k.key) n ON o.key = n.key"""


@query("kb_merge", KB_MERGED)
def _(t):
    kind = F.col("kind")
    kb = t("kb_entries").select(
        "category", "key", "kind", F.when(kind == "list", F.array("value")).alias("items"),
        F.when(kind == "struct", F.create_map(F.lit("base"), "value")).alias("fields"),
        F.when(kind == "scalar", F.col("value")).alias("scalar"))
    merged = intel.kb_merge(kb, t("kb_new"))
    pairs = F.transform(F.array_sort(F.map_entries("fields")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return merged.select("key", "kind", F.coalesce(
        F.array_join("items", ","), F.array_join(pairs, ","), "scalar").alias("value"))


@query("kb_query", """
SELECT category, key, coalesce(count, -1) AS count, coalesce(last_seen_file, '') AS last_seen_file,
       coalesce(sample_size, -1) AS sample_size
FROM {kb} WHERE category = 'malware_families' AND (contains(lower(key), 'm12')
      OR contains(lower(last_seen_file), 'm12') OR contains(CAST(sample_size AS VARCHAR), 'm12'))""")
def _(t):
    return _kb_shown(intel.kb_query(t("kb"), "malware_families", "M12"))


@query("known_families", "SELECT key FROM {kb} WHERE category = 'malware_families'")
def _(t):
    return intel.known_keys(t("kb"), "malware_families")


# --- splits and evaluation ---------------------------------------------------------------------

SPLIT_ROWS = """
SELECT *, row_number() OVER (PARTITION BY label ORDER BY
              substr(md5('42:' || file_id), 1, 8), file_id) - 1 AS pos,
       count(*) OVER (PARTITION BY label) AS n FROM {samples}"""


@query("stratified_split", """
SELECT file_id, label, CASE WHEN pos < round(n * 0.1e0) THEN 'test'
       WHEN pos < round(n * 0.1e0) * 2 THEN 'val' ELSE 'train' END AS split FROM {r}""",
       {"r": SPLIT_ROWS})
def _(t):
    return evaluate.stratified_split(t("samples"))


@query("class_distribution", "SELECT label, count(*) AS n FROM {samples} GROUP BY label")
def _(t):
    return evaluate.class_distribution(t("samples"))


@query("class_weights", """
SELECT label, count(*) AS n, round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 9)
       AS weight FROM {samples} GROUP BY label""")
def _(t):
    return evaluate.class_weights(t("samples")).withColumn("weight", F.round("weight", 9))


@query("mc_aggregate", """
SELECT model_id, sample_id, class AS prediction, round(m, 6) AS confidence, round(v, 6) AS variance FROM (
  SELECT *, row_number() OVER (PARTITION BY model_id, sample_id ORDER BY m DESC, class) AS rn FROM (
    SELECT model_id, sample_id, class, avg(prob) AS m, var_samp(prob) AS v FROM {predictions}
    GROUP BY model_id, sample_id, class) a) b WHERE rn = 1""")
def _(t):
    out = evaluate.mc_aggregate(t("predictions"), ["model_id", "sample_id"])
    return out.select("model_id", "sample_id", "prediction", F.round("confidence", 6).alias("confidence"),
                      F.round("variance", 6).alias("variance"))


ENSEMBLE = {"en": """
SELECT sample_id, class, avg(p) AS prob FROM (SELECT sample_id, model_id, class, avg(prob) AS p
    FROM {predictions} GROUP BY sample_id, model_id, class) a GROUP BY sample_id, class"""}


@query("ensemble_mean", "SELECT sample_id, class, round(prob, 6) AS prob FROM {en}", ENSEMBLE)
def _(t):
    return evaluate.ensemble_mean(t("predictions")).withColumn("prob", F.round("prob", 6))


@query("threshold_predict", """
SELECT sample_id, CAST(prob >= 0.5 AS INT) AS prediction,
       round(greatest(prob, 1 - prob), 6) AS confidence, greatest(prob, 1 - prob) < 0.85 AS needs_review
FROM {en} WHERE class = 1""", ENSEMBLE)
def _(t):
    return evaluate.threshold_predict(evaluate.ensemble_mean(t("predictions"))).withColumn(
        "confidence", F.round("confidence", 6))


@query("label_names", """
SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'BENIGN' WHEN 2 THEN 'MALWARE'
       ELSE 'UNKNOWN' END AS label FROM {orders}""")
def _(t):
    return t("orders").select("o_orderkey", evaluate.label_name(F.col("o_custkey") % 5 - 1)
                              .alias("label"))


CELLS = {"m": """
SELECT count(*) FILTER (WHERE prediction = 1 AND label = 1) AS tp,
       count(*) FILTER (WHERE prediction = 0 AND label = 0) AS tn,
       count(*) FILTER (WHERE prediction = 1 AND label = 0) AS fp,
       count(*) FILTER (WHERE prediction = 0 AND label = 1) AS fn, count(*) AS n FROM {results}"""}


@query("classification_metrics", """
SELECT tp, tn, fp, fn, round((tp + tn) / n, 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
       round(tp / (tp + fn), 9) AS recall, round(fp / (fp + tn), 9) AS fpr, round(fn / (fn + tp), 9) AS fnr,
       round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) AS f1
FROM {m}""", CELLS)
def _(t):
    out = evaluate.classification_metrics(t("results"))
    rates = ["accuracy", "precision", "recall", "fpr", "fnr", "f1"]
    return out.select("tp", "tn", "fp", "fn", *[F.round(c, 9).alias(c) for c in rates])


@query("confusion_matrix", """
SELECT l AS label, p AS prediction, count(x.sample_id) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(l, p)
LEFT JOIN {results} x ON x.label = l AND x.prediction = p GROUP BY l, p""")
def _(t):
    return evaluate.confusion_matrix(t("results"))


@query("error_lists", """
SELECT path, sample_id, CASE prediction WHEN 1 THEN 'false_positive' ELSE 'false_negative' END AS error
FROM {results} WHERE prediction = 1 AND label = 0 OR prediction = 0 AND label = 1""")
def _(t):
    return evaluate.error_lists(t("results")).select("path", "sample_id", "error")


@query("roc_auc", """
SELECT round(sum(CASE WHEN label = 1 THEN r END) / (max(p) * CAST(max(q) AS DOUBLE)) - (max(p) + 1) / (2e0 * max(q)), 9)
       AS auc
FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r,
             count(*) FILTER (WHERE label = 1) OVER () AS p, count(*) FILTER (WHERE label = 0) OVER () AS q
      FROM {scores}) x""")
def _(t):
    return evaluate.roc_auc(t("scores")).select(F.round("auc", 9).alias("auc"))


REPORT_SQL = {"r": """
SELECT k AS label, count(*) FILTER (WHERE label = k) AS support,
       count(*) FILTER (WHERE label = k AND prediction = k) / count(*) FILTER (WHERE prediction = k) AS p,
       count(*) FILTER (WHERE label = k AND prediction = k) / count(*) FILTER (WHERE label = k) AS c
FROM {results} CROSS JOIN (VALUES (0), (1)) AS g(k) GROUP BY k"""}


@query("class_report", """
SELECT label, support, round(p, 9) AS precision, round(c, 9) AS recall, round(2 * p * c / (p + c), 9) AS f1
FROM {r}""", REPORT_SQL)
def _(t):
    return evaluate.class_report(t("results")).select(
        "label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("weighted_f1", """
SELECT round(sum(2 * p * c / (p + c) * support) / sum(support), 9) AS weighted_f1 FROM {r}""", REPORT_SQL)
def _(t):
    return evaluate.weighted_f1(t("results")).select(F.round("weighted_f1", 9).alias("weighted_f1"))


@query("fit_classifier")
def _(t):
    """Train on the training split of labelled documents, score the others."""
    from tracefold.functions.bytes import byte_entropy
    means = features.byte_chunk_means(t("files")).groupBy("file_id").agg(F.sum("mean").alias("byte_sum"))
    facts = t("files").select("file_id", byte_entropy("content").alias("entropy"),
                              F.octet_length("content").cast("double").alias("length"))
    samples = evaluate.stratified_split(t("samples")).join(facts, "file_id").join(means, "file_id")
    model = evaluate.fit_classifier(samples.where("split = 'train'"),
                                    ["entropy", "length", "byte_sum"], max_iter=10)
    scored = evaluate.predict(model, samples.where("split <> 'train'"))
    return scored.select("file_id", "label", "prediction", F.round("score", 4).alias("score"))


# --- events --------------------------------------------------------------------------------------

def _last(value: str, condition: str = "TRUE") -> str:
    return f"arg_max({value}, seq) FILTER (WHERE ({condition}) AND ({value}) IS NOT NULL)"


STATUS = """CASE WHEN event_type IN ('analysis_started', 'file_identified') THEN 'identifying'
    WHEN event_type = 'step_started' THEN step
    WHEN event_type = 'step_completed' AND step = 'pe_analysis' THEN 'ml_prediction'
    WHEN event_type = 'step_completed' AND step = 'agents_analysis' THEN 'generating_report'
    WHEN event_type = 'analysis_completed' THEN 'completed'
    WHEN event_type = 'analysis_failed' THEN 'failed' END"""
PROGRESS = """CASE WHEN event_type = 'analysis_started' THEN 0e0 WHEN event_type = 'file_identified' THEN 0.1e0
    WHEN event_type IN ('step_started', 'step_progress') THEN progress
    WHEN event_type IN ('analysis_completed', 'analysis_failed') THEN 1e0 END"""
STATE_COLUMNS = ["file_type", "category", "route", "prediction", "error"]


@query("analysis_state", f"""
SELECT analysis_id, coalesce({_last(STATUS)}, '') AS status, coalesce({_last(PROGRESS)}, -1) AS progress,
       {', '.join(f"coalesce({_last(c, chr(34) + 'event_type' + chr(34) + chr(61) + chr(39) + 'file_identified' + chr(39))}, '') AS {c}"
                  for c in ('file_type', 'category', 'route'))},
       coalesce({_last('label', "event_type = 'step_completed' AND step = 'ml_prediction'")}, '') AS prediction,
       coalesce({_last("coalesce(nullif(message, ''), 'Analysis failed.')", "event_type = 'analysis_failed'")}, '')
           AS error
FROM {{analysis_events}} GROUP BY analysis_id""")
def _(t):
    return progress.analysis_state(t("analysis_events")).fillna(
        "", ["status", *STATE_COLUMNS]).fillna(-1.0, ["progress"])


@query("event_history", """
SELECT analysis_id, seq, event_type, row_number() OVER (PARTITION BY analysis_id ORDER BY seq, event_type) - 1 AS place
FROM {analysis_events}""")
def _(t):
    return progress.event_history(t("analysis_events")).select(
        "analysis_id", "seq", "event_type", "place")


@query("subscribe", "SELECT seq, event_type FROM {analysis_events} WHERE analysis_id = 'a7'")
def _(t):
    return progress.subscribe(t("analysis_events"), "a7").select("seq", "event_type")


@query("agent_activity", """
SELECT analysis_id, agent, arg_max(CASE WHEN event_type IN ('agent_started', 'agent_thinking') THEN 'thinking'
       WHEN event_type = 'agent_completed' THEN 'completed' ELSE 'failed' END, seq) AS status
FROM {analysis_events} WHERE agent IS NOT NULL AND event_type LIKE 'agent%' GROUP BY analysis_id, agent""")
def _(t):
    return progress.agent_activity(t("analysis_events"))


@query("stage_gate", f"""
SELECT analysis_id, max(s) AS gate_seq FROM (
  SELECT analysis_id, agent, min(seq) AS s FROM {{analysis_events}}
  WHERE event_type = 'agent_completed' AND agent IN ({', '.join(literal(r) for r in rules.PARALLEL_ROLES)})
  GROUP BY analysis_id, agent) x GROUP BY analysis_id HAVING count(*) = 5""")
def _(t):
    return progress.stage_gate(t("analysis_events"))


@query("job_status", f"""
SELECT coalesce(s.analysis_id, a.id) AS analysis_id, coalesce(s.status, 'completed') AS status,
       coalesce(s.progress, 1) AS progress, coalesce(file_name, '') AS file_name
FROM (SELECT analysis_id, {_last(STATUS)} AS status, {_last(PROGRESS)} AS progress
      FROM {{analysis_events}} GROUP BY analysis_id) s
FULL JOIN {{analyses}} a ON s.analysis_id = a.id""")
def _(t):
    state = progress.analysis_state(t("analysis_events"))
    return progress.job_status(state, t("analyses"))
