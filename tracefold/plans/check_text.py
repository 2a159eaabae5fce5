"""Queries over strings, signatures, scripts, documents, reports and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracefold import rules
from tracefold.operators import text_rules, tokens
from tracefold.plans.catalog import query
from tracefold.plans.check_files import BASE, ROUTES, SUFFIX, TEXTUAL
from tracefold.plans.check_layout import ENTROPY_CLASS, any_contains, entropy_sql
from tracefold.plans.triage import COUNTED, triage
from tracefold.plans.views import literal, values


def re2(pattern: str) -> str:
    """A rule pattern for RE2: ASCII classes, flags kept apart from (?U)."""
    return literal(pattern.replace("(?U)", "").replace("(?d)", ""))




# --- strings --------------------------------------------------------------------------

# One character per byte: the hex pairs outside the printable range become chr(1).
ASCII_RUNS = """
SELECT file_id, unnest(regexp_extract_all(hex(content), '..')) AS b,
       unnest(range(octet_length(content))) AS i FROM {files}"""
RUN_ROWS = """
SELECT file_id, min(i) AS start, string_agg(chr(CAST('0x' || b AS INT)), '' ORDER BY i) AS s
FROM (SELECT file_id, i, b, i - row_number() OVER (PARTITION BY file_id ORDER BY i) AS grp
      FROM {chars} WHERE b BETWEEN '20' AND '7E') x
GROUP BY file_id, grp HAVING count(*) >= 4"""
WIDE_ROWS = """
SELECT file_id, s FROM (
  SELECT file_id, string_agg(chr(CAST('0x' || b AS INT)), '' ORDER BY i) AS s, count(*) AS n
  FROM (SELECT file_id, i, b, i - 2 * row_number() OVER (PARTITION BY file_id, i % 2 ORDER BY i) AS grp
        FROM (SELECT file_id, i, b, lead(b) OVER (PARTITION BY file_id ORDER BY i) AS nb FROM {chars}) y
        WHERE b BETWEEN '20' AND '7E' AND nb = '00') x
  GROUP BY file_id, grp, i % 2) z WHERE n >= 4"""
RUNS = {"chars": ASCII_RUNS, "runs": RUN_ROWS, "wide": WIDE_ROWS}


@query("extract_strings", """
SELECT file_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(s, '|' ORDER BY k, start)) AS digest
FROM (SELECT file_id, s, 0 AS k, start FROM {runs} UNION ALL SELECT file_id, s, 1, 0 FROM {wide}) x
GROUP BY file_id""", RUNS)
def _(t):
    found = text_rules.extract_strings(t("files"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))),
                                      lambda e: e["s"]), "|")
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"),
                                        F.md5(joined.cast("binary")).alias("digest"))


@query("extract_strings_distinct", """
SELECT DISTINCT file_id, s FROM (SELECT file_id, s FROM {runs} UNION ALL SELECT file_id, s FROM {wide}) x""",
       RUNS | {"wide": """
SELECT file_id, s FROM (
  SELECT file_id, string_agg(chr(CAST('0x' || b AS INT)), '' ORDER BY i) AS s, count(*) AS n
  FROM (SELECT file_id, i, b, i - 2 * row_number() OVER (PARTITION BY file_id ORDER BY i) AS grp
        FROM (SELECT file_id, i, b, lead(b) OVER (PARTITION BY file_id ORDER BY i) AS nb FROM {chars}) y
        WHERE b BETWEEN '20' AND '7E' AND nb = '00' AND i % 2 = 0) x
  GROUP BY file_id, grp) z WHERE n >= 4"""})
def _(t):
    return text_rules.extract_strings_distinct(t("files"))


CATEGORIZED = f"""
SELECT DISTINCT file_id, s, unnest(list_filter([
    CASE WHEN url THEN 'urls' END,
    CASE WHEN NOT url AND regexp_matches(s, {re2(rules.RE_IP)}) THEN 'ip_addresses' END,
    CASE WHEN regexp_matches(s, {re2(rules.RE_PATH)}) THEN 'file_paths' END,
    CASE WHEN regexp_matches(s, {re2(rules.RE_REGISTRY)}) THEN 'registry_keys' END,
    CASE WHEN regexp_matches(s, {re2(rules.RE_EMAIL)}) THEN 'emails' END,
    CASE WHEN {any_contains('lower(s)', rules.PERSISTENCE_WORDS)} THEN 'persistence_indicators' END,
    CASE WHEN {any_contains('lower(s)', rules.RANSOMWARE_WORDS)} THEN 'ransomware_indicators' END,
    CASE WHEN {any_contains('lower(s)', rules.COMMAND_WORDS)} THEN 'commands' END,
    CASE WHEN regexp_matches(s, {re2(rules.RE_BASE64)}) AND length(s) >= 40 THEN 'base64_blobs' END],
    lambda x: x IS NOT NULL)) AS category
FROM (SELECT file_id, s, regexp_matches(s, {re2(rules.RE_URL)}) AS url
      FROM (SELECT DISTINCT file_id, trim(s, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM {{strings}}) a
      WHERE s <> '') b"""


@query("categorize_strings", "SELECT * FROM {c}", {"c": CATEGORIZED})
def _(t):
    return text_rules.categorize_strings(t("strings"))


@query("cap_categories", """
SELECT file_id, category, s, CAST(row_number() OVER (
    PARTITION BY file_id, category ORDER BY s) AS INT) AS rank FROM {c}""", {"c": CATEGORIZED})
def _(t):
    return text_rules.rank_categories(text_rules.categorize_strings(t("strings")))


@query("iocs_from_strings", """
SELECT file_id, CASE category WHEN 'urls' THEN 'url' ELSE 'ip' END AS ioc_type, s AS ioc_value,
       CASE category WHEN 'urls' THEN 'Extracted URL from PE strings'
            ELSE 'Extracted IP from PE strings' END AS context
FROM {c} WHERE category IN ('urls', 'ip_addresses')""", {"c": CATEGORIZED})
def _(t):
    from tracefold.operators.intel import iocs_from_strings
    return iocs_from_strings(text_rules.categorize_strings(t("strings")))


# --- signatures ------------------------------------------------------------------------

def _shown(pattern: str) -> str:
    data = bytes.fromhex(pattern)
    return data.hex() if len(data) > 5 and b"\0" in data else data.decode("ascii", "replace")


def _pattern_kind(family: str) -> str:
    return "shellcode" if "Shellcode" in family or "NOP" in family else "family"


@query("scan_signatures", """
SELECT file_id, family AS name, arg_min(shown, rank) AS pattern_matched, any_value(kind) AS kind
FROM {files} JOIN {sigs} ON regexp_matches(hex(content), '^(..)*' || pattern)
GROUP BY file_id, family""", {"sigs": values("rank, family, pattern, shown, kind", [
    (i, f, p, _shown(p), _pattern_kind(f)) for i, (f, p) in enumerate(rules.BYTE_SIGNATURES)])})
def _(t):
    return text_rules.scan_signatures(t("files"))


def _rule_hex(kind: str, value: str) -> str:
    if kind == "hex":
        return value
    if kind == "text":
        return value.encode().hex().upper()
    return "".join(f"({c.encode().hex()}|{c.upper().encode().hex()})" for c in value).upper()


@query("scan_rules", """
SELECT file_id, rule, CAST(count(*) AS INT) AS string_hits
FROM {files} JOIN {rs} ON regexp_matches(hex(content), '^(..)*' || pattern)
GROUP BY file_id, rule, needed HAVING count(*) >= needed OR bool_or(override)""", {
    "rs": values("rule, needed, pattern, override", [
        (rule, needed, _rule_hex(*spec), name == override)
        for rule, needed, override, strings in rules.TEXT_RULES
        for name, spec in strings.items()])})
def _(t):
    return text_rules.scan_rules(t("files"))


# --- scripts ------------------------------------------------------------------------------

OBF = ", ".join(f"CASE WHEN regexp_matches(code, {re2('(?i)' + p)}) THEN {literal(p)} END"
                for p in rules.OBFUSCATION_PATTERNS)


@query("obfuscation_flags", f"""
SELECT file_id, array_to_string(f, ',') AS patterns, len(f) > 0 AS eval_usage, base64_detected
FROM (SELECT file_id, list_filter([{OBF}], lambda x: x IS NOT NULL) AS f,
             regexp_matches(code, {re2(rules.RE_BASE64_RUN)}) AS base64_detected FROM {{scripts}}) x""")
def _(t):
    return text_rules.obfuscation_flags(t("scripts")).withColumn(
        "patterns", F.array_join("patterns", ","))


FUNCTION_NAMES = "CASE lang " + " ".join(
    f"WHEN {literal(k)} THEN regexp_extract_all(code, {re2(p)}, 1)"
    for k, p in rules.SCRIPT_FUNCTION_PATTERNS.items()) + " ELSE [] END"


@query("script_functions", f"""
SELECT file_id, pos, func FROM (
  SELECT file_id, unnest(names) AS func, CAST(unnest(range(len(names))) AS INT) AS pos
  FROM (SELECT file_id, list_concat(['__main__'], {FUNCTION_NAMES}) AS names FROM {{scripts}}) x) y""")
def _(t):
    return text_rules.script_functions(t("scripts"))


def placed_sql(pattern: str) -> str:
    """Matches of a pattern as {n, a}: first group and character offset."""
    gaps = f"list_transform(string_split_regex(code, {pattern}), lambda x: length(x))"
    found = f"list_transform(regexp_extract_all(code, {pattern}), lambda x: length(x))"
    return (f"list_transform(range(len({found})), lambda i: {{'n': regexp_extract_all(code, {pattern}, 1)[i + 1], "
            f"'a': CAST(list_sum({gaps}[1:i + 1]) + coalesce(list_sum({found}[1:i]), 0) AS BIGINT)}})")


FUNCTION_PLACES = "CASE lang " + " ".join(
    f"WHEN {literal(k)} THEN {placed_sql(re2(p))}" for k, p in rules.SCRIPT_FUNCTION_PATTERNS.items()) + " END"


@query("script_function_offsets", f"""
SELECT file_id, pos, f.n AS func, f.a AS address FROM (
  SELECT file_id, unnest(list_concat([{{'n': '__main__', 'a': CAST(0 AS BIGINT)}}], places)) AS f,
         CAST(unnest(range(len(places) + 1)) AS INT) AS pos
  FROM (SELECT file_id, coalesce({FUNCTION_PLACES}, []) AS places FROM {{scripts}}) x) y""")
def _(t):
    return text_rules.script_function_offsets(t("scripts"))


@query("script_calls", f"""
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY a, n) - 1 AS INT) AS pos, n AS call, a AS address
FROM (SELECT file_id, unnest(p).n AS n, unnest(p).a AS a FROM (
  SELECT file_id, {placed_sql(re2(rules.RE_JS_CALL))} AS p FROM {{scripts}} WHERE lang = 'js') x) js
UNION ALL
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n) - 1 AS INT), n, min(a)
FROM (SELECT file_id, unnest(p).n AS n, unnest(p).a AS a FROM (
  SELECT file_id, {placed_sql(re2(rules.RE_PS_CMDLET))} AS p FROM {{scripts}} WHERE lang = 'ps1') x) ps GROUP BY file_id, n
UNION ALL
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY i) - 1 AS INT), call,
       CAST(before + length(line) - length(ltrim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS BIGINT)
FROM (SELECT file_id, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS call,
             coalesce(sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING
                                                  AND 1 PRECEDING), 0) AS before
      FROM (SELECT file_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (
        SELECT file_id, string_split(code, chr(10)) AS l FROM {{scripts}} WHERE lang IN ('bat', 'cmd')) a) b) c
WHERE regexp_matches(call, {re2(rules.RE_BATCH_CALL)})""")
def _(t):
    return text_rules.script_calls(t("scripts"))


@query("script_imports", f"""
SELECT file_id, CAST(unnest(range(len(m))) AS INT) AS pos, unnest(m) AS module
FROM (SELECT file_id, list_filter(list_transform(flatten(list_transform(
        regexp_extract_all(code, {re2(rules.RE_PY_IMPORT)}, 1), lambda names: string_split(names, ','))),
        lambda one: regexp_extract(one, {re2(rules.RE_PY_MODULE)}, 1)), lambda m: regexp_matches(m, '[^.]')) AS m
      FROM {{scripts}} WHERE lang = 'py') x""")
def _(t):
    return text_rules.script_imports(t("scripts"))


@query("script_literals", f"""
SELECT file_id, CAST(unnest(range(len(m))) AS INT) AS pos,
       unnest(list_transform(m, lambda s: s[2:-2])) AS literal
FROM (SELECT file_id, regexp_extract_all(code, {re2(rules.RE_PY_LITERAL)}) AS m
      FROM {{scripts}} WHERE lang = 'py') x""")
def _(t):
    return text_rules.script_literals(t("scripts"))


# --- documents --------------------------------------------------------------------------------

VBA = ", ".join(f"CASE WHEN regexp_matches(code, {re2(p)}) THEN {literal(n)} END"
                for n, p in rules.VBA_SUSPICIOUS)


@query("vba_rules", f"""
SELECT file_id, array_to_string(regexp_extract_all(code, {re2(rules.RE_VBA_NAME)}, 1), ',') AS functions,
       CAST(len(regexp_extract_all(code, {re2(rules.RE_VBA_STRING)}, 1)) AS INT) AS n_strings,
       array_to_string(list_filter([{VBA}], lambda x: x IS NOT NULL), ',') AS suspicious,
       regexp_matches(code, {re2(rules.RE_VBA_AUTO)}) AS auto_exec
FROM {{macros}}""")
def _(t):
    return text_rules.vba_rules(t("macros")).select(
        "file_id", F.array_join("functions", ",").alias("functions"),
        F.size("strings").alias("n_strings"),
        F.array_join("suspicious", ",").alias("suspicious"), "auto_exec")


@query("ooxml_rules", """
SELECT container_id, m AS has_macros, e AND NOT m AS external_links FROM (
  SELECT container_id, bool_or(contains(member_path, 'vbaProject.bin')) AS m,
         bool_or(contains(lower(member_path), 'rels') AND (contains(content, 'External')
                 OR contains(content, 'Target="http'))) AS e
  FROM {zip_members} GROUP BY container_id) x""")
def _(t):
    return text_rules.ooxml_rules(t("zip_members"))


@query("pdf_rules", """
SELECT f.file_id, regexp_matches(hex(content), '^(..)*(2F4A617661536372697074|2F4A53)') AS has_javascript,
       array_to_string(list_filter([
         CASE WHEN regexp_matches(hex(content), '^(..)*2F4F70656E416374696F6E') THEN '/OpenAction' END,
         CASE WHEN regexp_matches(hex(content), '^(..)*2F4141') THEN '/AA' END,
         CASE WHEN regexp_matches(hex(content), '^(..)*2F4C61756E6368') THEN '/Launch' END,
         CASE WHEN regexp_matches(hex(content), '^(..)*2F456D62656464656446696C65') THEN '/EmbeddedFile' END],
         lambda x: x IS NOT NULL), ',') AS suspicious,
       coalesce(round(entropy, 4), 0) AS entropy, coalesce(entropy, 0) > 7.5 AS high_entropy
FROM {files} f LEFT JOIN {e} ON f.file_id = e.file_id""",
       {"e": entropy_sql("{files}", "file_id", "content")})
def _(t):
    return text_rules.pdf_rules(t("files")).withColumn(
        "suspicious", F.array_join("suspicious", ","))


@query("rtf_rules", r"""
SELECT page_id, contains(html, chr(92) || 'object') OR contains(lower(html), 'objdata') AS has_ole,
       contains(html, 'Equation.') OR contains(html, '0002CE02') AS equation_editor
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN html || chr(92) || 'object' WHEN 1 THEN html ||
      'OBJDATA' WHEN 2 THEN html || 'Equation.3' ELSE html END AS html FROM {pages}) x""")
def _(t):
    end = F.when(F.col("page_id") % 5 == 0, "\\object").when(
        F.col("page_id") % 5 == 1, "OBJDATA").when(
        F.col("page_id") % 5 == 2, "Equation.3").otherwise("")
    docs = t("pages").select(F.col("page_id").alias("file_id"),
                             F.encode(F.concat("html", end), "UTF-8").alias("content"))
    return text_rules.rtf_rules(docs).withColumnRenamed("file_id", "page_id")


ARGS = ["powershell -w hidden", "x -ENC  abc", "cmd  /c del", "mshta http://x", "regsvr32 /s a",
        "certutil -urlcache", "open file", ""]
SHORTCUTS = f"""
SELECT c_custkey AS file_id, CASE c_custkey % 8 {' '.join(
    f'WHEN {i} THEN {literal(a)}' for i, a in enumerate(ARGS))} END AS arguments,
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '/opt/' || c_mktsegment || '/' || c_name END AS target
FROM {{customer}}"""


@query("shortcut_rules", f"""
SELECT file_id, CASE WHEN target = '' THEN '' ELSE regexp_extract(target, '[^/]*$') END AS call,
       array_to_string(list_filter([{', '.join(
           f"CASE WHEN regexp_matches(arguments, {literal('(?i)' + p)}) THEN {literal(d)} END"
           for p, d in rules.SHORTCUT_PATTERNS)}], lambda x: x IS NOT NULL), ',') AS suspicious
FROM {{s}}""", {"s": SHORTCUTS})
def _(t):
    segment, name = F.col("c_mktsegment"), F.col("c_name")
    rows = t("customer").select(
        F.col("c_custkey").alias("file_id"),
        F.element_at(F.array(*[F.lit(a) for a in ARGS]),
                     (F.col("c_custkey") % 8 + 1).cast("int")).alias("arguments"),
        F.when(F.col("c_custkey") % 5 == 0, "")
        .otherwise(F.concat(F.lit("/opt/"), segment, F.lit("/"), name)).alias("target"))
    return text_rules.shortcut_rules(rows).select(
        "file_id", F.coalesce("call", F.lit("")).alias("call"),
        F.array_join("suspicious", ",").alias("suspicious"))


@query("ini_shortcut_parse", """
SELECT c_custkey AS file_id, CASE WHEN c_custkey % 2 = 0 THEN 'http://h/' || c_custkey ELSE '' END AS url,
       CASE WHEN c_custkey % 3 = 0 THEN '/bin/' || c_mktsegment ELSE 'first' END AS exec,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Application' END AS type
FROM {customer}""")
def _(t):
    key = F.col("c_custkey")
    text = F.concat(
        F.lit("[Desktop]\n"),
        F.when(key % 2 == 0, F.concat(F.lit("URL= http://h/"), key.cast("string"),
                                      F.lit(" \nurl=second\n"))).otherwise(""),
        F.lit("Exec=first\n"),
        F.when(key % 3 == 0, F.concat(F.lit("EXEC=/bin/"), "c_mktsegment", F.lit("\r\n")))
        .otherwise(""), F.when(key % 5 == 0, "").otherwise("Type=Application"))
    rows = t("customer").select(key.alias("file_id"), text.alias("text"))
    return text_rules.ini_shortcut_parse(rows).fillna("", ["url", "exec", "type"])


@query("url_domain", """
SELECT page_id, coalesce(split_part(split_part(url, '//', 2), '/', 1), '') AS domain FROM {pages}""")
def _(t):
    return t("pages").select("page_id", F.coalesce(text_rules.url_domain(F.col("url")), F.lit(""))
                             .alias("domain"))


def _says(text: str, verdict: str) -> str:
    return f"(contains({text}, 'VERDICT: {verdict}') OR contains({text}, 'VERDICT**: {verdict}'))"


@query("verdict_parse", f"""
SELECT analysis_id, kind, v[1] AS verdict,
       coalesce(TRY_CAST(nullif(regexp_extract(txt, {literal(rules.RE_RISK)}, 1), '') AS DOUBLE),
                CAST(v[2] AS DOUBLE)) AS risk_score,
       coalesce(TRY_CAST(nullif(regexp_extract(txt, {literal(rules.RE_CONFIDENCE)}, 1), '') AS DOUBLE),
                CAST(v[3] AS DOUBLE)) AS confidence
FROM (SELECT *, CASE WHEN kind = 'pe' THEN c || chr(10) || r ELSE r END AS txt,
  CASE WHEN kind = 'pe' THEN CASE WHEN {_says('r', 'MALWARE')} THEN ['MALWARE', '75', '85']
       WHEN {_says('r', 'BENIGN')} OR {_says('c', 'BENIGN')} THEN ['BENIGN', '20', '90']
       WHEN {_says('c', 'MALWARE')} THEN ['MALWARE', '75', '85']
       WHEN contains(c, 'BENIGN') AND NOT contains(c, 'MALWARE') THEN ['BENIGN', '20', '90']
       ELSE ['MALWARE', '75', '85'] END
  ELSE CASE WHEN {_says('r', 'MALWARE')} THEN ['MALWARE', '75', '85']
       WHEN {_says('r', 'BENIGN')} THEN ['BENIGN', '15', '90']
       WHEN contains(r, 'MALWARE') THEN ['MALWARE', '70', '80']
       ELSE ['BENIGN', '20', '80'] END END AS v
  FROM (SELECT analysis_id, kind, upper(report_markdown) AS r, upper(comparator_text) AS c
        FROM {{reports}}) a) b""")
def _(t):
    return text_rules.verdict_parse(t("reports"))


@query("report_tables", """
SELECT analysis_id, CAST(r - 1 AS INT) AS row_pos, CAST(dense_rank() OVER (PARTITION BY analysis_id ORDER BY grp) AS INT)
       AS table_id, CASE WHEN first_in THEN 'header' ELSE 'data' END AS row_kind, cell_pos, cell
FROM (SELECT *, dense_rank() OVER (PARTITION BY analysis_id ORDER BY i) AS r FROM (
  SELECT analysis_id, i, grp, first_in,
         CAST(unnest(range(greatest(len(cells) - 2, 0))) AS INT) AS cell_pos,
         unnest(cells[2:-2]) AS cell
  FROM (SELECT *, i = min(i) OVER (PARTITION BY analysis_id, grp) AS first_in,
               string_split(line, '|') AS cells
        FROM (SELECT analysis_id, i, line, i - row_number() OVER (PARTITION BY analysis_id ORDER BY i) AS grp
              FROM (SELECT analysis_id, unnest(string_split(report_markdown, chr(10))) AS line,
                    unnest(range(len(string_split(report_markdown, chr(10))))) AS i FROM {reports}) l
              WHERE ltrim(line) LIKE '|%') g) h
  WHERE NOT contains(line, '---')) k) m""")
def _(t):
    return text_rules.report_tables(t("reports"))


# --- tokens ------------------------------------------------------------------------------------

@query("abstract_number", f"""
SELECT num_id, CASE WHEN m.v IS NOT NULL THEN '<MAGIC_' || m.h || '>'
    WHEN value BETWEEN -1000 AND 1000 THEN '<INT_' || value || '>'
    WHEN value BETWEEN 4194304 AND 2147483647 OR value BETWEEN 4294967296 AND 140737488355327
         OR value BETWEEN 2147483648 AND 4294967295 THEN '<MEM_ADDR>' ELSE '<LARGE_INT>' END AS token
FROM {{numbers}} LEFT JOIN {{m}} ON value = v""", {
    "m": values("v, h", [(n, hex(n)) for n in rules.MAGIC_NUMBERS])})
def _(t):
    return t("numbers").select("num_id", tokens.abstract_number(F.col("value")).alias("token"))


@query("abstract_string", r"""
SELECT text_id, CASE WHEN value IS NULL THEN '<NULL>' WHEN regexp_matches(value, '(?i)^https?://') THEN '<URL>'
    WHEN regexp_matches(value, '^([A-Za-z]:\\|/[a-z]+/)') THEN '<PATH>'
    WHEN regexp_matches(value, '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') THEN '<IP_ADDR>'
    WHEN regexp_matches(value, '^[0-9A-Fa-f]+$') AND length(value) > 8 THEN '<HEX_STRING>'
    WHEN regexp_matches(value, '^[A-Za-z0-9+/]{20,}={0,2}$') THEN '<BASE64>'
    WHEN length(value) <= 16 THEN '<STR_' || regexp_replace(value, '[^a-zA-Z0-9_]', '_', 'g') || '>'
    ELSE '<LONG_STRING>' END AS token
FROM {text_values}""")
def _(t):
    return t("text_values").select("text_id", tokens.abstract_string(F.col("value")).alias("token"))


VOCAB = {"vocab": values("id, token", list(enumerate(rules.vocabulary())))}
TOKEN_TEXTS = """
SELECT o_orderkey AS text_id, CASE o_orderkey % 4 WHEN 0 THEN '<op>.ADD' WHEN 1 THEN
       '<int>.' || CAST(o_custkey % 250 - 120 AS STRING) WHEN 2 THEN '<node>.BLOCK' ELSE 'nope' END AS token
FROM {orders}"""


def _token_texts(t):
    key = F.col("o_orderkey")
    number = (F.col("o_custkey") % 250 - 120).cast("string")
    return t("orders").select(key.alias("text_id"), F.when(key % 4 == 0, "<op>.ADD").when(
        key % 4 == 1, F.concat(F.lit("<int>."), number)).when(key % 4 == 2, "<node>.BLOCK")
        .otherwise("nope").alias("token"))


@query("encode_tokens", """
SELECT text_id, x.token, CAST(coalesce(id, 1) AS INT) AS token_id
FROM {x} LEFT JOIN {vocab} v ON x.token = v.token""", VOCAB | {"x": TOKEN_TEXTS})
def _(t):
    return tokens.encode_tokens(_token_texts(t)).select("text_id", "token", "token_id")


@query("decode_tokens", """
SELECT o_orderkey AS text_id, coalesce(token, '<UNK>') AS token
FROM {orders} LEFT JOIN {vocab} ON o_custkey % 400 = id""", VOCAB)
def _(t):
    ids = t("orders").select(F.col("o_orderkey").alias("text_id"),
                             (F.col("o_custkey") % 400).cast("int").alias("token_id"))
    return tokens.decode_tokens(ids).select("text_id", "token")


@query("integer_token", """
SELECT num_id, CASE WHEN value BETWEEN -100 AND 100 THEN '<int>.' || value ELSE '<LARGE_INT>' END AS token
FROM {numbers}""")
def _(t):
    return t("numbers").select("num_id", tokens.integer_token(F.col("value")).alias("token"))


@query("semantic_id", """
SELECT graph_id, n.id, CAST(coalesce(v.id, 1) AS INT) AS semantic_id FROM (
  SELECT *, CASE WHEN operator_type IS NOT NULL THEN '<op>.' || split_part(operator_type, '.', 2)
      WHEN control_type IS NOT NULL THEN '<ctrl>.' || control_type
      WHEN type = 'LITERAL' THEN CASE WHEN TRY_CAST(value AS BIGINT) BETWEEN -100 AND 100
           THEN '<int>.' || value WHEN TRY_CAST(value AS BIGINT) IS NOT NULL THEN '<LARGE_INT>'
           ELSE '<UNK>' END ELSE '<node>.' || type END AS tok FROM {nodes}) n
LEFT JOIN {vocab} v ON tok = v.token""", VOCAB)
def _(t):
    return tokens.semantic_id(t("nodes")).select("graph_id", "id", "semantic_id")


MARK = "\ue000"  # stands before a capital that opens a word; no text here holds it


def parts_sql(text: str) -> str:
    """Parts of an identifier without look-ahead: capitals that open a word are marked and those
    before another character removed; a line end that closes a part does not count."""
    run = f"regexp_replace(x, '(\\r\\n|[\\n\\r\u0085\u2028\u2029])$', '')"
    run = f"regexp_replace({run}, '([A-Z])([a-z])', '{MARK}\\1\\2', 'g')"
    run = f"regexp_replace({run}, '([A-Z])([^A-Za-z{MARK}])', '\\2', 'gs')"
    found = f"regexp_extract_all({run}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return (f"list_filter(list_transform(flatten(list_transform(regexp_split_to_array({text}, '_+'), lambda x: "
            f"CASE WHEN len({found}) > 0 THEN {found} ELSE [x] END)), lambda x: lower(x)), lambda x: x <> '')")


@query("split_identifier", f"SELECT text_id, array_to_string({parts_sql('text')}, ',') AS parts FROM {{texts}}")
def _(t):
    parts = tokens.split_identifier(F.col("text"))
    return t("texts").select("text_id", F.array_join(parts, ",").alias("parts"))


def _corpus(t):
    return t("documents").select(F.col("doc_id").alias("text_id"), "text")


WORDS = {"corpus_words": f"""
SELECT word, count(*) AS freq FROM (SELECT unnest({parts_sql('text')}) AS word FROM {{documents}}) x GROUP BY word"""}


@query("word_counts", "SELECT word, freq FROM {corpus_words}", WORDS)
def _(t):
    return tokens.word_counts(_corpus(t))


MERGES = 12


def merges_sql(words: str) -> dict[str, str]:
    """One table per merge: the best pair of the words so far, and the words after it."""
    spaced = "regexp_replace(word, '(.)', '\\1 ', 'gs') || '</w>'"
    tables = {"s0": f"SELECT {spaced} AS symbols, freq FROM {{{words}}}"}
    for k in range(MERGES):
        tables[f"b{k}"] = f"""
SELECT l, r, n FROM (SELECT p[i] AS l, p[i + 1] AS r, sum(freq) AS n FROM (
  SELECT p, freq, unnest(range(1, len(p))) AS i FROM (
    SELECT list_filter(string_split(symbols, ' '), lambda x: x <> '') AS p, freq FROM {{s{k}}}) a) c
  GROUP BY ALL) d ORDER BY n DESC, l, r LIMIT 1"""
        tables[f"s{k + 1}"] = (f"SELECT replace(symbols, l || ' ' || r, l || r) AS symbols, freq "
                               f"FROM {{s{k}}}, {{b{k}}}")
    tables["merges"] = " UNION ALL ".join(
        f"SELECT CAST({k} AS INT) AS rank, l AS left, r AS right, l || r AS merged FROM {{b{k}}}" for k in range(MERGES))
    return tables


@query("bpe_train", "SELECT * FROM {merges}", WORDS | merges_sql("corpus_words"))
def _(t):
    return tokens.bpe_train(_corpus(t), MERGES)


def _bpe(t):
    merges = tokens.bpe_train(t("texts"), MERGES)
    return merges, tokens.bpe_vocab(merges)


BASE_TOKENS = ", ".join(f"'{token}'" for token in rules.BPE_BASE_TOKENS)
AFTER = "regexp_replace(word, '(.)', '\\1 ', 'gs') || '</w>'"
for _k in range(MERGES):
    AFTER = (f"replace({AFTER}, (SELECT l || ' ' || r FROM {{b{_k}}}), (SELECT l || r FROM {{b{_k}}}))")
CODED = {"text_words": f"SELECT word, count(*) AS freq FROM (SELECT unnest({parts_sql('text')}) AS word "
                       "FROM {texts}) x GROUP BY word"} | merges_sql("text_words") | {
    "vocab": f"""
SELECT unnest([{BASE_TOKENS}]) AS token, unnest(range({len(rules.BPE_BASE_TOKENS)})) AS id
UNION ALL SELECT merged, {len(rules.BPE_BASE_TOKENS) - 1} + row_number() OVER (ORDER BY min(rank)) FROM {{merges}}
WHERE merged NOT IN ({BASE_TOKENS}) GROUP BY merged""",
    "after": f"SELECT word, list_filter(string_split({AFTER}, ' '), lambda x: x <> '') AS toks FROM {{text_words}}",
    "units": """
SELECT word, tpos, unnest(u) AS unit, unnest(range(len(u))) AS cpos FROM (
  SELECT word, tpos, CASE WHEN v.id IS NULL THEN regexp_extract_all(tok, '(?s).') ELSE [tok] END AS u FROM (
    SELECT word, unnest(toks) AS tok, unnest(range(len(toks))) AS tpos FROM {after}) a
  LEFT JOIN {vocab} v ON v.token = tok) b""",
    "coded": """
SELECT text_id, pos, tpos, cpos, coalesce(v.id, 1) AS id FROM (
  SELECT text_id, unnest(p) AS word, unnest(range(len(p))) AS pos FROM (
    SELECT text_id, %s AS p FROM {texts}) a) w
JOIN {units} u ON u.word = w.word LEFT JOIN {vocab} v ON v.token = unit""" % parts_sql("text")}


@query("bpe_encode", """
SELECT text_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos, tpos, cpos) AS token_ids
FROM {coded} GROUP BY text_id""", CODED)
def _(t):
    merges, vocab = _bpe(t)
    return tokens.bpe_encode(t("texts"), merges, vocab).select(
        "text_id", F.array_join("token_ids", ",").alias("token_ids"))


@query("bpe_decode", """
SELECT text_id, replace(replace(string_agg(token, '' ORDER BY pos, tpos, cpos), '</w>', ' '), ' ', '') AS text
FROM {coded} c JOIN {vocab} v ON v.id = c.id GROUP BY text_id""", CODED)
def _(t):
    merges, vocab = _bpe(t)
    return tokens.bpe_decode(tokens.bpe_encode(t("texts"), merges, vocab), vocab)


@query("pooled_name_vector", """
SELECT text_id, round(sum(m * (i + 1)), 4) AS checksum FROM (SELECT text_id, i, avg(v) AS m FROM (
  SELECT o_orderkey AS text_id, CAST(unnest(range(64)) AS INT) AS i, unnest(embedding) AS v
  FROM {orders} CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) c
  JOIN {embeddings} ON vec_id IN (o_orderkey % n, o_custkey % n)
  WHERE o_orderkey % n <> o_custkey % n) x GROUP BY text_id, i) y GROUP BY text_id""")
def _(t):
    n = t("embeddings").count()
    ids = t("orders").where(F.col("o_orderkey") % n != F.col("o_custkey") % n).select(
        F.col("o_orderkey").alias("text_id"),
        F.array((F.col("o_orderkey") % n).cast("int"), (F.col("o_custkey") % n).cast("int"))
        .alias("token_ids"))
    vectors = t("embeddings").select(F.col("vec_id").cast("int").alias("token_id"),
                                     F.col("embedding").alias("vector"))
    pooled = tokens.pooled_name_vector(ids, vectors, 64)
    weighted = F.transform("vector", lambda v, i: v * (i + 1))
    return pooled.select("text_id", F.round(F.aggregate(
        weighted, F.lit(0.0), lambda a, v: a + v), 4).alias("checksum"))


API_IDS = """
SELECT file_id, seq, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn,
       list_reduce(list_concat([5381::BIGINT], list_transform(regexp_extract_all(
           lower(split_part(func, '!', -1)), '.'), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda h, c: (h * 33 + c) & 4294967295) % 4095 + 1 AS id
FROM {imports} WHERE func IS NOT NULL"""


@query("hash_api_tokens", """
SELECT file_id, rn - 1 AS pos, CAST(id AS INT) AS id FROM {a}""", {"a": API_IDS})
def _(t):
    return tokens.hash_api_tokens(t("imports"))


# --- flagship -------------------------------------------------------------------------------

TRIAGE_SQL = {
    **BASE, "routes": ROUTES, **RUNS,
    "all_strings": "SELECT file_id, s FROM {runs} UNION ALL SELECT file_id, s FROM {wide}",
    "cat": CATEGORIZED.replace("{strings}", "{all_strings}"),
    "e": entropy_sql("{files}", "file_id", "content"),
    "sg": """SELECT file_id, count(DISTINCT family) AS signatures FROM {files} JOIN {sigs}
             ON regexp_matches(hex(content), '^(..)*' || pattern) GROUP BY file_id""",
}
TRIAGE_SQL = {"sigs": values("family, pattern", rules.BYTE_SIGNATURES)} | TRIAGE_SQL


@query("triage", f"""
SELECT i.file_id, coalesce(r.route, CASE WHEN {TEXTUAL} THEN 'script' ELSE 'unsupported' END) AS route,
       CASE WHEN r.route IS NULL AND {TEXTUAL} THEN
            coalesce(nullif(ltrim(lower({SUFFIX}), '.'), ''), 'text') ELSE file_type END AS file_type,
       coalesce(round(entropy, 4), 0) AS file_entropy, {ENTROPY_CLASS} AS entropy_class,
       coalesce(signatures, 0) AS signatures,
       {', '.join(f"coalesce(count_{c}, 0) AS {c}" for c in COUNTED)}
FROM {{ident}} i LEFT JOIN {{routes}} r ON i.file_type = r.kind LEFT JOIN {{e}} ON e.file_id = i.file_id
LEFT JOIN {{sg}} ON sg.file_id = i.file_id LEFT JOIN (
  SELECT file_id, {', '.join(f"count(*) FILTER (WHERE category = '{c}') AS count_{c}" for c in COUNTED)}
  FROM {{cat}} GROUP BY file_id) c ON c.file_id = i.file_id""", TRIAGE_SQL)
def _(t):
    return triage(t("files"))
