"""Tables derived from the provided ones, in SQL that Spark and DuckDB share.

A view names its inputs in braces.  Three markers differ by engine: ``UTF8(x)``
(text to bytes), ``ELEM(x, i)`` (one-based list element) and ``STRING`` casts,
which both accept.
"""

from __future__ import annotations

import re
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

from tracefold import rules
from tracefold.session import among, cut, cut_bucketed, shuffle_partitions, spread

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Tables whose rows are costly to work on, with the key to spread them by.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}

# Views that order all rows of a base table by its key.
WINDOWED = {"lines": ("lineitem", "l_orderkey")}

_EXTRA_APIS = ["OpenProcess", "MiniDumpWriteDump", "FindFirstFileA", "FindNextFileW",
               "CreateWindowExA", "lstrcpyA", "MessageBoxW", "ExitProcess"]
API_NAMES = list(dict.fromkeys(
    [n for names in rules.BEHAVIOR_APIS.values() for n in names] + rules.ANTI_DEBUG_APIS
    + rules.TIMING_APIS + rules.INPUT_APIS + _EXTRA_APIS))
EXPORT_NAMES = rules.SUSPICIOUS_EXPORTS + ["Alpha", "Beta", "run", "Gamma"]
PCODES = list(rules.PCODE_TYPES) + ["PIECE", "MULTIEQUAL"]


def literal(value) -> str:
    if isinstance(value, str):
        # Both engines read a doubled quote; a backslash needs its own function.
        parts = value.split("\\")
        quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
        return quoted[0] if len(quoted) == 1 else (
            "concat(" + ", chr(92), ".join(quoted) + ")")
    return str(value)


def values(columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def choose(key: str, options: list[str], otherwise: str | None = None) -> str:
    """CASE over the remainders 0, 1, 2, ... of a key; options are SQL texts."""
    last = f" ELSE {otherwise}" if otherwise is not None else ""
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {key} {whens}{last} END"


def _q(*texts: str) -> list[str]:
    return [literal(t) for t in texts]


def _braced(sql: str) -> str:
    """Angle brackets as brace characters, which mark view inputs in these texts."""
    return sql.replace("<", "' || chr(123) || '").replace(">", "' || chr(125) || '")


_PREFIXES = [
    "4D5A", "4D5A900003000000", "504B0304", "25504446", "7B5C727466", "D0CF11E0A1B11AE1",
    "7F454C46", "FEEDFACE", "1F8B08", "526172211A07", "4C00000001140200", "CAFEBABE",
    "64A130000000E8FBFFFFFFC3EB02E900010000", b"keylogger SCREENSHOT ".hex(),
    b"keepalive /OpenAction /JS ".hex(), b"vmware VBOX std::panicking ".hex(),
    "68007400740070003A002F00" + "90" * 16,
]
_EXTENSIONS = [".exe", ".DLL", ".sys", ".js", ".ps1", ".docx", ".zip", ".msi", ".txt", "",
               ".json", ".tar.gz", ".htm"]
_SECTION_NAMES = [".text", ".rdata", ".data", ".rsrc", "UPX0", ".vmp1", ".Themida", "CODE",
                  ".mpress1", ".aspack", "", ".gopclntab"]
_NEWLINE = "chr(10)"

VIEWS: dict[str, str] = {
    # --- files and content ------------------------------------------------------
    # Every document, and an empty file beside each 97th of them.
    "files": f"""
SELECT file_id, concat('/corpus/', folder, '/', name) AS path, name, content, n AS size
FROM (SELECT file_id, n,
             {choose('file_id % 4', _q('malware', 'Malicious_set', 'benigns', 'misc'))} AS folder,
             concat(CASE WHEN file_id % 41 = 7 THEN '.' ELSE '' END, 'd',
                    CAST(file_id AS STRING), {choose('file_id % 13', _q(*_EXTENSIONS))}) AS name,
             CASE WHEN blank THEN unhex('')
                  ELSE unhex({choose('file_id % 17', _q(*_PREFIXES))}) || UTF8(text) END AS content
      FROM (SELECT CASE WHEN blank THEN doc_id + 1000000000 ELSE doc_id END AS file_id,
                   CASE WHEN blank THEN CAST(0 AS BIGINT) ELSE n_chars END AS n, text, blank
            FROM (SELECT doc_id, n_chars, text, EACH(CASE WHEN doc_id % 97 = 5 THEN LIST(FALSE, TRUE)
                                                     ELSE LIST(FALSE) END) AS blank
                  FROM {{documents}}) AS a) AS b) AS d""",
    "strings": f"""
SELECT doc_id AS file_id, CAST(0 AS BIGINT) AS pos, text AS s FROM {{documents}}
UNION ALL
SELECT page_id AS file_id, CAST(1 AS BIGINT) AS pos, url AS s FROM {{pages}}
UNION ALL
SELECT c_custkey % 200 AS file_id, CAST(2 AS BIGINT) AS pos,
       concat({choose('c_custkey % 9', [
           "concat('C:', chr(92), 'Temp', chr(92), 'a')",
           "concat('HKLM', chr(92), 'Software', chr(92), 'Run')", "'cmd.exe /c dir '",
           "'mail to ops@example.org '", "'10.0.0.'", "'  powershell -enc '",
           "'http://h.example/'", "'pay bitcoin '",
           "'QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJz'"])},
           CAST(c_custkey % 25 AS STRING)) AS s FROM {{customer}}""",
    "section_bytes": """
SELECT conv_id AS file_id, turn AS seq, UTF8(text) AS data FROM {conversations}""",
    "code": """
SELECT conv_id AS file_id, turn AS seq, 4198400 + turn * 65536 AS base_addr,
       unhex(CASE turn % 3 WHEN 0 THEN 'E8FBFFFFFFC3' WHEN 1 THEN 'EBFEE910000000'
             ELSE 'E90000E8C3' END) || UTF8(text) || unhex('E8C3EB') AS data
FROM {conversations}""",
    "scripts": f"""
SELECT page_id AS file_id, {choose('page_id % 6', _q('js', 'ps1', 'vbs', 'sh', 'bat', 'py'))}
       AS lang,
       concat(html, {_NEWLINE}, {choose('page_id % 6', [
           _braced("'function alpha(x) < beta(x); eval (y) > function gamma (a, b) < >'"),
           _braced("'Function Get-Data < Get-Item a; Invoke-Expression b; Get-Item c >'"),
           "'Sub Main' || chr(10) || 'Function Calc(a)' || chr(10) || 'End Function'",
           _braced("'start() <' || chr(10) || ' run; >' || chr(10) || 'stop ( ) < exit; >'"),
           "'@call setup.bat' || chr(10) || '  start x' || chr(10) || 'echo cmd' || chr(10) || 'cmd /c y'",
           "'import os.path' || chr(10) || 'from sys import x' || chr(10) || 'def load(a):' || chr(10) || '    s = \"some text\"'"])})
       AS code
FROM {{pages}}""",
    "macros": """
SELECT page_id AS file_id,
       concat('Sub Auto_Open()', chr(10), CASE page_id % 4
           WHEN 0 THEN 'Set x = CreateObject("WScript.Shell")' WHEN 1 THEN 'Shell "calc"'
           WHEN 2 THEN 'a = Environ("TEMP")' ELSE 'URLDownloadToFile 0, "http://e.org/x"' END,
           chr(10), 'End Sub', chr(10), CASE WHEN page_id % 5 = 0 THEN 'Function Foo(a)' ELSE '' END,
           chr(10), html) AS code
FROM {pages}""",
    "zip_members": f"""
SELECT p_partkey % 400 AS container_id, p_partkey AS member_seq,
       concat({choose('p_partkey % 12', _q(
           'AndroidManifest.xml', 'classes.dex', 'META-INF/MANIFEST.MF', 'a/B.class',
           '[Content_Types].xml', 'word/document.xml', 'xl/book.xml', 'ppt/slide1.xml',
           '../../etc/passwd', '/abs/./x/../y', 'docs/', 'word/_rels/document.xml.rels'))},
           CASE WHEN p_partkey % 12 = 3 THEN '' WHEN p_partkey % 36 = 8 THEN '/..' ELSE '' END,
           CASE WHEN p_partkey % 60 = 5 THEN 'vbaProject.bin' ELSE '' END) AS member_path,
       CASE WHEN p_partkey % 3 = 0 THEN 'Mode="External"' ELSE p_name END AS content
FROM {{part}}""",
    "disk_entries": f"""
SELECT p_partkey AS entry_id,
       {choose('p_partkey % 8', ["''", "'.'", "'/abs/dir/'", "concat('a', chr(92), 'b')", "'../up'", "'x/../y//'",
                                 "concat(chr(92), chr(92), 'share')", "p_brand"])} AS directory,
       concat({choose('p_partkey % 5', ["''", "'sub/'", "concat('c', chr(92))", "'..'", "'/'"])}, p_name) AS name
FROM {{part}}""",
    "ole_streams": f"""
SELECT c_custkey % 300 + CASE WHEN c_custkey % 5 = 0 THEN 10000000 ELSE 0 END AS file_id, {choose('c_custkey % 7', _q(
    'WordDocument', 'Workbook', 'PowerPoint Document', '_Tables', 'Data', 'Book', 'Other'))}
       AS stream
FROM {{customer}}""",
    "listing": """
SELECT path, name, size FROM {files}""",
    # --- headers and sections ------------------------------------------------------
    "file_keys": "SELECT o_orderkey AS file_id FROM {orders}",
    "lines": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
            l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS seq
FROM {lineitem}""",
    "headers": """
SELECT o_orderkey AS file_id,
       CASE WHEN o_custkey % 29 = 0 THEN 23118 ELSE 23117 END AS e_magic,
       CASE o_custkey % 6 WHEN 0 THEN 332 WHEN 1 THEN 34404 WHEN 2 THEN 448 WHEN 3 THEN 43620
            WHEN 4 THEN 0 ELSE 512 + o_custkey % 100 END AS machine,
       CASE o_custkey % 3 WHEN 0 THEN 267 WHEN 1 THEN 523 ELSE 263 END AS opt_magic,
       CASE WHEN o_orderkey % 50 = 0 THEN 0
            ELSE 500000000 + (o_orderkey * 97003) % 1500000000 END AS timestamp,
       (o_orderkey * 31) % 16384 AS characteristics, o_custkey % 16 AS subsystem,
       (o_orderkey * 17 + o_custkey) % 32768 AS dll_chars,
       CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey * 7 END AS checksum,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 7 + 1 ELSE o_orderkey * 7 END
           AS checksum_computed,
       CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 4096 + (o_orderkey * 613) % 60000 END AS ep_rva,
       4194304 * (1 + o_custkey % 3) AS image_base,
       o_orderkey % 3 = 0 AS rich_attr, o_orderkey % 6 = 0 AS rich_present
FROM {orders}""",
    "sections": f"""
SELECT l_orderkey AS file_id, seq, {choose('l_partkey % 12', _q(*_SECTION_NAMES))} AS name,
       seq * 4096 AS va, (l_partkey * 13) % 9000 AS virtual_size, seq * 512 AS raw_ptr,
       CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE (l_partkey * 7) % 6000 END AS raw_size,
       CASE l_suppkey % 4 WHEN 0 THEN 3758096416 WHEN 1 THEN 1610612768
            WHEN 2 THEN 3221225536 ELSE 1107296320 END AS flags,
       (l_partkey * 37 % 8000) / 1000e0 AS entropy
FROM {{lines}}""",
    "compiler_sections": f"""
SELECT l_orderkey AS file_id, seq, {choose('(l_partkey + l_orderkey % 3) % 9', _q(
    '.text', '.rdata', '.data', 'CODE', 'DATA', 'BSS', '.idata$', '.go.x', '.reloc'))} AS name
FROM {{lines}}""",
    "overlay_sections": """
SELECT l_orderkey AS file_id, seq, seq * 40 AS raw_ptr, l_partkey % 60 AS raw_size FROM {lines}""",
    "rich_values": """
SELECT l_orderkey AS file_id, seq AS pos,
       CASE WHEN seq % 2 = 1 THEN l_partkey * 65536 + l_suppkey ELSE l_suppkey * 1000 END AS value
FROM {lines}""",
    "tls_pointers": """
SELECT l_orderkey AS file_id, seq AS idx,
       CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 4198400 + l_partkey END AS ptr FROM {lines}""",
    "relocations": """
SELECT l_orderkey + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 10000000 END AS file_id, seq FROM {lines}""",
    "resources": """
SELECT p_partkey % 10 AS file_id, p_partkey AS seq, p_type AS res_type, p_brand AS res_name,
       p_size * 100 AS size,
       unhex(CASE p_partkey % 7 WHEN 0 THEN '4D5A9000' WHEN 1 THEN '0011223350450000FF'
             WHEN 2 THEN '0050004500' ELSE '00112233' END) || UTF8(p_name) AS data
FROM {part}""",
    "version_info": f"""
SELECT c_custkey AS file_id, 'CompanyName' AS key, {choose('c_custkey % 9', _q(
    'Microsoft Corporation', 'Microsft Corp', 'Google Inc', 'Gogle LLC', 'Acme',
    'microsoft corp', 'Google LLC', ' Micosoft ', 'Microsof'))} AS value FROM {{customer}}
UNION ALL
SELECT c_custkey AS file_id, 'ProductName' AS key, {choose('c_custkey % 4', _q(
    'Windows', 'Tool', '', 'Microsoft Office'))} AS value FROM {{customer}}""",
    "certificates": """
SELECT c_custkey AS file_id, c_custkey % 4 <> 0 AS is_signed, c_custkey % 5 <> 0 AS parsed,
       c_custkey % 3 = 0 AS verified, concat('CN=', CAST(c_nationkey % 5 AS STRING)) AS issuer,
       concat('CN=', CAST(c_custkey % 5 AS STRING)) AS subject
FROM {customer}""",
    # --- imports, exports, instructions ------------------------------------------------
    "api_names": values("i, api", list(enumerate(API_NAMES))),
    "export_names": values("i, export_name", list(enumerate(EXPORT_NAMES))),
    "pcode_names": values("i, pcode", list(enumerate(PCODES))),
    "imports": f"""
SELECT l_orderkey AS file_id, seq,
       concat('Lib', CAST(l_suppkey % 6 AS STRING),
              CASE l_suppkey % 3 WHEN 0 THEN '.dll' WHEN 1 THEN '.DLL' ELSE '.ocx' END) AS dll,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE api END AS func, l_partkey AS ordinal,
       CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE 4198400 + (l_partkey % 50) * 4 END AS address,
       l_returnflag = 'R' AND l_linenumber > 4 AS delayed
FROM {{lines}} JOIN {{api_names}} ON l_partkey % {len(API_NAMES)} = i""",
    "exports": f"""
SELECT l_suppkey AS file_id, l_orderkey * 16 + seq AS seq,
       CASE WHEN l_suppkey % 5 = 0 AND l_partkey % 4 <> 0 THEN NULL
            WHEN l_suppkey % 7 = 0 THEN 'Plain' ELSE export_name END AS name,
       l_partkey AS ordinal
FROM {{lines}} JOIN {{export_names}} ON (l_partkey + l_suppkey) % {len(EXPORT_NAMES)} = i""",
    "pcode_ops": f"""
SELECT l_orderkey AS file_id, seq, pcode FROM {{lines}}
JOIN {{pcode_names}} ON l_partkey % {len(PCODES)} = i""",
    "instructions": """
SELECT user_id AS file_id, event_id AS idx, 4194304 + event_id * 4 AS address,
       CASE event_type WHEN 'view' THEN 'call'
            WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'push' WHEN 1 THEN 'sub' ELSE 'mov' END
            WHEN 'error' THEN CASE WHEN event_id % 4 = 1 THEN 'je'
                 WHEN event_id % 4 = 2 AND user_id % 3 = 0 THEN 'rdtsc' ELSE 'jmp' END
            WHEN 'click' THEN CASE WHEN event_id % 10 = 0 AND user_id % 2 = 0 THEN 'cpuid'
                 ELSE 'ret' END
            ELSE 'add' END AS mnemonic,
       CASE event_type WHEN 'view' THEN CASE WHEN event_id % 2 = 0
                 THEN concat('dword ptr [0x', lower(hex(4198400 + (event_id % 50) * 4)), ']')
                 ELSE '0x401000' END
            WHEN 'signup' THEN CASE event_id % 3
                 WHEN 0 THEN CASE WHEN event_id % 2 = 0 AND user_id % 5 <> 0 THEN 'ebp'
                      ELSE 'eax' END
                 WHEN 1 THEN CASE WHEN event_id % 2 = 0 AND user_id % 5 <> 0 THEN 'rsp, 0x20'
                      ELSE 'eax, 1' END ELSE '' END
            WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN '0x402000' ELSE 'eax' END
            ELSE '' END AS op_str
FROM {events}""",
    # --- graphs --------------------------------------------------------------------------
    "functions": """
SELECT c_custkey % 25 AS graph_id, concat('fn', CAST(c_custkey AS STRING)) AS func,
       c_custkey AS func_seq,
       CASE WHEN c_custkey % 4 = 0 THEN concat('void fn', CAST(c_custkey AS STRING)) ELSE '' END
           AS signature,
       c_custkey * 16 AS address, c_custkey % 7 = 0 AS is_external,
       CASE c_custkey % 3 WHEN 0 THEN last_order WHEN 1 THEN -5 ELSE NULL END AS entry_block_id
FROM {customer} LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS last_order FROM {orders}
                           GROUP BY o_custkey) AS m ON c_custkey = o_custkey""",
    "blocks": """
SELECT o_custkey % 25 AS graph_id, concat('fn', CAST(o_custkey AS STRING)) AS func,
       o_orderkey AS block_id, o_orderkey AS block_seq, o_orderkey * 64 AS start
FROM {orders}""",
    "successors": """
SELECT graph_id, func, block_id, succ_id FROM (
  SELECT graph_id, func, block_id, lead(block_id) OVER (PARTITION BY func ORDER BY block_id)
         AS succ_id FROM {blocks}
  UNION ALL
  SELECT graph_id, func, block_id, lag(block_id) OVER (PARTITION BY func ORDER BY block_id)
         AS succ_id FROM {blocks} WHERE block_id % 2 = 0
  UNION ALL
  SELECT graph_id, func, block_id, -1 AS succ_id FROM {blocks} WHERE block_id % 10 = 0) AS s
WHERE succ_id IS NOT NULL""",
    "block_lines": """
SELECT o_custkey % 25 AS graph_id, concat('fn', CAST(o_custkey AS STRING)) AS func,
       l_orderkey AS block_id, seq AS idx, l_partkey, l_suppkey, l_linenumber,
       concat('fn', CAST(o_custkey % 25 + 25 * (l_suppkey % 10) AS STRING)) AS callee
FROM {lines} JOIN {orders} ON l_orderkey = o_orderkey""",
    "block_instructions": """
SELECT graph_id, func, block_id, idx,
       CASE l_partkey % 8 WHEN 0 THEN 'CALL' WHEN 1 THEN 'LOAD' WHEN 2 THEN 'STORE'
            WHEN 3 THEN 'ADD' WHEN 4 THEN 'BRANCH' WHEN 5 THEN 'CBRANCH' WHEN 6 THEN 'RETURN'
            ELSE 'COPY' END AS inst_type,
       CASE l_suppkey % 3 WHEN 0 THEN concat('CALL ', callee) WHEN 1 THEN concat(' ', callee, ' ')
            ELSE '' END AS raw_text,
       CASE WHEN l_suppkey % 4 = 0 THEN callee ELSE 'eax' END AS operand_name,
       CASE WHEN l_suppkey % 5 = 0 THEN concat('fn', CAST(graph_id AS STRING)) ELSE NULL END
           AS operand_value
FROM {block_lines}""",
    "listed_calls": """
SELECT graph_id, func, callee FROM {block_lines} WHERE l_partkey % 40 = 0""",
    "operands": """
SELECT graph_id, func, block_id, idx, concat('v', CAST(l_partkey % 7 AS STRING)) AS var,
       l_suppkey % 2 = 0 AS is_input, l_suppkey % 3 = 0 AS is_output,
       CASE WHEN l_linenumber = 7 THEN 'constant' ELSE 'register' END AS op_type
FROM {block_lines}""",
    "nodes": f"""
SELECT graph_id, id, {choose('id % 11', _q(
           'METHOD', 'BLOCK', 'BLOCK', 'BLOCK', 'BLOCK', 'CALL', 'OPERATOR', 'CONTROL_STRUCTURE',
           'IDENTIFIER', 'LITERAL', 'RETURN'))} AS type,
       CASE WHEN id % 11 = 0 THEN concat('KERNEL32.dll!', {choose('id % 4', _q(
                'VirtualAllocEx', 'Sleep', 'Foo', 'ab'))})
            ELSE concat('n', CAST(id AS STRING)) END AS name,
       id % 33 = 0 AND id % 2 = 0 AS is_external, id * 3 AS line,
       CASE id % 11 WHEN 6 THEN concat('<operator>.', {choose('id % 3', _q(
                'addition', 'load', 'cast'))}) ELSE NULL END AS operator_type,
       CASE id % 11 WHEN 7 THEN {choose('id % 3', _q('IF', 'WHILE', 'TRY'))} ELSE NULL END
           AS control_type,
       CASE WHEN id % 11 <> 9 THEN NULL ELSE {choose('id % 5', [
                "CAST(id AS STRING)", "'-7'", "'http://x'", "NULL", "'12345'"])} END AS value
FROM (SELECT o_orderkey % 50 AS graph_id, CAST(floor(o_orderkey / 50) AS BIGINT) AS id
      FROM {{orders}}) AS o""",
    "edges": f"""
SELECT l_orderkey % 50 AS graph_id, CAST(floor(l_orderkey / 50) AS BIGINT) AS src,
       l_partkey % 300 AS dst, {choose('l_suppkey % 8', _q(*rules.EDGE_TYPES))} AS etype
FROM {{lineitem}}""",
    "inst_counts": """
SELECT graph_id, id, key, sum(n) AS n FROM (
  SELECT l_orderkey % 50 AS graph_id, CAST(floor(l_orderkey / 50) AS BIGINT) AS id,
         CASE l_partkey % 9 WHEN 0 THEN 'CALL' WHEN 1 THEN 'LOAD' WHEN 2 THEN 'STORE'
              WHEN 3 THEN 'BRANCH' WHEN 4 THEN 'CBRANCH' WHEN 5 THEN 'RETURN'
              WHEN 6 THEN '<operator>.cast' WHEN 7 THEN 'FINALLY' ELSE '<operator>.addition' END
              AS key, l_linenumber AS n FROM {lineitem}) AS k
WHERE id % 11 IN (1, 2, 3, 4) GROUP BY graph_id, id, key""",
    "features_rows": """
SELECT l_orderkey AS node_id, seq AS dim, l_quantity / 50e0 AS value FROM {lines}""",
    "attention": """
SELECT l_orderkey % 50 AS graph_id, l_partkey % 300 AS dst, l_orderkey * 16 + seq AS edge_id,
       (l_quantity - 25) / 10e0 AS score FROM {lines}""",
    "items": """
SELECT file_id, 'imports' AS kind, seq AS pos, concat(dll, '!', func) AS value FROM {imports}
WHERE func IS NOT NULL
UNION ALL
SELECT file_id, 'exports' AS kind, seq AS pos, name AS value FROM {exports} WHERE name IS NOT NULL
UNION ALL
SELECT user_id AS file_id, 'strings' AS kind, event_id AS pos, props AS value FROM {events}""",
    # --- containers ------------------------------------------------------------------------
    "members": """
SELECT CAST(floor((i - 1) / 3) AS BIGINT) AS container_id, i AS member_seq, i AS item_id,
       CASE WHEN i % 17 = 0 THEN concat('d', CAST(i % 3 AS STRING))
            ELSE concat('h', CAST(i AS STRING)) END AS hash, i % 5 <> 0 AS is_container
FROM (SELECT p_partkey AS i FROM {part}) AS p WHERE i > 0""",
    "roots": """
SELECT p_partkey AS root_id, p_partkey AS item_id,
       CASE WHEN p_partkey % 17 = 0 THEN concat('d', CAST(p_partkey % 3 AS STRING))
            ELSE concat('h', CAST(p_partkey AS STRING)) END AS hash, TRUE AS is_container
FROM {part}""",
    # --- store, indicators, events ------------------------------------------------------------
    "analyses": """
SELECT concat('a', CAST(o_orderkey AS STRING)) AS id, concat('f', CAST(o_custkey AS STRING))
           AS file_hash, concat('file', CAST(o_custkey % 50 AS STRING)) AS file_name,
       o_orderpriority AS file_type,
       CASE WHEN o_orderkey % 3 = 0 THEN 'MALWARE' ELSE 'BENIGN' END AS verdict,
       (o_orderkey % 100) / 1e0 AS confidence, (o_custkey % 100) / 1e0 AS risk_score,
       o_orderdate AS created_at
FROM {orders}""",
    "incoming": """
SELECT concat('a', CAST(o_orderkey % 2000 AS STRING)) AS id,
       concat('f', CAST((o_custkey * 7) % 1000 AS STRING)) AS file_hash,
       'new' AS file_name, o_orderpriority AS file_type, 'MALWARE' AS verdict,
       50e0 AS confidence, (o_orderkey % 100) / 1e0 AS risk_score, o_orderdate AS created_at
FROM {orders}""",
    "iocs": """
SELECT concat('a', CAST(l_orderkey + CASE WHEN l_suppkey % 9 = 0 THEN 10000000 ELSE 0 END
              AS STRING)) AS analysis_id,
       CASE l_linenumber % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'ip' ELSE 'domain' END AS ioc_type,
       concat('v', CAST(l_partkey AS STRING)) AS ioc_value,
       concat('ctx', CAST(l_suppkey % 4 AS STRING)) AS context,
       CASE WHEN l_quantity % 10 = 3 THEN NULL ELSE CAST(l_quantity % 10 AS INT) END AS threat_level,
       l_shipdate AS created_at
FROM {lineitem}""",
    "parts": """
SELECT concat('a', CAST(l_orderkey + CASE WHEN l_orderkey % 6 = 0 THEN 10000000 ELSE 0 END AS STRING))
           AS analysis_id, seq AS part_seq,
       CASE WHEN l_suppkey % 2 = 0 THEN 'pe' ELSE 'script' END AS kind,
       concat('p', CAST(l_partkey AS STRING)) AS file_name,
       CASE WHEN l_partkey % 5 = 0 THEN 'MALWARE' ELSE 'BENIGN' END AS verdict,
       (l_partkey % 101) / 1e0 AS risk_score, (l_suppkey % 101) / 1e0 AS confidence,
       concat('report ', CAST(l_suppkey AS STRING)) AS report_markdown
FROM {lines}""",
    "reports": """
SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS analysis_id,
       CASE WHEN turn % 2 = 0 THEN 'pe' ELSE 'script' END AS kind,
       concat(CASE (conv_id + turn) % 7 WHEN 0 THEN '**Verdict**: Malware' WHEN 1 THEN 'VERDICT: benign'
                   WHEN 2 THEN 'seems malware' WHEN 3 THEN 'Risk score: 42' WHEN 4 THEN
                   'Threat Matrix  Score **: 7' WHEN 5 THEN 'Confidence: 88 percent' ELSE '' END,
              chr(10), '| Name | Value |', chr(10), '|---|---|', chr(10), '| turn | ',
              CAST(turn AS STRING), ' |', chr(10), text, chr(10), '| tail |', chr(10), ' |x|y|z|',
              chr(10)) AS report_markdown,
       CASE conv_id % 4 WHEN 0 THEN 'Verdict: BENIGN' WHEN 1 THEN 'verdict: malware. confidence 61'
            WHEN 2 THEN 'looks benign' ELSE '' END AS comparator_text
FROM {conversations}""",
    "roles": values("i, role", list(enumerate(
        rules.PARALLEL_ROLES + ["Results Analysis Coordinator", "Report Generator"]))),
    "analysis_events": """
SELECT concat('a', CAST(user_id AS STRING)) AS analysis_id, event_id AS seq, ts,
       CASE event_type
            WHEN 'view' THEN CASE event_id % 3 WHEN 0 THEN 'step_started' WHEN 1 THEN 'step_progress'
                 ELSE 'step_completed' END
            WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'analysis_started'
                 ELSE 'file_identified' END
            WHEN 'click' THEN CASE event_id % 2 WHEN 0 THEN 'agent_completed'
                 ELSE 'agent_thinking' END
            WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'agent_started'
                 WHEN 1 THEN 'agent_failed' ELSE 'agent_completed' END
            ELSE CASE WHEN event_id % 11 = 0 THEN 'analysis_failed'
                 WHEN event_id % 11 = 1 THEN 'analysis_completed' ELSE 'log' END END AS event_type,
       CASE event_id % 4 WHEN 0 THEN 'pe_analysis' WHEN 1 THEN 'agents_analysis'
            WHEN 2 THEN 'ml_prediction' ELSE 'routing' END AS step,
       CASE WHEN event_type IN ('click', 'purchase') THEN role ELSE NULL END AS agent,
       (event_id % 100) / 100e0 AS progress,
       CASE WHEN event_id % 2 = 0 THEN '' ELSE concat('m', CAST(event_id AS STRING)) END AS message,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('t', CAST(event_id % 9 AS STRING)) END
           AS file_type,
       concat('c', CAST(event_id % 4 AS STRING)) AS category,
       concat('r', CAST(event_id % 3 AS STRING)) AS route,
       CASE WHEN event_id % 3 = 0 THEN 'MALWARE' ELSE 'BENIGN' END AS label,
       props AS output
FROM {events} JOIN {roles} ON event_id % 7 = i""",
    "kb": """
SELECT 'malware_families' AS category, concat('fam', CAST(c_custkey + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 10000000 END AS STRING)) AS key,
       CAST(NULL AS BIGINT) AS count, concat('old', CAST(c_custkey AS STRING)) AS last_seen_file,
       c_custkey AS sample_size FROM {customer}
UNION ALL
SELECT 'evasion_techniques' AS category, concat(api, CASE WHEN i % 2 = 0 THEN '' ELSE '_old' END) AS key, CAST(i AS BIGINT) AS count,
       CAST(NULL AS STRING) AS last_seen_file, CAST(NULL AS BIGINT) AS sample_size
FROM {api_names}""",
    "families": """
SELECT concat('fam', CAST(o_custkey AS STRING)) AS family, concat('file', CAST(o_orderkey AS STRING))
           AS file_name, o_orderkey * 10 AS file_size, o_orderkey AS seq FROM {orders}""",
    "debug_hits": f"""
SELECT file_id, func AS api FROM {{imports}}
WHERE func IN ({', '.join(_q(*rules.ANTI_DEBUG_APIS))})""",
    "kb_entries": """
SELECT 'mixed' AS category,
       concat('k', CAST(c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 10000000 END AS STRING)) AS key,
       CASE c_custkey % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'struct' ELSE 'scalar' END AS kind,
       concat('old', CAST(c_custkey % 4 AS STRING)) AS value FROM {customer}""",
    "kb_new": """
SELECT 'mixed' AS category, concat('k', CAST(o_custkey AS STRING)) AS key, o_orderkey AS seq,
       CASE o_custkey % 3 WHEN 0 THEN 'list' WHEN 1 THEN 'struct' ELSE 'scalar' END AS kind,
       CASE o_custkey % 3 WHEN 1 THEN concat('f', CAST(o_orderkey % 3 AS STRING)) ELSE NULL END
           AS field,
       concat(CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE 'new' END,
              CAST(o_orderkey % 4 AS STRING)) AS value FROM {orders}""",
    # --- predictions --------------------------------------------------------------------------
    "predictions": " UNION ALL ".join(
        f"""SELECT vec_id AS sample_id, {m} AS model_id, {p} AS pass, {c} AS class,
       {'1e0 - ' if c == 0 else ''}(1e0 / (1e0 + exp(-9e0 * CAST(ELEM(embedding, {m * 5 + p + 1})
        AS DOUBLE)))) AS prob FROM {{embeddings}}"""
        for m in range(3) for p in range(4) for c in range(2)),
    "scores": """
SELECT l_orderkey * 16 + seq AS sample_id, (l_partkey % 97) / 97e0 AS score,
       CAST((l_partkey + l_suppkey) % 3 % 2 AS INT) AS label FROM {lines}""",
    "results": """
SELECT l_orderkey * 16 + seq AS sample_id, concat('/x/', CAST(l_orderkey AS STRING)) AS path,
       CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS INT) AS prediction,
       CAST(CASE WHEN l_linenumber = 5 THEN 7 ELSE l_partkey % 2 END AS INT) AS label FROM {lines}""",
    "samples": """
SELECT doc_id AS file_id, toxic AS label FROM {labels}""",
    "texts": """
SELECT p_partkey AS text_id, concat(p_type, replace(p_brand, '#', '_'), '__', replace(p_name, ' ', '_'),
       'Ex', CAST(p_size AS STRING)) AS text FROM {part}""",
    "numbers": """
SELECT l_orderkey * 16 + seq AS num_id,
       CASE l_suppkey % 11 WHEN 0 THEN l_partkey - 1000 WHEN 1 THEN l_partkey * 1000003
            WHEN 2 THEN 23117 WHEN 3 THEN 3405691582 WHEN 4 THEN l_partkey * 4294967296
            WHEN 5 THEN -l_partkey * 100 WHEN 6 THEN 4194304 + l_partkey
            WHEN 7 THEN 2147483648 + l_partkey WHEN 8 THEN l_partkey % 256
            WHEN 9 THEN 140737488355328 + l_partkey ELSE 1000 + l_partkey % 3 END AS value
FROM {lines}""",
    "text_values": """
SELECT c_custkey AS text_id, CASE c_custkey % 10
    WHEN 0 THEN 'HTTPS://a.example/x' WHEN 1 THEN concat('c:', chr(92), 'dir')
    WHEN 2 THEN '/usr/bin/x' WHEN 3 THEN concat('10.1.2.', CAST(c_custkey % 300 AS STRING))
    WHEN 4 THEN 'DEADBEEF99' WHEN 5 THEN 'QUJDREVGR0hJSktMTU5PUA=='
    WHEN 6 THEN c_name WHEN 7 THEN c_mktsegment
    WHEN 8 THEN concat(c_name, ' ', c_mktsegment, ' long text') ELSE NULL END AS value
FROM {customer}""",
}

_INPUT = re.compile(r"\{([a-z]\w*)\}")


def inputs_of(sql: str) -> list[str]:
    return list(dict.fromkeys(_INPUT.findall(sql)))


def for_spark(sql: str) -> str:
    sql = re.sub(r"UTF8\((\w+)\)", r"encode(\1, 'UTF-8')", sql)
    return sql.replace("ELEM(", "element_at(").replace("EACH(", "explode(").replace("LIST(", "array(")


def for_duckdb(sql: str) -> str:
    sql = re.sub(r"UTF8\((\w+)\)", r"encode(\1)", sql)
    sql = sql.replace("EACH(", "unnest(").replace("LIST(", "list_value(")
    return _INPUT.sub(r"\1", sql.replace("ELEM(", "list_extract("))


class Tables:
    """Base tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._loaded: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            self._loaded[name] = self._load(name)
        return self._loaded[name]

    def hold(self, name: str) -> None:
        """Write a windowed view in buckets by its key: views built on it read the written rows.

        Its window then runs once for all of them, and what they group or join by the key
        is not shuffled.  Views that were loaded before keep the window of their own.
        """
        _, key = WINDOWED[name]
        self._loaded[name] = cut_bucketed(self(name), [key], placed=True)

    def keep(self, name: str, keys: DataFrame | None = None) -> None:
        """Write a view, or its rows of the files in ``keys``: what is built on it reads those.

        A whole view is dealt out by file first, as its table may lie in few pieces.  One that cannot be
        written stays as it is, so only what needs its broken rows fails.
        """
        view = self(name)
        rows = view.repartition(shuffle_partitions(self.spark), "file_id") if keys is None else among(view, keys)
        with suppress(Exception):
            self._loaded[name] = cut(rows)

    def _load(self, name: str) -> DataFrame:
        if name in BASE:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table, TEXT_TABLES[name]) if name in TEXT_TABLES else table
        sql = VIEWS[name]
        inputs = {n: self(n) for n in inputs_of(sql)}
        if name in WINDOWED:  # sorted in as many tasks as there are shuffle partitions
            table, key = WINDOWED[name]
            inputs[table] = inputs[table].repartition(shuffle_partitions(self.spark), key)
        return self.spark.sql(for_spark(sql), **inputs)


def needed_views(names: list[str]) -> list[str]:
    """The views behind ``names`` with their inputs first."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in BASE or name in out:
            return
        for other in inputs_of(VIEWS[name]):
            add(other)
        out.append(name)

    for name in names:
        add(name)
    return out


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB query text with the views it names in braces as common tables.

    ``extra`` adds query-local tables, which may name views as well.
    """
    extra = extra or {}
    names = [n for text in [*extra.values(), sql] for n in inputs_of(text) if n not in extra]
    tables = [(n, VIEWS[n]) for n in needed_views(names)] + list(extra.items())
    if not tables:
        return for_duckdb(sql)
    body = ",\n".join(f"{n} AS ({for_duckdb(text)})" for n, text in tables)
    return f"WITH RECURSIVE {body}\n{for_duckdb(sql)}"
