"""String, signature, script, document and report rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracefold import rules
from tracefold.functions.bytes import byte_entropy, latin1, running_starts
from tracefold.functions.literals import (contains_any, contains_any_bytes, first_match, let,
                                          present, raw)
from tracefold.operators.ordering import running_counts
from tracefold.session import cut


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# --- strings ----------------------------------------------------------------------

def string_runs(content: Column, min_length: int = rules.MIN_STRING) -> tuple[Column, Column]:
    """ASCII runs and UTF-16LE runs (any alignment) of a binary column."""
    text = latin1(content)
    ascii_runs = all_matches(text, f"[ -~]{{{min_length},}}")
    wide_runs = F.transform(all_matches(text, f"(?:[ -~]\\x00){{{min_length},}}"),
                            lambda s: F.replace(s, F.lit("\0"), F.lit("")))
    return ascii_runs, wide_runs


def extract_strings(files: DataFrame, min_length: int = rules.MIN_STRING) -> DataFrame:
    """Strings in order, ASCII before UTF-16LE; duplicates are kept."""
    return files.select("file_id", F.posexplode(
        F.concat(*string_runs(F.col("content"), min_length))).alias("pos", "s"))


def extract_strings_distinct(files: DataFrame,
                             min_length: int = rules.MIN_STRING) -> DataFrame:
    """Distinct strings; UTF-16LE runs count at even offsets only.

    ``\\G`` keeps every match attempt on a two-byte boundary.
    """
    ascii_runs, _ = string_runs(F.col("content"), min_length)
    aligned = f"(?s)\\G(?:..)*?((?:[ -~]\\x00){{{min_length},}})"
    wide_runs = F.transform(all_matches(latin1(F.col("content")), aligned, 1),
                            lambda s: F.replace(s, F.lit("\0"), F.lit("")))
    # Duplicates are within one file, so they go before any row is made.
    return files.select("file_id", F.explode(
        F.array_distinct(F.concat(ascii_runs, wide_runs))).alias("s"))


def string_categories(s: Column, low: Column) -> Column:
    """Categories of one trimmed string, given with its lower-case form.

    A plain search for a character that every match holds comes before the
    costlier patterns.
    """
    with_mark = lambda mark, pattern: F.contains(s, F.lit(mark)) & s.rlike(pattern)
    url = with_mark("://", rules.RE_URL)
    tests = [
        ("urls", url),
        ("ip_addresses", ~url & s.rlike("[0-9][.][0-9]") & s.rlike(rules.RE_IP)),
        ("file_paths", with_mark("\\", rules.RE_PATH)),
        ("registry_keys", with_mark("\\", rules.RE_REGISTRY)),
        ("emails", with_mark("@", rules.RE_EMAIL)),
        ("persistence_indicators", contains_any(low, rules.PERSISTENCE_WORDS)),
        ("ransomware_indicators", contains_any(low, rules.RANSOMWARE_WORDS)),
        ("commands", contains_any(low, rules.COMMAND_WORDS)),
        ("base64_blobs", s.rlike(rules.RE_BASE64)
         & (F.length(s) >= rules.BASE64_MIN_LENGTH)),
    ]
    return present([F.when(test, F.lit(name)) for name, test in tests])


def string_facts(content: Column) -> Column:
    """Categories of the distinct trimmed strings of one content, one entry per string and category."""
    runs = F.array_distinct(F.transform(F.concat(*string_runs(content)), trimmed))
    return F.flatten(F.transform(F.filter(runs, lambda s: s != ""),
                                 lambda s: string_categories(s, F.lower(s))))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def categorize_strings(strings: DataFrame) -> DataFrame:
    """Distinct (file, category, string) rows.

    Rules run on every row before the distinct: only strings with a category go
    into the shuffle.
    """
    categories = string_categories(F.col("s"), F.col("_low"))
    return (strings.select("file_id", trimmed(F.col("s")).alias("s"))
            .where(F.col("s") != "")
            .withColumn("_low", F.lower("s"))
            .select("file_id", "s", F.explode(categories).alias("category"))
            .distinct())


def rank_categories(categorized: DataFrame) -> DataFrame:
    """Every string with its place in the sorted category of its file."""
    order = W.partitionBy("file_id", "category").orderBy("s")
    return categorized.withColumn("rank", F.row_number().over(order))


# --- signatures ---------------------------------------------------------------------

def signature_hits(content: Column) -> Column:
    """Families whose byte patterns occur in the content, as an array of structs."""
    families: dict[str, list[str]] = {}
    for family, pattern in rules.BYTE_SIGNATURES:
        families.setdefault(family, []).append(pattern)

    def shown(pattern: str) -> str:
        data = bytes.fromhex(pattern)
        return (data.hex() if len(data) > 5 and b"\0" in data
                else data.decode("ascii", errors="replace"))

    entries = []
    for family, patterns in families.items():
        first = first_match([(F.contains(content, raw(p)), F.lit(shown(p)))
                             for p in patterns])
        kind = ("shellcode" if any(part in family for part in rules.SHELLCODE_NAME_PARTS)
                else "family")
        entries.append(F.when(first.isNotNull(), F.struct(
            F.lit(family).alias("name"), first.alias("pattern_matched"),
            F.lit(kind).alias("kind"))))
    return present(entries)


def scan_signatures(files: DataFrame) -> DataFrame:
    """Families whose byte patterns occur in the content; first pattern reported."""
    return (files.select("file_id", F.explode(signature_hits(F.col("content"))).alias("_s"))
            .select("file_id", "_s.*"))


def scan_rules(files: DataFrame) -> DataFrame:
    """Rules with enough distinct string hits, or with their override string."""
    text, low = latin1(F.col("content")), F.lower(latin1(F.col("content")))

    def hit(kind: str, value: str) -> Column:
        if kind == "hex":
            return F.contains(F.col("content"), raw(value))
        return F.contains(low if kind == "nocase" else text, F.lit(value))

    entries = []
    for rule, needed, override, strings in rules.TEXT_RULES:
        hits = {name: hit(*spec) for name, spec in strings.items()}
        count = sum((h.cast("int") for h in hits.values()), F.lit(0))
        match = count >= needed
        if override:
            match = match | hits[override]
        entries.append(F.when(match, F.struct(F.lit(rule).alias("rule"),
                                              count.alias("string_hits"))))
    return (files.select("file_id", F.explode(present(entries)).alias("_r"))
            .select("file_id", "_r.*"))


# --- scripts --------------------------------------------------------------------------

def obfuscation_flags(scripts: DataFrame) -> DataFrame:
    code = F.col("code")
    patterns = present([F.when(code.rlike("(?U)(?i)" + p), F.lit(p))
                        for p in rules.OBFUSCATION_PATTERNS])
    return scripts.select("file_id", patterns.alias("patterns"),
                          (F.size(patterns) > 0).alias("eval_usage"),
                          code.rlike(rules.RE_BASE64_RUN).alias("base64_detected"))


def sizes(parts: Column) -> Column:
    return F.transform(parts, lambda part: F.length(part))


def script_functions(scripts: DataFrame) -> DataFrame:
    """``__main__`` first, then the functions of each script in order."""
    code, lang = F.col("code"), F.col("lang")
    empty = F.array().cast("array<string>")
    names = first_match([(lang == k, all_matches(code, p, 1))
                         for k, p in rules.SCRIPT_FUNCTION_PATTERNS.items()], empty)
    return scripts.select("file_id", F.posexplode(
        F.concat(F.array(F.lit("__main__")), names)).alias("pos", "func"))


def by_language(patterns: dict[str, str], make, kind: str = "array<int>") -> Column:
    """``make`` of the pattern of the row's language; an empty list for other languages."""
    return first_match([(F.col("lang") == lang, make(pattern)) for lang, pattern in patterns.items()],
                       F.array().cast(kind))


def placed_matches(names: Column, gaps: Column, found: Column) -> Column:
    """(name, address): matches with their character offsets, in time linear in the text.

    Splitting on a pattern gives the gaps and extracting the matches; the lengths of both,
    which the JVM finds, are added up in one pass.
    """
    return F.arrays_zip(names.alias("name"), running_starts(gaps, found).alias("address"))


def script_function_offsets(scripts: DataFrame) -> DataFrame:
    """Character offset of every function (``__main__`` is at 0)."""
    code, patterns = F.col("code"), rules.SCRIPT_FUNCTION_PATTERNS
    found = placed_matches(by_language(patterns, lambda p: all_matches(code, p, 1), "array<string>"),
                           by_language(patterns, lambda p: sizes(F.split(code, p, -1))),
                           by_language(patterns, lambda p: sizes(all_matches(code, p))))
    main = F.array(F.struct(F.lit("__main__").alias("name"), F.lit(0).cast("bigint").alias("address")))
    return (scripts.select("file_id", F.posexplode(F.concat(main, found)).alias("pos", "_f"))
            .select("file_id", "pos", F.col("_f.name").alias("func"), "_f.address"))


def script_calls(scripts: DataFrame) -> DataFrame:
    """Call names of JavaScript, distinct cmdlets of PowerShell, call lines of batch files.

    ``address`` is the character offset of the call, of the first use of the cmdlet, or of the
    first character of the line that is not blank.
    """
    code, lang = F.col("code"), F.col("lang")
    patterns = {"js": rules.RE_JS_CALL, "ps1": rules.RE_PS_CMDLET}
    batch, lines = lang.isin("bat", "cmd"), F.split(code, "\n", -1)
    either = lambda of_lines, make, kind="array<int>": F.when(batch, of_lines).otherwise(
        by_language(patterns, make, kind))
    found = placed_matches(
        either(lines, lambda p: all_matches(code, p, 1), "array<string>"),
        either(F.transform(lines, lambda _: F.lit(0)), lambda p: sizes(F.split(code, p, -1))),
        either(F.transform(lines, lambda line: F.length(line) + 1), lambda p: sizes(all_matches(code, p))))
    called = F.filter(F.transform("found", lambda e: F.struct(
        trimmed(e["name"]).alias("name"),
        (e["address"] + F.position(trimmed(e["name"]), e["name"]) - 1).alias("address"))),
        lambda e: e["name"].rlike(rules.RE_BATCH_CALL))
    cmdlets = let(F.array_sort("found"), lambda placed: F.filter(
        placed, lambda e, i: (i == 0) | (F.get(placed, i - 1)["name"] != e["name"])))
    calls = F.when(batch, called).when(lang == "ps1", cmdlets).otherwise(F.col("found"))
    return (scripts.select("file_id", "lang", found.alias("found"))
            .select("file_id", F.posexplode(calls).alias("pos", "_f"))
            .select("file_id", "pos", F.col("_f.name").alias("call"), "_f.address"))


def script_imports(scripts: DataFrame) -> DataFrame:
    """Modules of import statements: every one of a list, none for bare dots."""
    code = F.when(F.col("lang") == "py", F.col("code"))
    lists = F.transform(all_matches(code, rules.RE_PY_IMPORT, 1), lambda names: F.transform(
        F.split(names, ","), lambda one: F.regexp_extract(one, rules.RE_PY_MODULE, 1)))
    modules = F.filter(F.flatten(lists), lambda m: m.rlike(r"[^.]"))
    return scripts.select("file_id", F.posexplode(modules).alias("pos", "module"))


def script_literals(scripts: DataFrame) -> DataFrame:
    """String constants of more than three characters."""
    code = F.when(F.col("lang") == "py", F.col("code"))
    quoted = F.transform(all_matches(code, rules.RE_PY_LITERAL, 0),
                         lambda s: F.substr(s, F.lit(2), F.length(s) - 2))
    return scripts.select("file_id", F.posexplode(quoted).alias("pos", "literal"))


# --- documents --------------------------------------------------------------------------

def vba_rules(macros: DataFrame) -> DataFrame:
    """Names, strings, suspicious patterns and auto-run keyword per macro."""
    code = F.col("code")
    return macros.select(
        "file_id", all_matches(code, rules.RE_VBA_NAME, 1).alias("functions"),
        all_matches(code, rules.RE_VBA_STRING, 1).alias("strings"),
        present([F.when(code.rlike(p), F.lit(n)) for n, p in rules.VBA_SUSPICIOUS])
        .alias("suspicious"),
        code.rlike(rules.RE_VBA_AUTO).alias("auto_exec"))


def ooxml_rules(members: DataFrame) -> DataFrame:
    """Macro part or, in documents without one, external links."""
    name, text = F.col("member_path"), F.col("content")
    external = (F.contains(F.lower(name), F.lit("rels"))
                & contains_any(text, ["External", 'Target="http']))
    facts = members.groupBy("container_id").agg(
        F.bool_or(F.contains(name, F.lit("vbaProject.bin"))).alias("has_macros"),
        F.bool_or(external).alias("_external"))
    return facts.select("container_id", "has_macros",
                        (F.col("_external") & ~F.col("has_macros")).alias("external_links"))


def pdf_rules(files: DataFrame) -> DataFrame:
    content = F.col("content")
    mark = lambda text: F.contains(content, raw(text.encode().hex()))
    return files.select(
        "file_id",
        contains_any_bytes(content, [m.encode().hex() for m in rules.PDF_SCRIPT_MARKS])
        .alias("has_javascript"),
        present([F.when(mark(a), F.lit(a)) for a in rules.PDF_ACTIONS]).alias("suspicious"),
        byte_entropy(content).alias("_entropy")).select(
        "file_id", "has_javascript", "suspicious", F.round("_entropy", 4).alias("entropy"),
        (F.col("_entropy") > rules.PDF_HIGH_ENTROPY).alias("high_entropy"))


def rtf_rules(files: DataFrame) -> DataFrame:
    text = latin1(F.col("content"))
    return files.select(
        "file_id",
        (F.contains(text, F.lit("\\object")) | F.contains(F.lower(text), F.lit("objdata")))
        .alias("has_ole"),
        contains_any(text, ["Equation.", "0002CE02"]).alias("equation_editor"))


def shortcut_rules(shortcuts: DataFrame) -> DataFrame:
    """Suspicious argument descriptions and the called target of a shortcut."""
    args = F.coalesce("arguments", F.lit(""))
    base = F.element_at(F.split(F.regexp_replace("target", "/+$", ""), "/"), -1)
    return shortcuts.select(
        "file_id", F.when(F.coalesce("target", F.lit("")) != "", base).alias("call"),
        present([F.when(args.rlike("(?U)(?i)" + p), F.lit(d))
                 for p, d in rules.SHORTCUT_PATTERNS]).alias("suspicious"))


def ini_shortcut_parse(files: DataFrame) -> DataFrame:
    """First ``url=`` line, last ``exec=`` and ``type=`` lines of a text."""
    lines = F.split("text", "\n")
    starting = lambda key: F.filter(
        lines, lambda s: F.startswith(F.lower(s), F.lit(f"{key}=")))
    value = lambda s: trimmed(F.substr(s, F.instr(s, "=") + 1))
    return files.select(
        "file_id", value(F.try_element_at(starting("url"), F.lit(1))).alias("url"),
        value(F.try_element_at(starting("exec"), F.lit(-1))).alias("exec"),
        value(F.try_element_at(starting("type"), F.lit(-1))).alias("type"))


def url_domain(url: Column) -> Column:
    """Text between the first ``//`` and the next ``/``; null without ``//``."""
    rest = F.try_element_at(F.split(url, "//"), F.lit(2))
    return F.element_at(F.split(rest, "/"), 1)


# --- reports ------------------------------------------------------------------------------

def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, "(?U)" + pattern, 1), F.lit("")).cast("double")


def verdict_parse(reports: DataFrame) -> DataFrame:
    """Verdict, risk and confidence from report text.

    ``kind`` is ``pe`` or ``script``; only the first falls back to the text of
    the comparator.  Numbers in the text override the defaults.
    """
    report = F.upper("report_markdown")
    other = F.upper(F.coalesce("comparator_text", F.lit("")))
    says = lambda text, v: contains_any(text, [f"VERDICT: {v}", f"VERDICT**: {v}"])
    result = lambda v, risk, conf: F.struct(
        F.lit(v).alias("verdict"), F.lit(risk).alias("risk"), F.lit(conf).alias("conf"))
    bad, good = result("MALWARE", 75.0, 85.0), result("BENIGN", 20.0, 90.0)
    only_benign = (F.contains(other, F.lit("BENIGN")) & ~F.contains(other, F.lit("MALWARE")))
    pe = first_match([(says(report, "MALWARE"), bad), (says(report, "BENIGN"), good),
                      (says(other, "BENIGN"), good), (says(other, "MALWARE"), bad),
                      (only_benign, good)], bad)
    script = first_match([
        (says(report, "MALWARE"), bad),
        (says(report, "BENIGN"), result("BENIGN", 15.0, 90.0)),
        (F.contains(report, F.lit("MALWARE")),
         result("MALWARE", 70.0, 80.0))], result("BENIGN", 20.0, 80.0))
    is_pe = F.col("kind") == "pe"
    text = F.when(is_pe, F.concat(other, F.lit("\n"), report)).otherwise(report)
    parsed = F.when(is_pe, pe).otherwise(script)
    return (reports.withColumn("_p", parsed).withColumn("_text", text)
            .select("analysis_id", "kind", "_p.verdict",
                    F.coalesce(_number(F.col("_text"), rules.RE_RISK), "_p.risk")
                    .alias("risk_score"),
                    F.coalesce(_number(F.col("_text"), rules.RE_CONFIDENCE), "_p.conf")
                    .alias("confidence")))


def report_tables(reports: DataFrame) -> DataFrame:
    """Cells of the tables in a report, with header and data rows told apart.

    A table is a stretch of lines that begin with a pipe; lines holding ``---`` are dividers, and
    a table that starts with one has no header.  Only lines of tables go on, one row each; tables
    and rows are numbered by running counts in two levels, so a long report is no single fold.
    """
    piped = lambda line: F.startswith(trimmed(line), F.lit("|"))
    lines = (reports.where(F.contains("report_markdown", F.lit("|")))
             .select(F.monotonically_increasing_id().alias("report"), "analysis_id",
                     F.split("report_markdown", "\n").alias("lines"))
             .select("report", "analysis_id", F.posexplode(F.arrays_zip(
                 F.col("lines").alias("line"),
                 F.concat(F.array(F.lit("")), F.col("lines")).alias("before"))).alias("i", "l"))
             .select("report", "analysis_id", "i", "l.line", piped(F.col("l.before")).alias("inside"))
             .where(F.col("line").isNotNull() & piped(F.col("line"))))
    shown = ~F.contains("line", F.lit("---"))
    rows = running_counts(cut(lines), ["report"], "i", {"row_pos": shown, "opened": ~F.col("inside")}).where(shown)
    parts = F.split("line", r"\|", -1)
    cells = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(
        F.array().cast("array<string>"))
    return rows.select(
        "analysis_id", F.col("row_pos").cast("int").alias("row_pos"),
        (F.col("opened") + F.when(F.col("inside"), 0).otherwise(1)).cast("int").alias("table_id"),
        F.when(F.col("inside"), "data").otherwise("header").alias("row_kind"),
        F.posexplode(cells).alias("cell_pos", "cell"))
