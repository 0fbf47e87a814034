"""Source trees as tables: files, texts, languages and what of them is active."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators.identity import LANGUAGE_BY_ENDING, language_by_path
from rookery.operators.graph import call_edges
from rookery.operators.identity import with_identity
from rookery.sources.extract import extracted, with_use_imports

#: Languages in order, folders that are never read, and files that hint at a language.
LANGUAGES = ("clojure", "java", "elixir", "python", "typescript", "lua")
IGNORED = (".git", "node_modules", ".venv", "venv", "target", "dist", "build")
MANIFESTS = {
    "deps.edn": "clojure", "project.clj": "clojure", "shadow-cljs.edn": "clojure", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java",
    "mix.exs": "elixir", "pyproject.toml": "python", "requirements.txt": "python", "setup.py": "python", "package.json": "typescript", "tsconfig.json": "typescript",
}


def not_ignored(path: Column) -> Column:
    return ~F.exists(F.split(path, "/+"), lambda s: s.isin(*IGNORED))


def tree(spark: SparkSession, root: str, text: bool = True, only: Sequence[str] | None = None) -> DataFrame:
    """path (relative), language and text of all source files below ``root``, or of those among ``only`` that are there; without ``text`` no content is read."""
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile")
    if only is None:
        raw = reader.option("recursiveFileLookup", True).load(base)
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path
        fs = at(base).getFileSystem(spark._jsc.hadoopConfiguration())
        there = [f"{base}/{p}" for p in dict.fromkeys(only) if fs.exists(at(f"{base}/{p}"))]
        raw = reader.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    full = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    rel = F.expr(f"substring(p, {len(base) + 2})") if base.startswith("/") else F.regexp_replace(F.col("p"), "^.*?" + base + "/", "")
    x = raw.withColumn("p", full).withColumn("path", rel).withColumn("language", language_by_path(F.col("path"))).where("language is not null").where(not_ignored(F.col("path")))
    return x.select("path", "language", F.decode("content", "UTF-8").alias("text")) if text else x.select("path", "language")


def language_counts(files: DataFrame) -> DataFrame:
    """Files per language."""
    return files.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


def manifest_hints(paths: DataFrame) -> DataFrame:
    """Manifest files at the top of the tree with their language; ``paths`` has all files, not sources only."""
    language = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    return paths.where(F.col("path").isin(*MANIFESTS)).select("path", language[F.col("path")].alias("language"))


def merged_policy(server: dict | None, request: dict | None) -> dict:
    """Allow lists intersect in fixed order, disable lists unite, prewarm lists unite within what is allowed."""
    tidy = lambda p, k: None if (p or {}).get(k) is None else [x for x in dict.fromkeys(str(v).lower() for v in p[k]) if x in LANGUAGES]
    allows = [a for a in (tidy(server, "allow"), tidy(request, "allow")) if a is not None]
    allow = None if not allows else [x for x in LANGUAGES if all(x in a for a in allows)] if len(allows) == 2 else allows[0]
    both = lambda k: list(dict.fromkeys([*(tidy(server, k) or []), *(tidy(request, k) or [])]))
    return {"allow": allow, "disable": both("disable"), "prewarm": [x for x in both("prewarm") if x in (allow if allow is not None else LANGUAGES)]}


def activation(detected: Sequence[str], policy: dict | None = None) -> dict:
    """Active languages and the state: awaiting_language_selection if nothing is active and nothing was detected."""
    p = merged_policy(policy, None)
    allowed = [x for x in LANGUAGES if p["allow"] is None or x in p["allow"]]
    wanted = [x for x in allowed if x in detected or x in p["prewarm"] or (not detected and p["allow"])]
    active = [x for x in wanted if x not in p["disable"]]
    return {"active": active, "state": "ready" if active or detected else "awaiting_language_selection"}


def indexed(files: DataFrame, key: str = "root", path: str = "path", text: str = "text", language: str = "language") -> tuple[DataFrame, DataFrame]:
    """Units with identity, and call edges, of files keyed by ``key`` (a directory or snapshot)."""
    u = with_use_imports(extracted(files, key, path, text, language), key)
    u = with_identity(u if key == "root" else u.withColumnRenamed(key, "root"))
    return u, call_edges(u)


def fallback_files(spark, d: str) -> DataFrame:
    """The files of degraded packets, one row per directory and path."""
    from rookery.functions.text import root_path
    from rookery.sources.tables import table

    f = table(spark, d, "degraded_fallback").where("raw_context is not null")
    p = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./)+", "")
    x = f.select(root_path("root_path").alias("root"), p.alias("path"), F.coalesce("language", language_by_path(p)).alias("language"), F.col("raw_context").alias("text"), "fallback_id")
    return x.groupBy("root", "path").agg(F.max_by(F.struct("language", "text"), "fallback_id").alias("v")).select("root", "path", "v.*")


def _extracted_units(spark, d: str) -> DataFrame:
    return extracted(fallback_files(spark, d), "root").select("root", "unit_id", "kind", "symbol", "module", "language", "start_line", "end_line", F.size("calls").alias("n_calls"))


def _python_defs(spark, d: str) -> DataFrame:
    f = fallback_files(spark, d).where("language = 'python'")
    return extracted(f, "root").where("kind <> 'class' and kind <> 'section' and class_name is null").select("root", "path", F.regexp_replace("symbol", "^.*/", "").alias("name"), "start_line")


def _definitions(language: str):
    """Path and first line of each definition of one language's files, classes and fallback sections left out."""

    def run(spark, d: str) -> DataFrame:
        f = fallback_files(spark, d).where(F.col("language") == language)
        return extracted(f, "root").where("kind <> 'section' or form_operator = 'def'").where("kind <> 'class'").select("root", "path", "start_line").distinct()

    return run


def _imports(language: str):
    """(root, path, imported): what the files of a language import, by their units."""

    def run(spark, d: str) -> DataFrame:
        f = fallback_files(spark, d).where(F.col("language") == language)
        return extracted(f, "root").where("parser_mode = 'full' or language = 'clojure'").select("root", "path", F.explode("imports").alias("imported")).distinct()

    return run


def _bare_calls(language: str):
    """(root, path, call): what the units of a language's files call, by the last part of each name."""

    def run(spark, d: str) -> DataFrame:
        f = fallback_files(spark, d).where(F.col("language") == language)
        x = extracted(f, "root").where("parser_mode = 'full'").select("root", "path", F.explode("calls").alias("call"))
        return x.where(~F.col("call").rlike("[./#]")).distinct()

    return run


def _java_methods(spark, d: str) -> DataFrame:
    """Signature keys and arities of Java methods and constructors, as read from their parameter lists."""
    f = fallback_files(spark, d).where("language = 'java'")
    return extracted(f, "root").where("method_signature_key is not null").select("root", "path", "start_line", "method_arity", "method_signature_key")


def _line_sql(language: str, words: str, where: str) -> str:
    """Lines of one language that define something: ``words`` names parts of the trimmed line t, ``where`` is the rule over them."""
    return _LINES.format(language=language) + f", w as (select *, {words} from l) select distinct root, path, start_line from w where {where}"


def _extracted_edges(spark, d: str) -> DataFrame:
    from rookery.sources.tables import written

    u = written(with_identity(with_use_imports(extracted(fallback_files(spark, d), "root"), "root")), "extracted")
    return call_edges(u)


_FILES = r"""with f as (select regexp_replace(regexp_replace(root_path, '/(\./|/)+', '/', 'g'), '/+$', '') as root, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') as path, language, raw_context as text, fallback_id from degraded_fallback where raw_context is not null),
g as (select root, path, arg_max(text, fallback_id) as text, arg_max(coalesce(language, case regexp_extract(path, '\.(\w+)$', 1) """ + " ".join(f"when '{e}' then '{v}'" for e, v in LANGUAGE_BY_ENDING.items()) + " end, ''), fallback_id) as language from f group by root, path)\n"
_LINES = (
    _FILES
    + r""", l as (select *, trim(line) as t from (select root, path, unnest(string_split_regex(ltrim(text, chr(65279)), '\r?\n')) as line, generate_subscripts(string_split_regex(ltrim(text, chr(65279)), '\r?\n'), 1)::int as start_line from g where language = '{language}'))"""
)
QUERIES = {
    "ext_01_units": _extracted_units,
    "ext_04_edges": _extracted_edges,
    "ext_17_python_functions": _python_defs,
    "ext_04_clojure": _definitions("clojure"),
    "ext_12_java": _definitions("java"),
    "ext_21_lua": _definitions("lua"),
    "ext_24_typescript": _definitions("typescript"),
    "ext_28_elixir": _definitions("elixir"),
    "ext_13_java_imports": _imports("java"),
    "ext_14_java_arities": _java_methods,
    "ext_18_python_imports": _imports("python"),
    "ext_19_python_calls": _bare_calls("python"),
    "ext_15_java_calls": _bare_calls("java"),
    "agg_26_language_counts": lambda s, d: language_counts(fallback_files(s, d)),
    "src_01_not_ignored": lambda s, d: fallback_files(s, d).where(not_ignored(F.col("path"))).select("root", "path"),
}
SQL = {
    "ext_04_clojure": _line_sql("clojure", "string_split_regex(line, '[ ]+') as w", "w[1] in ('(def', '(defn', '(defn-', '(defmacro', '(defmulti', '(defmethod', '(defprotocol', '(deftest') and w[2] <> '' and left(w[2], 1) not in ('[', ']', ')')"),
    "ext_12_java": _line_sql(
        "java", "trim(split_part(t, '(', 1)) as head, ltrim(split_part(t, ')', 2)) as rest",
        r"contains(t, '(') and len(string_split_regex(head, '\s+')) >= 2 and not regexp_matches(head, '[=(){};\"@/*:]') and not list_contains(['return', 'new', 'throw', 'if', 'for', 'while', 'switch', 'catch'], lower(split_part(head, ' ', 1))) and regexp_matches(rest, '^(\{|;|throws)')",
    ),
    "ext_14_java_arities": _line_sql(
        "java", "trim(split_part(t, '(', 1)) as head, ltrim(split_part(t, ')', 2)) as rest, regexp_replace(split_part(split_part(t, '(', 2), ')', 1), '\\s+', '', 'g') as ps",
        r"contains(t, '(') and len(string_split_regex(head, '\s+')) >= 2 and not regexp_matches(head, '[=(){};\"@/*:]') and not list_contains(['return', 'new', 'throw', 'if', 'for', 'while', 'switch', 'catch'], lower(split_part(head, ' ', 1))) and regexp_matches(rest, '^(\{|;|throws)')",
    ).replace("select distinct root, path, start_line from w", "select root, path, start_line, (case when ps = '' then 0 else len(string_split(ps, ',')) end)::int as method_arity, ps as method_signature_key from w"),
    "ext_19_python_calls": _LINES.format(language="python")
    + r""", fd as (select *, min(start_line) filter (regexp_matches(t, '^(async\s+def|def|class)\s')) over (partition by root, path) as first from l), i as (select root, path, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_.]*)\s*\(', 1)) as token from fd where start_line >= first),
    c as (select distinct root, path, list_last(string_split(token, '.')) as call from i) select root, path, call from c where call not in ('', 'if', 'for', 'while', 'return', 'yield', 'lambda', 'class', 'def', 'print')""",
    "ext_18_python_imports": _LINES.format(language="python")
    + r", u as (select distinct root, path from l where regexp_matches(t, '^(async\s+def|def|class)\s')), i as (select root, path, split_part(regexp_replace(t, '^(import|from)\s+', ''), ' ', 1) as imported from l where regexp_matches(t, '^import\s+[A-Za-z_]') or regexp_matches(t, '^from\s+[A-Za-z_.]+\s+import\s+[A-Za-z_*]')) select distinct root, path, imported from i join u using (root, path)",
    "ext_21_lua": _line_sql(
        "lua", "regexp_replace(line, '^local ', '') as r",
        r"case when starts_with(r, 'function ') then regexp_matches(split_part(substr(r, 10), '(', 1), '^\w+([.:]\w+)?\s*$') and contains(r, '(') else regexp_matches(split_part(r, '=', 1), '^\w+(\.\w+)?\s*$') and regexp_matches(ltrim(split_part(r, '=', 2)), '^function\s*\(') end",
    ),
    "ext_24_typescript": _line_sql(
        "typescript", "regexp_replace(regexp_replace(regexp_replace(t, '^export ', ''), '^default ', ''), '^async ', '') as r, split_part(t, '(', 1) as head",
        r"(starts_with(r, 'function ') and contains(r, '(')) or (starts_with(line, '  ') and not starts_with(line, '   ') and ends_with(t, '{') and contains(t, '(') and regexp_matches(head, '^\w+$') and head not in ('if', 'for', 'while', 'switch', 'catch', 'return', 'function', 'constructor'))",
    ),
    "ext_28_elixir": _line_sql("elixir", r"string_split_regex(t, '[\s(]+') as w", r"w[1] in ('def', 'defp', 'defmacro', 'defmacrop', 'defdelegate') and regexp_matches(coalesce(w[2], ''), '^[a-zA-Z_]')"),
    "agg_26_language_counts": _FILES + "select language, count(*) as n_files from g where language <> '' group by language",
    "src_01_not_ignored": _FILES + f"select root, path from g where not list_has_any(string_split_regex(path, '/+'), [{', '.join(repr(x) for x in IGNORED)}])",
    "ext_17_python_functions": _LINES.format(language="python")
    + ", r as (select *, regexp_replace(line, '^async +', '') as r from l) select root, path, trim(split_part(substr(r, 5), '(', 1)) as name, start_line from r where starts_with(r, 'def ') and contains(r, '(')",
}
SQL["ext_13_java_imports"] = (
    "select distinct i.root, i.path, i.imported from (" + _LINES.format(language="java") + r" select root, path, trim(replace(replace(regexp_replace(t, '^import\s+', ''), 'static ', ''), ';', '')) as imported from l where regexp_matches(t, '^import\s')) i join (" + SQL["ext_12_java"] + ") u using (root, path)"
)
SQL["ext_15_java_calls"] = (
    _LINES.format(language="java")
    + ", jd as (" + SQL["ext_12_java"] + ")"
    + r""", jm as (select l.*, jd.start_line is not null as def, min(jd.start_line) over (partition by l.root, l.path) as first from l left join jd on jd.root = l.root and jd.path = l.path and jd.start_line = l.start_line),
    jt as (select root, path, regexp_replace(case when not def then line when contains(line, '{') then substr(line, instr(line, '{') + 1) else '' end, '"[^"]*"', '""', 'g') as body from jm where start_line >= first),
    jc as (select root, path, unnest(regexp_extract_all(body, '([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\(', 1)) as token from jt)
    select distinct root, path, list_last(string_split(regexp_replace(token, '\s', '', 'g'), '.')) as call from jc where list_last(string_split(regexp_replace(token, '\s', '', 'g'), '.')) not in ('if', 'for', 'while', 'switch', 'catch', 'return', 'throw', 'new', 'super', 'this', 'synchronized')"""
)
