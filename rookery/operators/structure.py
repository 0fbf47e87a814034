"""Outlines of a code base: fingerprint, categories, dependency edges, top symbols, anchors in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.operators.retrieval import lexical_tokens
from rookery.plans.views import UNITS_SQL, linked_units, files
from rookery.sources.tables import table

TOP_SYMBOLS, ANCHORS = 12, 8
#: Categories by what a lower-case path or module holds, in order (fixed values).
CATEGORIES = (("api", ("/api/",), (".api.",)), ("service", ("/service/",), (".service.",)), ("domain", ("/domain/",), (".domain.",)), ("db", ("/db/", "/repo/"), (".db.",)), ("infra", ("/infra/",), (".infra.",)), ("util", ("/util/",), (".util.",)))
#: Anchors in free text (fixed values).
QUALIFIED = r"[A-Za-z][A-Za-z0-9_.-]*/[A-Za-z][A-Za-z0-9_?!*\-]*"
DOTTED = r"[A-Za-z][A-Za-z0-9_-]*(?:\.[A-Za-z][A-Za-z0-9_-]*)+"
PATHS = r"(?:src|test|lib|app|scripts|fixtures)/[A-Za-z0-9_./-]+"
SYMBOLISH = r"[A-Za-z][A-Za-z0-9_/-]*[_-][A-Za-z0-9_?!*\-]+"


def category(path: Column, module: Column) -> Column:
    """test, api, service, domain, db, infra, util, app/core or other."""
    p, m = F.lower(path), F.lower(F.coalesce(module, F.lit("")))
    c = F.when(F.contains(p, F.lit("/test/")) | F.startswith(p, F.lit("test/")) | F.endswith(p, F.lit("_test.clj")) | F.endswith(m, F.lit("-test")), "test")
    for name, in_path, in_module in CATEGORIES:
        hit = F.lit(False)
        for x in in_path:
            hit = hit | F.contains(p, F.lit(x))
        for x in in_module:
            hit = hit | F.contains(m, F.lit(x))
        c = c.when(hit, name)
    return c.when(F.endswith(m, F.lit(".core")) | F.contains(p, F.lit("/core.clj")) | F.contains(p, F.lit("/main.clj")), "app/core").otherwise("other")


def namespaces(units: DataFrame) -> DataFrame:
    f = files(units).where("module is not null")
    return f.select("root", "path", "module", category(F.col("path"), F.col("module")).alias("category"), F.size("imports").alias("n_requires"))


def dependency_edges(units: DataFrame) -> DataFrame:
    return files(units).where("module is not null").select("root", F.col("module").alias("from"), F.explode("imports").alias("to")).distinct()


def top_symbols(units: DataFrame) -> DataFrame:
    """The first 12 distinct symbols of each module."""
    one = units.where("module is not null and symbol is not null").groupBy("root", "module", "symbol", "kind").agg(F.min("start_line").alias("start_line"))
    w = Window.partitionBy("root", "module").orderBy("start_line", "symbol", "kind")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TOP_SYMBOLS)


def fingerprint(rows: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """SHA-1 of a sum over the files' hashes: order does not matter and a group of any size costs two numbers per task."""
    h = F.md5(F.concat_ws("\n", path, content))
    part = lambda a: F.sum(F.conv(F.substring(h, a, 14), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(key).agg(F.sha1(F.concat_ws(",", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(15).cast("string"))).alias("fingerprint"))


def anchors(text: Column) -> list[Column]:
    """symbols, modules, paths and suspected symbols named in a text, at most 8 each, in their order."""
    found = lambda rx: F.regexp_extract_all(text, F.lit(f"({rx})"))
    first = lambda a: F.slice(F.array_distinct(a), 1, ANCHORS)
    symbols = first(found(QUALIFIED))
    tidy = F.transform(found(SYMBOLISH), lambda s: F.replace(F.lower(F.trim(s)), F.lit("_"), F.lit("-")))
    return [symbols.alias("symbols"), first(F.concat(F.transform(symbols, lambda s: F.substring_index(s, "/", 1)), found(DOTTED))).alias("modules"), first(found(PATHS)).alias("paths"), first(F.concat(symbols, tidy)).alias("suspected")]


def _joined(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def repo_map(units: DataFrame, limit: int = 20) -> DataFrame:
    """First paths and modules of each directory, and counts; no list ever holds more than ``limit`` entries."""

    def firsts(column: str, name: str) -> DataFrame:
        one = units.where(F.col(column).isNotNull()).select("root", column).distinct()
        w = Window.partitionBy("root").orderBy(column)
        some = one.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
        return some.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(name))

    counts = units.groupBy("root").agg(F.countDistinct("path").alias("n_files"), F.count(F.lit(1)).alias("n_units"))
    x = counts.join(firsts("path", "paths"), "root", "left").join(firsts("module", "modules"), "root", "left")
    return x.select("root", "n_files", "n_units", F.coalesce("paths", F.lit("")).alias("paths"), F.coalesce("modules", F.lit("")).alias("modules"))


QUERIES = {
    "agg_27_fingerprint": lambda s, d: fingerprint(table(s, d, "degraded_fallback").withColumn("raw_context", F.coalesce("raw_context", F.lit(""))), "root_path", "path", "raw_context"),
    "agg_28_namespaces": lambda s, d: namespaces(linked_units(s, d)),
    "agg_29_dependency_edges": lambda s, d: dependency_edges(linked_units(s, d)),
    "agg_29_top_symbols": lambda s, d: top_symbols(linked_units(s, d)).select("root", "module", "symbol", "place"),
    "prj_04_repo_map": lambda s, d: repo_map(linked_units(s, d)),
    "scr_03_lexical_tokens": lambda s, d: table(s, d, "eval_items").select("item_id", F.array_join(lexical_tokens(F.col("item_text")), " ").alias("tokens")),
    "scr_18_anchors": lambda s, d: _joined(table(s, d, "eval_items").select("item_id", *anchors(F.col("item_text")))),
}
_FLS = UNITS_SQL + ", fl as (select root, path, min(module) as module, list_sort(list_distinct(flatten(list(imports)))) as imports from cur group by root, path)"
_D = lambda a: f"(list_transform(list_filter([{{'x': x, 'i': i}} for x, i in {a}], lambda w: list_position({a}, w.x) = w.i), lambda w: w.x))"
_EXA = lambda rx: f"regexp_extract_all(item_text, '{rx}')"
_CAT = "case when contains(lower(path), '/test/') or starts_with(lower(path), 'test/') or ends_with(lower(path), '_test.clj') or ends_with(lower(module), '-test') then 'test' " + " ".join(
    "when " + " or ".join([f"contains(lower(path), '{x}')" for x in ps] + [f"contains(lower(module), '{x}')" for x in ms]) + f" then '{n}'" for n, ps, ms in CATEGORIES
) + " when ends_with(lower(module), '.core') or contains(lower(path), '/core.clj') or contains(lower(path), '/main.clj') then 'app/core' else 'other' end"
SQL = {
    "agg_27_fingerprint": "with h as (select root_path, md5(concat_ws(chr(10), path, coalesce(raw_context, ''))) as h from degraded_fallback), p as (select root_path, ('0x' || h[1:14])::bigint as a, ('0x' || h[15:28])::bigint as b from h) select root_path, sha1(concat_ws(',', count(*), sum(a), sum(b))) as fingerprint from p group by root_path",
    "agg_28_namespaces": _FLS + f" select root, path, module, {_CAT} as category, len(imports)::int as n_requires from fl where module is not null",
    "agg_29_dependency_edges": _FLS + ' select distinct root, module as "from", unnest(imports) as "to" from fl where module is not null',
    "agg_29_top_symbols": UNITS_SQL + ", o as (select root, module, symbol, kind, min(start_line) as start_line from cur where module is not null and symbol is not null group by all) select root, module, symbol, row_number() over (partition by root, module order by start_line, symbol, kind)::int as place from o qualify place <= 12",
    "prj_04_repo_map": UNITS_SQL + " select root, count(distinct path) as n_files, count(*) as n_units, array_to_string(list_sort(list_distinct(list(path)))[1:20], ',') as paths, array_to_string(list_sort(list_distinct(list(module)))[1:20], ',') as modules from cur group by root",
    "scr_03_lexical_tokens": "with t as (select item_id, list_transform(regexp_extract_all(item_text, '[A-Za-z][A-Za-z0-9_\\-]+'), lambda x: lower(x)) as a from eval_items) select item_id, array_to_string(" + _D("a") + "[1:20], ' ') as tokens from t",
    "scr_18_anchors": f"with t as (select item_id, {_EXA(QUALIFIED)} as q, {_EXA(DOTTED)} as m, {_EXA(PATHS)} as p, list_transform({_EXA(SYMBOLISH)}, lambda s: replace(lower(trim(s)), '_', '-')) as z from eval_items), u as (select *, {_D('q')}[1:8] as s, {_D('p')}[1:8] as pp from t), "
    f"v as (select *, list_concat(list_transform(s, lambda x: split_part(x, '/', 1)), m) as mm, list_concat(s, z) as zz from u) select item_id, array_to_string(s, ' ') as symbols, array_to_string({_D('mm')}[1:8], ' ') as modules, array_to_string(pp, ' ') as paths, array_to_string({_D('zz')}[1:8], ' ') as suspected from v",
}
