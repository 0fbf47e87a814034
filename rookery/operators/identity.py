"""Semantic identity of units: slot id, implementation fingerprint and public shape, as column expressions.

Ids are ``v1:`` and the SHA-1 of the fields in a fixed order, nulls marked. Lists enter as sorted sets without blanks. Only
which units share an id has a meaning, not its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.plans.views import UNITS_SQL, all_units

VERSION = "v1"
#: Languages by file ending (fixed values).
LANGUAGE_BY_ENDING = {"clj": "clojure", "cljc": "clojure", "cljs": "clojure", "java": "java", "ex": "elixir", "exs": "elixir", "py": "python", "ts": "typescript", "tsx": "typescript", "lua": "lua"}


def language_by_path(path: Column) -> Column:
    """Language of a path by its ending, else null."""
    ending = F.regexp_extract(path, r"\.(\w+)$", 1)
    c = F.when(F.lit(False), F.lit(""))
    for e, lang in LANGUAGE_BY_ENDING.items():
        c = c.when(ending == e, F.lit(lang))
    return c


def local_name(symbol: Column) -> Column:
    """What follows the last ``/`` or ``#``."""
    return F.regexp_replace(symbol, r"^.*[/#]", "")


def owner(module: Column, symbol: Column) -> Column:
    """The module, else the symbol's part before its first ``/`` or else ``#``."""
    return F.coalesce(module, F.when(F.contains(symbol, F.lit("/")), F.substring_index(symbol, "/", 1)).when(F.contains(symbol, F.lit("#")), F.substring_index(symbol, "#", 1)))


def tail(token: Column) -> Column:
    """What follows the last ``.``, ``/`` or ``#``."""
    return F.regexp_replace(token, r"^.*[./#]", "")


def _hash(*parts: Column) -> Column:
    return F.concat(F.lit(VERSION + ":"), F.sha1(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])))


def _set(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(c, lambda x: F.trim(x) != ""))), ",")


def with_identity(units: DataFrame) -> DataFrame:
    """``units`` with language filled in, semantic_id, fingerprint and public_shape."""
    c = F.col
    lang = F.coalesce(c("language"), language_by_path(c("path")), F.lit("unknown"))
    anchor = F.when(F.coalesce(c("symbol"), F.lit("")) == "", F.concat_ws("|", "path", c("start_line").cast("string"), c("end_line").cast("string")))
    return units.withColumns(
        {
            "semantic_id": _hash(lang, c("kind"), owner(c("module"), c("symbol")), c("symbol"), local_name(c("symbol")), c("method_arity"), anchor),
            "fingerprint": _hash(lang, c("kind"), c("method_arity"), _set(c("calls")), _set(c("imports"))),
            "public_shape": _hash(lang, c("kind"), c("method_arity"), c("signature")),
        }
    )


_LANG = "coalesce(language, case regexp_extract(path, '\\.(\\w+)$', 1) " + " ".join(f"when '{e}' then '{v}'" for e, v in LANGUAGE_BY_ENDING.items()) + " end, 'unknown')"
_H = lambda *p: "'v1:' || sha1(concat_ws(chr(31), " + ", ".join(f"coalesce(({x})::varchar, '~')" for x in p) + "))"
_S = lambda c: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({c}, lambda x: trim(x) <> ''))), ','), '')"
_OWNER = "coalesce(module, case when contains(symbol, '/') then split_part(symbol, '/', 1) when contains(symbol, '#') then split_part(symbol, '#', 1) end)"
IDENTITY_SQL = (
    UNITS_SQL
    + f""", ids as (select *, {_H(_LANG, 'kind', _OWNER, 'symbol', "regexp_replace(symbol, '^.*[/#]', '')", 'method_arity', "case when coalesce(symbol, '') = '' then concat_ws('|', path, start_line, end_line) end")} as semantic_id,
    {_H(_LANG, 'kind', 'method_arity', _S('calls'), _S('imports'))} as fingerprint, {_H(_LANG, 'kind', 'method_arity', 'signature')} as public_shape from allu)
"""
)


def identities(spark, d: str) -> DataFrame:
    return with_identity(all_units(spark, d)).select("root", "snapshot_id", "unit_id", "semantic_id", "fingerprint", "public_shape")


def symbol_parts(spark, d: str) -> DataFrame:
    x = all_units(spark, d).select("symbol", "module").distinct()
    return x.select("symbol", "module", owner(F.col("module"), F.col("symbol")).alias("owner"), local_name(F.col("symbol")).alias("local_name"), tail(F.col("symbol")).alias("tail"))


def root_hashes(spark, d: str) -> DataFrame:
    return all_units(spark, d).select("root", F.sha2("root", 256).alias("root_path_hash")).distinct()


QUERIES = {"sid_01_identity": identities, "sid_06_symbol_parts": symbol_parts, "sid_07_root_hash": root_hashes}
SQL = {
    "sid_01_identity": IDENTITY_SQL + "select root, snapshot_id, unit_id, semantic_id, fingerprint, public_shape from ids",
    "sid_06_symbol_parts": UNITS_SQL + f"select distinct symbol, module, {_OWNER} as owner, regexp_replace(symbol, '^.*[/#]', '') as local_name, regexp_replace(symbol, '^.*[./#]', '') as tail from allu",
    "sid_07_root_hash": UNITS_SQL + "select distinct root, sha256(root) as root_path_hash from allu",
}
