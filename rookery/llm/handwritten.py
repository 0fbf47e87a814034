"""Source files that nobody wrote by hand: generated, minified, vendored files and data saved as code.

Every file is judged alone and whole; no shuffle, no model. Three signals are told apart (``signals``); the first that speaks is the reason.

* Layout: thresholds, tuned per language, on the mean and maximum line length, the shares of white space and alphanumerics, the
  density of numeric literals, the length of names, the share of long encoded runs, and how many lines, or records inside long lines,
  have one shape (names and literals blanked out), as generated tables and record lists repeat it hundreds of times. Long lines are
  also judged by themselves, so that short lines beside them do not hide them. All statistics are of the whole text.
* Place: a directory of the path, or of the root, that holds third-party copies or generated sources.
* Marks: comment lines before the code, right behind its first line, or after its end that say a tool put the file out, or name a foreign
  project's licence. The mark has to begin the comment, so that text about generation is no mark.

Layout finds minified files, data and files of repeated lines. A library's copy or a tool's output that is laid out like anyone's code is
known by place and marks only; no layout statistic tells it from hand-written code.

Defined results: a null or blank file is judged by its place only. Byte-order marks, line ends and path spellings do not matter. A null
language is taken from the path's ending, else the general thresholds hold. Repeated rows are cases each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.sources.tables import table


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language."""

    white: float = 0.14  # a minified file's white space is rarer
    name: float = 3.2  # and its names shorter
    mean_line: float = 110.0  # and its mean line longer
    numbers: float = 0.25  # numeric literals among tokens in a table
    shape: float = 0.65  # lines of one shape in a generated or record file
    shapes: float = 0.82  # lines of the two most frequent shapes
    encoded: float = 0.5  # share of encoded runs in a blob
    longest: int = 1000  # lines as long as this are judged by themselves
    long_share: float = 0.3  # of the text that minified long lines make up
    records: float = 0.5  # of the text that alike records inside long lines make up
    alnum: tuple[float, float] = (0.3, 0.88)  # alphanumerics of code; fewer or more are data


#: Halfway between hand-written and other files of the test tables; where a language is not listed the general values hold.
LANGUAGES = {
    "clojure": Limits(white=0.145, name=3.2),
    "elixir": Limits(white=0.135, name=3.2),
    "java": Limits(white=0.155, name=4.0, mean_line=150.0, numbers=0.23),
    "lua": Limits(white=0.17, name=3.2, mean_line=130.0, numbers=0.22),
    "python": Limits(white=0.18, name=3.3, numbers=0.26),
    "typescript": Limits(white=0.1, name=3.8, mean_line=150.0),
}
ENDINGS = {"py": "python", "lua": "lua", "clj": "clojure", "cljc": "clojure", "cljs": "clojure", "ex": "elixir", "exs": "elixir", "java": "java", "ts": "typescript", "tsx": "typescript", "js": "typescript", "mjs": "typescript"}

VENDOR_DIRS = frozenset("vendor vendored third_party third-party thirdparty 3rdparty 3rd_party external externals node_modules bower_components site-packages dist-packages deps jspm_packages webjars pods carthage elm-stuff .tree-sitter-grammars".split())
LIB_DIRS = frozenset(["libs"])
GENERATED_DIRS = frozenset("__generated__ generated generated-sources generated_sources gen .generated generated-src".split())
GENERATED_NAME = re.compile(r"(_pb2(_grpc)?|\.pb|\.g|\.generated|_generated|\.gen|\.designer)\.\w+$", re.I)
MINIFIED_NAME = re.compile(r"([.-]min|\.bundle|\.prod|\.packed)\.\w+$", re.I)

COMMENT = re.compile(r"^\s*(?://[/!]?|#+!?|;+|--+(?:\[\[)?|/\*+!?|\*+/?|<!--|\"\"\"|''')\s*(.*?)\s*(?:\*/|-->|\"\"\"|''')?\s*$")
TOOL_SAYS = re.compile(
    r"^(?:<auto-?generated>|@generated\b|auto-?generated\b|autogenerated\b|automatically generated\b|code generated\b|generated (?:by|from|automatically|with|using)\b|machine-(?:made|generated)\b|"
    r"this (?:file|code|module|class) (?:was|is|has been) (?:\w+ )?(?:auto-?generated|automatically|generated|created automatically|produced by)|do not (?:modify|edit|change)\b|(?:please )?don'?t edit\b|"
    r"fichier (?:produit|généré|cr[ée]{2})|(?:ce fichier|code) (?:a été |est )?(?:généré|produit)|automatisch (?:erzeugt|generiert|erstellt)|diese datei wurde|"
    r"(?:archivo|fichero|código) (?:generado|creado|producido)|generado (?:por|automáticamente)|файл (?:создан|сгенерирован)|warning:? (?:this file is )?(?:auto)?generated)",
    re.I,
)
#: A project's name, as a word.
NAME = r"[\w.@/-]+"
COPY_SAYS = re.compile(
    rf"^(?:vendored from\b|(?:imported|copied|taken) (?:verbatim |unchanged |unmodified )?from\b|upstream: |mirror of\b|{NAME} v?\d+\.\d+(?:\.\d+)*\b|"
    rf"\(c\) the {NAME} authors\b|contributors to {NAME}\b|copyright \(c\) [\d, -]+ the {NAME} (?:project )?(?:developers|authors|contributors)\b|permission is hereby granted\b|"
    r"redistribution and use in source and binary forms\b|licensed under the\b|spdx-license-identifier:)",
    re.I,
)
#: A name and a version alone may also be the own project's banner; with one of these beside it the file is a copy.
FOREIGN = re.compile(r"\b(?:authors|contributors|developers|licen[cs]e[ds]?|upstream|vendored|verbatim|spdx-license-identifier|redistribution)\b", re.I)

_NUMBER = re.compile(r"(?<![\w.])(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[lLfFn]?(?![\w.])")
_TOKEN = re.compile(r"\w+")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-fA-F]{2}){16,}|(?:0x[0-9a-fA-F]{2},\s*){16,}")
_RECORD = re.compile(r"[\[{(][^\[\]{}()]{8,}[\]})]")


def place(path: str | None, root: str | None) -> str | None:
    """'vendored', 'generated' or 'minified' by where the file lies."""
    p = (path or "").replace("\\", "/")
    parts = [s for s in p.lower().split("/")[:-1] if s not in ("", ".")]
    above = [s for s in (root or "").replace("\\", "/").lower().split("/") if s not in ("", ".")]
    if any(s in VENDOR_DIRS for s in (*above, *parts)) or any(a == "static" and b in LIB_DIRS for a, b in zip(parts, parts[1:])):
        return "vendored"
    if any(s in GENERATED_DIRS for s in parts) or GENERATED_NAME.search(p):
        return "generated"
    return "minified" if MINIFIED_NAME.search(p) else None


def marks(lines: list[str]) -> str | None:
    """'generated' or 'vendored' by the comments before the code, right behind its first line, or after its end."""
    full = [x for x in lines if x.strip()]
    said, code = [], 0
    for x in full:
        m = COMMENT.match(x)
        if m:
            said.append(m[1])
        elif code:
            break
        code += not m
    last = []
    for x in reversed(full):
        m = COMMENT.match(x)
        if not m:
            break
        last.append(m[1])
    if any(TOOL_SAYS.match(s) for s in (*said, *last)):
        return "generated"
    return "vendored" if any(COPY_SAYS.match(s) and FOREIGN.search(s) for s in said) else None


_SIGNED = re.compile(r"[-+](?=\d)")
_NAMES = re.compile(r"[A-Za-z_]\w*|[^\W\d]\w*")
_NUMBERS = re.compile(r"\d\w*")
_ROW = re.compile(r"0(?:[,\s]+0)+")


def shape(text: str) -> str:
    """Text with names, numbers and strings blanked out; line ends stay."""
    s = _NUMBERS.sub("0", _NAMES.sub("W", _SIGNED.sub("", _STRING.sub("s", text))))
    return _ROW.sub("0+", s) if "\n" not in s else "\n".join(_ROW.sub("0+", x) if "0" in x else x for x in s.split("\n"))


def _white(text: str) -> float:
    return (len(text) - sum(map(len, text.split()))) / max(1, len(text))


def _name(text: str) -> float:
    names = [t for t in _TOKEN.findall(text) if not t[0].isdigit()]
    return sum(map(len, names)) / max(1, len(names))


def records(lines: list[str], least: int = 8) -> int:
    """Characters of the records of two shapes that occur ``least`` times; nested ones count for themselves or for what holds them."""
    best = 0
    blank = lambda m: '"' + "x" * (len(m[0]) - 2) + '"'
    lines = [_STRING.sub(blank, x) for x in lines]
    for _ in range(3):
        sizes: dict[str, list[int]] = {}
        for m in (m for x in lines for m in _RECORD.findall(x)):
            sizes.setdefault(shape(m.replace("\n", " ")), []).append(len(m))
        best = max(best, sum(sorted(sum(x) for x in sizes.values() if len(x) >= least)[-2:]))
        lines = [re.sub(r"[\[{(][^\[\]{}()]*[\]})]", blank, x) for x in lines]
    return best


def layout(text: str, long: int = Limits.longest) -> dict[str, float]:
    """The statistics the thresholds apply to."""
    lines = [x for x in text.split("\n") if x.strip()]
    n = len(text)
    code = [x for x in lines if not COMMENT.match(x)] or lines
    wide = [x for x in code if len(x) >= long]
    long_text = "\n".join(wide)
    shapes = Counter(s for s, x in zip(map(str.strip, shape("\n".join(code)).split("\n")), code) if len(x.strip()) > 6 and _TOKEN.search(x))
    top = [c for _, c in shapes.most_common(2)]
    tokens = _TOKEN.findall(text)
    names = [t for t in tokens if not t[0].isdigit()]
    parts = text.split()
    may_run = "\\x" in text or "0x" in text or any(len(w) >= 60 for w in parts)
    runs = [len(m) for m in _RUN.findall(text)] if may_run else []
    return {
        "lines": len(lines),
        "longest": max(map(len, code), default=0),
        "long_share": sum(map(len, wide)) / max(1, n),
        "long_white": _white(long_text),
        "long_name": _name(long_text),
        "records": records(wide) / max(1, n) if wide else 0.0,
        "mean_line": sum(map(len, code)) / max(1, len(code)),
        "white": (n - sum(map(len, parts))) / max(1, n),
        "alnum": sum(map(len, tokens)) / max(1, n),
        "numbers": len(_NUMBER.findall(text)) / max(1, len(tokens)),
        "name": sum(map(len, names)) / max(1, len(names)),
        "encoded": sum(runs) / max(1, n),
        "shape": (top[0] if top else 0) / max(1, len(code)),
        "shapes": sum(top) / max(1, len(code)),
        "repeats": top[0] if top else 0,
    }


def by_layout(text: str, k: Limits) -> str | None:
    """'data', 'minified' or 'generated' by the statistics of the whole text."""
    s = layout(text, k.longest)
    if s["encoded"] >= k.encoded or len(text) >= 200 and not k.alnum[0] <= s["alnum"] <= k.alnum[1]:
        return "data"
    if s["mean_line"] >= k.mean_line and s["white"] <= k.white and s["name"] <= k.name:
        return "minified"
    if s["longest"] >= k.longest and s["long_share"] >= k.long_share and s["long_white"] <= k.white and s["long_name"] <= k.name:
        return "minified"
    if s["records"] >= k.records or s["numbers"] >= k.numbers and (s["shape"] >= k.shape or s["mean_line"] >= 2 * k.mean_line):
        return "data"
    return "generated" if s["repeats"] >= 8 and (s["shape"] >= k.shape or s["shapes"] >= k.shapes) else None


def limits(language: str | None, path: str | None) -> Limits:
    ending = (path or "").rsplit(".", 1)[-1].lower()
    return LANGUAGES.get((language or ENDINGS.get(ending, "")).lower(), Limits())


def signals(text: str | None, path: str | None, language: str | None, root: str | None) -> tuple[str | None, str | None, str | None]:
    """What layout, place and marks say, each for itself; null where one does not speak."""
    t = (text or "").lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    some = bool(t.strip())
    return by_layout(t, limits(language, path)) if some else None, place(path, root), marks(t.split("\n")) if some else None


def judged(text: str | None, path: str | None, language: str | None, root: str | None) -> str | None:
    """Why the file is not hand-written: minified, data, generated or vendored; null for a hand-written one."""
    return next((x for x in signals(text, path, language, root) if x), None)


def classified(files: DataFrame, key: str = "fallback_id") -> DataFrame:
    """key, layout, place, marks and reason (null: hand-written) of every row; columns raw_context, path, language, root_path."""
    x = files.select(F.col(key).alias("k"), *[F.col(c).cast("string").alias(c) for c in ("raw_context", "path", "language", "root_path")])
    kind = dict(x.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [signals(*row) for row in zip(*(b.column(i).to_pylist() for i in range(1, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([s[i] for s in said], pa.string()) for i in range(3))], names=["k", "layout", "place", "marks"])

    got = x.mapInArrow(run, f"k {kind}, layout string, place string, marks string").withColumnRenamed("k", key)
    return got.withColumn("reason", F.coalesce("layout", "place", "marks"))


def not_handwritten(spark, d: str) -> DataFrame:
    """p5_found."""
    return classified(table(spark, d, "degraded_fallback")).where("reason is not null").select("fallback_id")


def reasons_by_language(spark, d: str) -> DataFrame:
    """p5_reasons: files by language and by what each signal says of them."""
    files = table(spark, d, "degraded_fallback")
    got = classified(files.withColumn("key", F.struct("language", "fallback_id")), "key")
    lang = F.coalesce(F.lower("key.language"), F.lit("unknown"))
    none = lambda c: F.coalesce(c, F.lit("handwritten")).alias(c)
    return got.groupBy(lang.alias("language"), *[none(c) for c in ("layout", "place", "marks", "reason")]).agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {"p5_found": not_handwritten, "p5_reasons": reasons_by_language}
SQL: dict[str, str] = {}
