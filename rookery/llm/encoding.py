"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

A text is encoded as a monoid: leaves of ``LEAF`` characters are encoded by the library and neighbours are joined up a balanced
tree. An encoded stretch is its list of token ids. The tokenizer splits a text into pieces by a pattern, and tokens never cross
pieces. A place is a certain cut if no match of the pattern can cross it or look across it, whatever surrounds it: where a
letter, number or sign is followed by another of these classes or by white space. There the ids of the two sides just follow
each other. A join

* searches the last certain cut before the seam and the first one behind it, in windows that double, encodes the text between the
  two again and keeps all tokens outside: they lie beyond certain cuts, so nothing can change them;
* where ``LONG`` characters of one class surround the seam, it lies inside a single piece: there tokens at the seam are merged
  again over a growing window until the pairs at its ends are stable, which makes the whole piece stable. So one
  endless word is not encoded again at each level. Anything else lets the first window grow to the stretch's ends.

Decoding concatenates the tokens' bytes up the same tree and reads the result as UTF-8.

Ids: null and empty texts both have the empty list. Text that looks like a special token is plain text. Every row has a
result, repeated rows too; row order and other columns do not matter. The vocabulary's path is a parameter, each Python
worker reads the file once; it is never shipped in a task nor copied.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.sources.tables import table

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
LEAF = 512
#: Characters on each side of a seam that are searched for a certain cut before the seam is taken to lie inside one long run.
LONG = 2048
#: The split pattern that belongs to the vocabulary (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tiktoken encoding of a ranks file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters whose class is beyond doubt in every version of Unicode; the apostrophe is left out, as it may begin a contraction.
_L = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_N, _S = "0-9", r" \t\n\r"
_P = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~") + "\u3001\u3002\uff0c\uff01\uff1f"
#: No match of the split pattern goes on across these places, nor looks across them: letters, numbers and signs are never in one
#: match, and white space is never behind any of them.
_CUT = re.compile(f"(?<=[{_L}])(?=[{_N}{_P}{_S}'])|(?<=[{_N}])(?=[{_L}{_P}{_S}'])|(?<=[{_P}])(?=[{_L}{_N}{_S}])|(?<=')(?=[{_N}{_S}])")
_SAME = re.compile(f"[{_L}]+|[{_N}]+|[{_P}]+|[{_S}]+")


def _cut_before(text: str, begin: int, seam: int, most: int) -> int | None:
    """The last certain cut in (begin, seam], or begin; none if ``most`` characters hold none."""
    width = 16
    while True:
        a = max(begin, seam - width)
        at = [m.start() for m in _CUT.finditer(text[a : seam + 1])]
        if at and a + at[-1] > begin:
            return a + at[-1]
        if a == begin:
            return begin
        if width >= most:
            return None
        width *= 2


def _cut_after(text: str, seam: int, end: int, most: int) -> int | None:
    """The first certain cut in [seam, end), or end; none if ``most`` characters hold none."""
    width = 16
    while True:
        b = min(end, seam + width)
        m = _CUT.search(text[seam - 1 : b])
        if m:
            return seam - 1 + m.start()
        if b == end:
            return end
        if width >= most:
            return None
        width *= 2


def join(text: str, begin: int, seam: int, end: int, left: list[int], right: list[int], encoding, long: int = LONG) -> list[int]:
    """The ids of text[begin:end] from those of both parts; see the module's text for why nothing outside the window can differ."""
    a, b = _cut_before(text, begin, seam, long), _cut_after(text, seam, end, long)
    if a == seam or b == seam:
        return left + right
    if (a is None or b is None) and begin + long < seam < end - long and _SAME.fullmatch(text, seam - long, seam + long):
        got = _join_inside(text[seam - long : seam], text[seam : seam + long], left, right, encoding)
        if got is not None:
            return got
    most = end - begin
    a = _cut_before(text, begin, seam, most) if a is None else a
    b = _cut_after(text, seam, end, most) if b is None else b
    encode_ = encoding.encode_ordinary
    keep = len(left) - len(encode_(text[a:seam])) if a > begin else 0
    drop = len(encode_(text[seam:b])) if b < end else len(right)
    return left[:keep] + encode_(text[a:b]) + right[drop:]


def _join_inside(before: str, after: str, left: list[int], right: list[int], encoding) -> list[int] | None:
    """A join inside one piece: tokens at the seam are merged again over a growing window, until its ends are stable.

    A sequence of tokens is the byte-pair encoding of its bytes if each two neighbours are that of theirs; left, right and the window
    are, so only the two pairs at the window's ends have to be looked at. None if the window would leave ``before`` or ``after``."""
    single, bytes_ = encoding._encode_single_piece, encoding.decode_single_token_bytes
    room = len(before.encode()) - 8, len(after.encode()) - 8
    n = 4
    while n < min(len(left), len(right)):
        x, y = b"".join(map(bytes_, left[-n:])), b"".join(map(bytes_, right[:n]))
        if len(x) + len(bytes_(left[-n - 1])) > room[0] or len(y) + len(bytes_(right[n])) > room[1]:
            return None
        window = single(x + y)
        stable = lambda u, v: single(bytes_(u) + bytes_(v)) == [u, v]
        if stable(left[-n - 1], window[0]) and stable(window[-1], right[n]):
            return left[:-n] + window + right[n:]
        n *= 2
    return None


def encode_tree(text: str, encoding, leaf: int = LEAF, long: int = LONG) -> list[int]:
    """Token ids by the tree of joins; a text of one leaf is a tree without joins."""

    def build(begin: int, end: int) -> list[int]:
        if end - begin <= leaf:
            return encoding.encode_ordinary(text[begin:end])
        middle = (begin + end) // 2
        return join(text, begin, middle, end, build(begin, middle), build(middle, end), encoding, long)

    return build(0, len(text)) if text else []


def decode_tree(ids: list[int], encoding) -> bytes:
    """Concatenation up the tree."""
    if len(ids) <= 4096:
        return encoding.decode_bytes(list(ids))
    middle = len(ids) // 2
    return decode_tree(ids[:middle], encoding) + decode_tree(ids[middle:], encoding)


def encode(text: str | None, encoding, leaf: int = LEAF) -> list[int]:
    return encode_tree(text, encoding, leaf) if text else []


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """key and ids, one row for each row. Narrow: no shuffle, only the two columns are read and sent to Python."""
    path = f"{folder}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(path)
        for b in batches:
            ids = [encode(t, encoding) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    x = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return x.mapInArrow(run, f"k {dict(x.dtypes)['k']}, ids array<int>").withColumnRenamed("k", key)


def decoded(ids: DataFrame, key: str = "doc_id", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """key and text of an encoded table."""
    path = f"{folder}/{name}.tiktoken"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(path)
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "text": [decode_tree(list(x), encoding).decode("utf-8", "replace") for x in pdf["ids"]]})

    x = ids.select(F.col(key).alias("k"), "ids")
    return x.mapInPandas(run, f"k {dict(x.dtypes)['k']}, text string").withColumnRenamed("k", key)


def document_ids(spark, d: str) -> DataFrame:
    """p6_ids."""
    return encoded(table(spark, d, "documents"))


def token_counts(spark, d: str) -> DataFrame:
    """p6_round_trip: documents and code points per source, and how many texts come back the same from their ids."""
    docs = table(spark, d, "documents")
    x = docs.select("doc_id", F.col("source"), F.coalesce("text", F.lit("")).alias("_t"))
    back = decoded(encoded(docs.where("doc_id is not null").dropDuplicates(["doc_id"])))
    both = x.join(back, "doc_id")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("_t")).cast("bigint").alias("n_chars"), F.count_if(F.col("_t") == F.col("text")).alias("n_same"))


QUERIES = {"p6_ids": document_ids, "p6_round_trip": token_counts}
SQL = {"p6_round_trip": "select source, count(*) as n_docs, sum(length(coalesce(text, '')))::bigint as n_chars, count(*) as n_same from documents group by source"}
