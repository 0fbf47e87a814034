"""Evaluation passages inside a training corpus, by q-gram filtering in diagonal bands and banded alignment.

Both sides are reduced to what does not depend on layout: case, punctuation, markup, escapes, comment marks, invisible and
look-alike characters go, what is left is a stream of letters and digits of any script (UTF-8) and the words it came from.
Documents with markup are read without tags, with the words inside tags, and without comments, so that passages inside and
around them are found. Sentences that several items have in common are not part of an item's own passage.

1. Filter. Every 8-gram of a document's stream is an exact 64-bit key, looked up in the items' 8-grams for all documents
   of a batch at once. By the q-gram lemma for word edits, n words of c bytes with e edited words keep at least
   ``c + 1 - q - sum(len(w) + q - 1)`` of their grams whole, the sum over the e longest words. A leak has 18, 20, 30, 40, ... words
   at least for 1, 2, 3, 4, ... edits, so it meets the bound of one such window of the item. Hits are counted in overlapping bands
   of word diagonals (word of the document less word of the item) as wide as an item's words and edits: no run can leave
   its pair of bands, however long its added words are. Bands in which no window of the item has its bound are dropped, no other.
2. Verification. Each stretch of contiguous hits of a kept band is extended to both sides by banded alignment: for every number of edits,
   and every diagonal that many edits can reach, the furthest word that can be matched. Words match on the streams, so words joined
   or split by layout cost nothing; altered, missing and added words cost one. Every stretch is tried, so no path is left out. A run of
   at least 18 words with at most one edit in ten is a leak, or the whole item where it has fewer words. A run begins and ends
   with a word left whole; the first and last may also be altered where they still resemble the item's, and a whole item
   may lack words at its ends. Next to a run any other word is just the surrounding text.

Items with a window whose bound is below 1 (very short ones, or with very long words) are not filtered: e edits leave one of e + 1 parts
of a run whole, so every stretch of that many words is searched for literally and extended in the same way.

The item side is a stated query set of fixed size, collected once. It is split into blocks of at most ``BLOCK_BYTES`` of text; each
block's index is built once, is bounded (about 70 bytes per byte of text) and goes to the tasks by broadcast; the corpus is passed once
per block. The corpus is never shuffled; documents are not compared with each other. Null and empty texts and items have no
cases; repeated texts are cases each; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.sources.tables import table

Q = 8
RUN = 18
#: One word in ten may be edited.
ONE_IN = 10
BLOCK_BYTES = 2_000_000
#: Least likeness of an altered word at the end of a run to the item's.
ALIKE = 0.6

#: Look-alike letters outside Latin, by the ASCII letter they resemble (fixed values).
LOOKALIKE = {
    "a": "аαɑ", "b": "Ьвβ", "c": "сϲ", "d": "ԁ", "e": "еєεҽ", "g": "ɡց", "h": "һн", "i": "іιıӏɩ", "j": "јϳ", "k": "кκ", "l": "ⅼ", "m": "мϻ", "n": "пηո",
    "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "гⲅ", "s": "ѕꜱ", "t": "тτ", "u": "υսц", "v": "ѵν", "w": "ѡԝω", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}
_FOLD = {ord(x): a for a, xs in LOOKALIKE.items() for x in xs} | {ord("ß"): "ss", ord("ø"): "o", ord("ł"): "l", ord("æ"): "ae"}
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\([nrtbf])|\\([\"'/\\])")
_NOTE = re.compile(r"<!--.*?-->", re.S)
_NOTE_MARK = re.compile(r"<!--|-->")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_TOKEN = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")


def _unescaped(text: str) -> str:
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "\\" in t:
        t = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " " if m[2] else m[3], t)
        t = t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if "\\u" in text else t
    return t


@lru_cache(maxsize=1 << 16)
def _folded(run: str) -> str:
    t = unicodedata.normalize("NFKD", run).translate(_FOLD)
    return "".join(c if c.isascii() or c.isalnum() else "" if unicodedata.category(c) in ("Mn", "Cf", "Me") else " " if c.isspace() else "~" for c in t)


def _letters(t: str) -> str:
    t = t.lower()
    return t if t.isascii() else _OTHER.sub(lambda m: _folded(m[0]), t).lower()


def plain(text: str) -> str:
    """Lower-case text without tags, escapes, accents, look-alikes and invisible characters; blanks stay blanks, comments lose their marks only."""
    t = _unescaped(text)
    return _letters(_TAG.sub(" ", _NOTE_MARK.sub(" ", t)) if "<" in t else t)


def readings(text: str) -> list[str]:
    """A document as by ``plain``, also with the words inside tags and without comments of markup, as a passage may lie inside or around them."""
    t = _unescaped(text)
    if "<" not in t:
        return [_letters(t)]
    marked = _NOTE_MARK.sub(" ", t)
    return [_letters(x) for x in dict.fromkeys((_TAG.sub(" ", marked), marked, _TAG.sub(" ", _NOTE.sub(" ", t))))]


class Read:
    """A cleaned text: its stream, where its tokens begin (and its length), and where its words, split at blanks, begin."""

    __slots__ = ("stream", "edges", "words", "ends")

    def __init__(self, cleaned: str):
        parts, self.words, n = [], [], 0
        edges = [0]
        for w in cleaned.split():
            at = n
            for t in _TOKEN.findall(w):
                b = t.encode()
                parts.append(b)
                n += len(b)
                edges.append(n)
            if n > at:
                self.words.append(at)
        self.stream, self.edges = b"".join(parts), frozenset(edges)
        self.ends = [*self.words, n]

    def reversed(self) -> Read:
        r, n = Read.__new__(Read), len(self.stream)
        r.stream, r.edges = self.stream[::-1], frozenset(n - x for x in self.edges)
        r.ends = [n - x for x in self.ends[::-1]]
        r.words = r.ends[:-1]
        return r


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    starts: np.ndarray  # of the words in the stream, and its length
    windows: np.ndarray  # first gram, last gram + 1 and least hits of every window that a leak has to fill
    needle: int  # 0, or how many words in a row are left whole at least, where some window's bound is below 1

    @property
    def stream(self) -> bytes:
        return b"".join(self.words)

    @property
    def band(self) -> int:
        """Words by which a run can leave its diagonal."""
        return len(self.words) + len(self.words) // ONE_IN + 1


def own_passages(items: list[tuple[int, str | None]]) -> list[Item]:
    """The items without the sentences they share with others, and their filter bounds."""
    split = lambda t: re.split(r"(?<=[.?!])\s+", t.strip())
    key = lambda s: " ".join(_TOKEN.findall(plain(s)))
    shared = Counter(k for _, t in items if t for k in {key(s) for s in split(t)})
    out = []
    for item_id, t in items:
        own = Read(plain(" ".join(s for s in split(t) if shared[key(s)] < 2) if t else ""))
        if own.words:
            out.append(_item(item_id, [own.stream[a:b] for a, b in zip(own.ends, own.ends[1:])]))
    return out


def _item(item_id: int, words: list[bytes]) -> Item:
    n = len(words)
    size = np.array([len(w) for w in words], np.int64)
    starts = np.r_[0, np.cumsum(size)]
    # of all runs with e edits the shortest one has the least bound
    runs = [(n, n // ONE_IN)] if n < RUN else [(RUN, 1), *((m, m // ONE_IN) for m in range(2 * ONE_IN, n + 1, ONE_IN))]
    windows = []
    for m, e in runs:
        w = np.sort(np.lib.stride_tricks.sliding_window_view(size, m), axis=1)
        least = w.sum(1) + 1 - Q - (w[:, m - e :].sum(1) + e * (Q - 1))
        windows.append(np.stack([starts[: n - m + 1], np.maximum(starts[m:] - Q + 1, starts[: n - m + 1]), least], 1))
    windows = np.concatenate(windows)
    needle = min(-(-(m - e) // (e + 1)) for m, e in runs) if windows[:, 2].min() < 1 else 0
    return Item(item_id, words, starts, windows, needle)


class Index:
    """The 8-grams of a block of items: sorted keys with their places, and a bit table that turns most lookups away."""

    BITS = 22

    def __init__(self, items: list[Item]):
        self.items = items
        keys, who, where = [], [], []
        for i, it in enumerate(items):
            k = grams(np.frombuffer(it.stream, np.uint8))
            keys.append(k)
            who.append(np.full(len(k), i, np.int32))
            where.append(np.arange(len(k), dtype=np.int32))
        k = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(k, kind="stable")
        k = k[order]
        self.who, self.where = (np.concatenate(x)[order] if x else np.empty(0, np.int32) for x in (who, where))
        self.keys, first = np.unique(k, return_index=True)
        self.first, self.count = first, np.diff(np.r_[first, len(k)])
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self._slot(self.keys)] = True
        self.least = np.array([max(1, it.windows[:, 2].min()) for it in items], np.int64)
        self.short = [i for i, it in enumerate(items) if it.needle]

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def hits(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, item position) of every shared 8-gram."""
        k = grams(stream)
        at = np.flatnonzero(self.table[self._slot(k)]) if len(self.keys) and len(k) else np.empty(0, np.int64)
        i = np.searchsorted(self.keys, k[at])
        ok = (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] == k[at]) if len(at) else np.empty(0, bool)
        at, i = at[ok], i[ok]
        n = self.count[i]
        flat = np.repeat(self.first[i] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(i) else np.empty(0, np.int64)
        return np.repeat(at, n), self.who[flat], self.where[flat]


def grams(a: np.ndarray) -> np.ndarray:
    """All 8-grams as integers."""
    n = len(a) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    k = np.zeros(n, np.uint64)
    for j in range(Q):
        k |= a[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return k


def shared_grams(index: Index, streams: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(document of the batch, item, positions in both of the hits) of every pair with as many hits as any window of the item needs."""
    gap = b"\n" * Q
    sizes = np.array([len(s) + Q for s in streams])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    pos, who, where = index.hits(np.frombuffer(gap.join(streams) + gap, np.uint8))
    if not len(pos):
        return
    doc = np.searchsorted(starts, pos, side="right") - 1
    pos = pos - starts[doc]
    pair = doc * len(index.items) + who
    order = np.argsort(pair, kind="stable")
    pair, pos, where = pair[order], pos[order], where[order]
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    ends = np.r_[first[1:], len(pair)]
    d, w = np.divmod(pair[first], len(index.items))
    for j in np.flatnonzero(ends - first >= index.least[w]):
        yield int(d[j]), int(w[j]), pos[first[j] : ends[j]], where[first[j] : ends[j]]


def stretches(item: Item, read: Read, pos: np.ndarray, where: np.ndarray) -> list[tuple[int, int]]:
    """(item word, document position) from which to extend each stretch of contiguous hits in the bands that may hold a leak, longest first."""
    if not _enough(item, where):
        return []
    diagonal = np.searchsorted(read.words, pos, side="right") - np.searchsorted(item.starts, where, side="right")
    band = diagonal // item.band
    kept = np.zeros(len(pos), bool)
    for b in np.unique(band):
        some = (band == b) | (band == b + 1)
        if _enough(item, where[some]):
            kept |= some
    pos, where = pos[kept], where[kept]
    order = np.lexsort((pos, pos - where))
    pos, where = pos[order], where[order]
    new = np.flatnonzero(np.r_[True, (np.diff(pos) != 1) | (np.diff(where) != 1)]) if len(pos) else np.empty(0, np.int64)
    size = np.diff(np.r_[new, len(pos)])
    out = []
    for j in np.argsort(-size, kind="stable"):
        a, p = int(where[new[j]]), int(pos[new[j]])
        first, last = np.searchsorted(item.starts, [a, a + int(size[j]) + Q - 1 + 1])
        inside = range(int(first), int(last) - 1)  # whole words of the stretch
        if inside:
            at = lambda w: p + int(item.starts[w]) - a  # noqa: B023, E731
            w = next((w for w in inside if at(w) in read.edges and at(w + 1) in read.edges), inside[0])
            out.append((w, at(w)))
    return out


def _enough(item: Item, where: np.ndarray) -> bool:
    got = np.zeros(int(item.starts[-1]) + 1, np.int64)
    got[where + 1] = 1
    got = np.cumsum(got)
    return bool((got[item.windows[:, 1]] - got[item.windows[:, 0]] >= item.windows[:, 2]).any())


def extended(words: list[bytes], read: Read, p: int, edits: int) -> tuple[list[int], list[int], list[list[tuple[int, bytes, bytes]]]]:
    """How many of ``words`` the text goes on with from p, for 0 to ``edits`` edits: up to a word left whole that is one of the text's, up to any word at an end of the text's words, and the altered words (number, item's, text's) that could be last."""
    n, stream = len(words), read.stream
    whole, reach, altered = [0] * (edits + 1), [0] * (edits + 1), [[] for _ in range(edits + 1)]
    front = {(0, p)}
    for e in range(edits + 1):
        far: dict[int, tuple[int, int]] = {}
        for i, at in front:
            if i > reach[e] and at in read.edges:
                reach[e] = i
            while i < n and stream.startswith(words[i], at):
                begin, at = at, at + len(words[i])
                i += 1
                if at in read.edges and begin in read.edges:
                    whole[e], reach[e] = max(whole[e], i), max(reach[e], i)
            k = bisect_right(read.words, at)
            if i and at not in read.edges and e < edits:  # it ends inside a longer word of the text
                altered[e + 1].append((i, words[i - 1], stream[max(0, at - len(words[i - 1])) : read.ends[k]]))
            if far.get(i - k, (-1, 0)) < (i, at):
                far[i - k] = (i, at)
        if e == edits:
            break
        whole[e + 1], reach[e + 1] = whole[e], reach[e]
        front = set()
        for i, at in far.values():
            k = bisect_right(read.words, at)
            after = read.ends[k] if k < len(read.ends) else None
            if i < n:
                front.add((i + 1, at))
                if after is not None and after > at:
                    front.add((i + 1, after))
                    altered[e + 1].append((i + 1, words[i], stream[at:after]))
            if after is not None and after > at:
                front.add((i, after))
    return whole, reach, altered


def leaks(item: Item, read: Read, backward: Read, w: int, p: int) -> bool:
    """Whether a run through the place where item word w meets position p of the text is a leak."""
    n = len(item.words)
    edits, need = n // ONE_IN, min(RUN, n)
    right, right_any, right_alt = extended(item.words[w:], read, p, edits)
    closed = p in read.edges and w < n and p + len(item.words[w]) in read.edges  # a run may begin here
    if right[0] >= need and closed:
        return True
    left, left_any, left_alt = extended([x[::-1] for x in item.words[:w][::-1]], backward, len(read.stream) - p, edits)
    for a in range(edits + 1):
        for b in range(edits + 1 - a):
            if left_any[a] == w and right_any[b] == n - w and (closed or left_any[a] and right_any[b]):
                return True
            m = left[a] + right[b]
            if m >= need and a + b <= m // ONE_IN and (closed or left[a] and right[b]):
                return True
    alike = lambda x, y: SequenceMatcher(None, x.decode(errors="replace"), y.decode(errors="replace"), False).ratio() >= ALIKE
    ends = lambda whole, alt, turn: [(i, e, None, None) for e, i in enumerate(whole)] + [(i, e, x[::turn], y[::turn]) for e, z in enumerate(alt) for i, x, y in z if i > whole[e]]
    for i, a, x, y in ends(left, left_alt, -1):
        for j, b, u, v in ends(right, right_alt, 1):
            m = i + j
            if m >= need and a + b <= m // ONE_IN and (x or u) and (x is None or alike(x, y)) and (u is None or alike(u, v)):
                return True
    return False


def literal(item: Item, read: Read) -> Iterator[tuple[int, int]]:
    """The places of every ``needle`` words of the item in a row."""
    for w in range(len(item.words) - item.needle + 1):
        x = b"".join(item.words[w : w + item.needle])
        p = read.stream.find(x)
        while p >= 0:
            yield w, p
            p = read.stream.find(x, p + 1)


def found_in(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(place in the batch, item_id) of the leaks of a batch of texts."""
    read = [(i, c) for i, t in enumerate(texts) if t for c in readings(t)]
    streams = ["".join(_TOKEN.findall(c)).encode() for _, c in read]
    parsed: dict[int, tuple[Read, Read]] = {}
    done: set[tuple[int, int]] = set()

    def parse(d: int) -> tuple[Read, Read]:
        if d not in parsed:
            parsed.clear()  # pairs come document by document
            r = Read(read[d][1])
            parsed[d] = r, r.reversed()
        return parsed[d]

    for d, w, pos, where in shared_grams(index, streams):
        item, i = index.items[w], read[d][0]
        if (i, w) not in done and not item.needle and any(leaks(item, *parse(d), *at) for at in stretches(item, parse(d)[0], pos, where)):
            done.add((i, w))
            yield i, item.item_id
    if index.short:
        for d, (i, _) in enumerate(read):
            for w in index.short:
                item = index.items[w]
                if (i, w) not in done and any(leaks(item, *parse(d), *at) for at in literal(item, parse(d)[0])):
                    done.add((i, w))
                    yield i, item.item_id


def blocks(items: list[Item]) -> Iterator[list[Item]]:
    """Items in blocks of bounded size; an item above the bound has a block of its own."""
    block, size = [], 0
    for it in items:
        if block and size + len(it.stream) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(it)
        size += len(it.stream)
    if block:
        yield block


def contaminated(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item_id of every leak. ``items`` has item_id and item_text and is bounded by its definition."""
    own = own_passages([(r[0], r[1]) for r in items.select("item_id", "item_text").orderBy("item_id", "item_text").collect()])
    docs = documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t <> ''")
    kind = dict(docs.dtypes)["k"]
    schema = f"k {kind}, item_id bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(own):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = list(found_in(shared.value, b.column(1).to_pylist()))
                if got:
                    at, who = zip(*got)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(who, pa.int64())], names=["k", "item_id"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out.withColumnRenamed("k", key)


def leaked_items(spark, d: str) -> DataFrame:
    """p7_found."""
    return contaminated(table(spark, d, "documents"), table(spark, d, "eval_items")).distinct()


def leaked_by_source(spark, d: str) -> DataFrame:
    """p7_sources: documents and leaked items per source."""
    docs = table(spark, d, "documents")
    got = leaked_items(spark, d)
    per = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
    x = docs.select("doc_id", "source").join(per, "doc_id", "left")
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("n_items").alias("n_leaking"), F.coalesce(F.sum("n_items"), F.lit(0)).cast("bigint").alias("n_leaks"))


QUERIES = {"p7_found": leaked_items, "p7_sources": leaked_by_source}
SQL: dict[str, str] = {}
