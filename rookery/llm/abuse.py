"""Abusive, hateful and sexual content by class-conditional Kneser-Ney models.

Two word models, toxic and ordinary, are interpolated Kneser-Ney bigram models: discounted pair counts, below them the class'
continuation counts, below these the continuation counts of both classes together. So an expression that is rare in one class is
smoothed by all that is known of it, and unseen words weigh the same in both. A text's score is the greatest length-normalised
difference of the two log-likelihoods over all its spans of words, of any length, as a remark is a few words in a long text.

Labels are given for whole documents and raters err, while a remark is one sentence of many. So training alternates: the
ordinary model is fit on documents rated 0; in documents rated 1 the spans of words that such documents have more often, later
those that the current models tell apart best, are taken as toxic, the rest of them is not used. The threshold is the one
that agrees best with the ratings, by cross-validation, where documents rated 0 count ``RARER`` times. That weight is a fixed
assumption about how much rarer abuse is in the corpus than in the labelled sample; the corpus' rate is not estimated.

Spelling is undone first: letter case, accents, look-alike and invisible characters, digits and signs for letters, letters
set apart, letters repeated, words masked by asterisks. Paths and identifiers become one token, numbers another, names of
speakers another, so that the models see the sentence's frame.

The fit uses at most ``MAX_LABELLED`` labelled documents (those with the lowest hashes); all else covers every document.
Null and empty texts score 0 and are never found; repeated texts score alike. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.leakage import _FOLD
from rookery.sources.tables import table

#: Bound of the sample the models are fit on, in documents.
MAX_LABELLED = 20_000
DISCOUNT = 0.75
#: A word in fewer documents of the sample stands for any unknown word, so that both models learn where such words occur.
KNOWN = 2
ROUNDS = 4
#: An assumption, not an estimate: labelled documents are picked by hand, and abusive ones are taken to be several times as frequent
#: among them as in the corpus. Where they are no more frequent the cut is too high, where they are much more so too low.
RARER = 4.0
FOLDS = 5
#: Below as many labelled documents a fit warns: its scores are hardly better than chance.
FEW = 100
_LAST: dict[bytes, tuple] = {}
#: Spans of at least 2 words; a span's sum of differences is divided by its length plus PRIOR, so that a word or two cannot win alone.
LEAST, PRIOR = 2, 8.0

_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_APART = re.compile(r"(?<![a-z0-9*])[a-z*]([ ._\-])(?:[a-z*]\1)+[a-z*](?![a-z0-9*])")
_REPEAT = re.compile(r"([a-z])\1{2,}")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_SPLIT = re.compile(r"[()\[\]{}<>=\"|]+")
END = "</s>"


#: The first words of every vocabulary; the last two stand for unknown words, plain and masked ones.
SPECIAL = (END, "<unk>", "<unk*>")
UNKNOWN, UNKNOWN_MASKED = 1, 2
_FIRST = np.zeros(1, np.int64)
Counts = tuple[np.ndarray, np.ndarray]


@lru_cache(maxsize=1 << 16)
def _folded(run: str) -> str:
    t = unicodedata.normalize("NFKD", run).translate(_FOLD)
    return "".join(c for c in t if c.isascii() or unicodedata.category(c) not in ("Mn", "Cf", "Me"))


def folded(text: str) -> str:
    """Latin letters without accents and look-alikes, without invisible characters; case is kept."""
    return text if text.isascii() else _OTHER.sub(lambda m: _folded(m[0]), text)


def words(text: str) -> list[str]:
    """The tokens of a text; sentence ends are tokens too."""
    out: list[str] = []
    t = folded(text).replace("\r", "\n")
    if _APART.search(low := t.lower()):
        t = "\n".join(_APART.sub(_together, x) if _APART.search(x) else line for line, x in zip(t.split("\n"), low.split("\n")))
    for line in _SPLIT.sub(" ", t).split("\n"):
        for raw in line.split():
            token, tail = _read(raw)
            if token:
                out.append(token)
            if tail and out and out[-1] != END:
                out.append(END)
        if out and out[-1] != END:
            out.append(END)
    return out


@lru_cache(maxsize=1 << 18)
def _read(raw: str) -> tuple[str | None, bool]:
    """The token of a word, and whether a sentence ends with it. Words repeat, so most are looked up."""
    core = raw.strip("\"'`()[]{}<>,.;:!?#>*“”‘’«»¿¡…-")
    return _token(core) if core else None, raw[-1] in ".!?;:" or len(raw) > 1 and raw[-2] in ".!?"


def _together(m: re.Match) -> str:
    """Letters set apart as a word; a leading ``a`` or ``i`` before a space is a word of its own."""
    t = m[0].replace(m[1], "")
    return f"{t[0]} {t[1:]}" if m[1] == " " and t[0] in "ai" and len(t) > 4 else t


def _token(core: str) -> str:
    if core[0].isdigit() and re.fullmatch(r"[\d.,:%x-]+[a-zA-Z]{0,2}", core):
        return "<n>"
    if re.search(r"[/\\_]|\w\.\w|::|=", core) or re.search(r"[a-z][A-Z]", core) and not re.fullmatch(r"(?:[a-z][A-Z])+[a-z]?|(?:[A-Z][a-z])+[A-Z]?", core):
        return "<id>"
    t = core.lower()
    if t.count("-") and re.fullmatch(r"[\w-]+", t) and not re.fullmatch(r"(?:\w-)+\w", t):
        return "<id>"
    letters = sum(c.isalpha() for c in t)
    if letters >= 2 and any(c in "013457@$!|+" for c in t):
        t = t.translate(_LEET)
    t = _REPEAT.sub(r"\1", t)
    if "*" in t:
        return f"{t[0]}*{t[-1]}" if letters else "<*>"
    t = re.sub(r"[^\w']", "", t)
    return t if any(c.isalpha() for c in t) else "<n>"


class Models:
    """Both models as differences of log-probabilities: of known pairs, and of words after contexts without them.

    Words are numbers; a pair is ``previous * V + word``. Pairs are sorted keys, so a batch of texts is looked up at once."""

    def __init__(self, words_: list[str], toxic: Counts, ordinary: Counts):
        """Pair counts of each class as (sorted keys, counts)."""
        v = len(words_)
        self.index = {w: i for i, w in enumerate(words_)}
        keys = np.union1d(toxic[0], ordinary[0])
        prev, word = keys // v, keys % v
        after = np.bincount(word, minlength=v).astype(np.float64)
        self.low = (after + (after == 0)) / (after.sum() + v + 1)  # shared continuation probabilities, a floor for unseen words
        count, self.unigram, self.lam, self.total = [], [], [], []
        for k, n in (toxic, ordinary):
            c = np.zeros(len(keys))
            c[np.searchsorted(keys, k)] = n
            uni = np.bincount(word, c > 0, v)  # continuation counts: after how many words it occurs
            types, all_ = (uni > 0).sum(), uni.sum()
            self.unigram.append((np.maximum(uni - DISCOUNT, 0) + DISCOUNT * types * self.low) / all_ if all_ else self.low)
            total, kinds = np.bincount(prev, c, v), np.bincount(prev[c > 0], minlength=v)
            self.lam.append(np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0))
            self.total.append(total)
            count.append(c)
        p = [np.maximum(c - DISCOUNT, 0) / np.maximum(t[prev], 1) + lam[prev] * u[word] for c, t, lam, u in zip(count, self.total, self.lam, self.unigram)]
        self.keys, self.pairs, self.side = keys, np.log(p[0] / p[1]), p
        self.single, self.back = np.log(self.unigram[0] / self.unigram[1]), np.log(self.lam[0] / self.lam[1])

    def prob(self, side: int, a: str, w: str) -> float:
        """P(w | a) in one class."""
        i, j = self.index[a], self.index[w]
        at = np.searchsorted(self.keys, i * len(self.index) + j)
        known = at < len(self.keys) and self.keys[at] == i * len(self.index) + j
        return float(self.side[side][at] if known else self.lam[side][i] * self.unigram[side][j])

    def scorer(self) -> Scorer:
        return Scorer(self.index, self.keys, self.pairs.astype(np.float32), self.single.astype(np.float32), self.back.astype(np.float32))


class Scorer:
    """What of the models a task needs."""

    def __init__(self, index: dict[str, int], keys: np.ndarray, pairs: np.ndarray, single: np.ndarray, back: np.ndarray):
        self.index, self.keys, self.pairs, self.single, self.back = index, keys, pairs, single, back

    def save(self, path: str, cut: float) -> None:
        """Stores the model and its threshold as one file, so that scoring needs no labels."""
        np.savez_compressed(path, words=np.array(list(self.index)), keys=self.keys, pairs=self.pairs, single=self.single, back=self.back, cut=cut)

    @staticmethod
    def load(path: str) -> tuple[Scorer, float]:
        with np.load(path) as z:
            return Scorer({w: i for i, w in enumerate(z["words"].tolist())}, z["keys"], z["pairs"], z["single"], z["back"]), float(z["cut"])

    def numbers(self, toks: list[str]) -> np.ndarray:
        get = self.index.get
        return np.fromiter((i if (i := get(w)) is not None else UNKNOWN_MASKED if "*" in w else UNKNOWN for w in toks), np.int64, len(toks))

    def differences(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """log p_toxic - log p_ordinary of each token after the one before, for each text."""
        if not ids:
            return []
        word = np.concatenate([*ids, np.empty(0, np.int64)])
        prev = np.concatenate([x for t in ids for x in (_FIRST, t[:-1]) if len(t)] or [np.empty(0, np.int64)])
        k = prev * len(self.index) + word
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        d = np.where(self.keys[at] == k, self.pairs[at], self.back[prev] + self.single[word])
        return np.split(d, np.cumsum([len(t) for t in ids])[:-1])

    def scores(self, texts: list[list[str]]) -> list[float]:
        return np.maximum(best_spans(self.differences([self.numbers(t) for t in texts]))[0], 0.0).tolist()


#: Texts whose spans are searched at once.
CHUNK = 512


def best_spans(diffs: list[np.ndarray], prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, begin, end) of each text's span of ``LEAST`` words or more, of any length, with the greatest sum / (length + prior); -9 without one.

    A span begins with a word that speaks for it. The greatest ratio is found by raising a bound (Dinkelbach): the span with the greatest
    sum - bound * (length + prior) gives the next bound, until none is above 0. Each step is a running minimum of prefix sums."""
    parts = [_best_spans(diffs[i : i + CHUNK], prior) for i in range(0, len(diffs), CHUNK)] or [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))]
    v, a, b = (np.concatenate(x) for x in zip(*parts))
    return v, a, b


def _best_spans(diffs: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(d) for d in diffs], np.int64)
    score, begin, end = np.full(len(diffs), -9.0), np.zeros(len(diffs), np.int64), np.zeros(len(diffs), np.int64)
    some = np.flatnonzero(size >= LEAST)
    while len(some):
        d = np.concatenate([diffs[i] for i in some]).astype(np.float64)
        n = size[some]
        first = np.r_[0, np.cumsum(n)[:-1]]
        text = np.repeat(np.arange(len(some)), n)
        x = d - np.maximum(score[some], 0.0)[text]
        c = np.cumsum(x)
        c -= np.repeat(c[first] - x[first], n)
        before = c - x
        before[d <= 0] = np.inf
        span = float(c.max() - c.min()) + float(np.abs(x).max()) + 1.0
        low = np.where(np.isinf(before), np.inf, before - text * span)
        low[first] = np.minimum(low[first], (1 - text[first]) * span)  # a text's first value lies below all of the text before
        low = np.minimum.accumulate(low)
        at = np.maximum.accumulate(np.where(low == before - text * span, np.arange(len(d)), -1))
        gain = np.full(len(d), -np.inf)
        gain[1:] = c[1:] - (low[:-1] + text[1:] * span)
        gain[first] = -np.inf
        gain[1:][at[:-1] < first[text[1:]]] = -np.inf
        best = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain == best[text])
        hit = hit[np.r_[True, text[hit][1:] != text[hit][:-1]]]
        more = best - prior * np.maximum(score[some], 0.0) > 1e-7
        hit = hit[more]
        some, first = some[more], first[more]
        if not len(some):
            break
        a, b = at[hit - 1], hit + 1
        total = np.r_[0.0, np.cumsum(d)]
        score[some], begin[some], end[some] = (total[b] - total[a]) / (b - a + prior), a - first, b - first
    return score, begin, end


def _counted(keys: list[np.ndarray]) -> Counts:
    return np.unique(np.concatenate([*keys, np.empty(0, np.int64)]), return_counts=True)


def _at(counts: Counts, keys: np.ndarray) -> np.ndarray:
    """Counts of keys."""
    k, n = counts
    if not len(k):
        return np.zeros(len(keys))
    i = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return np.where(k[i] == keys, n[i], 0)


def fit(rated: list[tuple[list[str], float]], rounds: int = ROUNDS) -> Models | None:
    """Models from (tokens, share of raters who found it offensive)."""
    if not any(r < 0.5 for _, r in rated) or not any(r >= 0.5 for _, r in rated):
        return None
    in_docs = Counter(w for t, _ in rated for w in set(t))
    words_ = [*SPECIAL, *sorted(w for w, n in in_docs.items() if n >= KNOWN and w not in SPECIAL)]
    v, number = len(words_), Scorer({w: i for i, w in enumerate(words_)}, *[np.empty(0)] * 4).numbers
    docs: tuple[list, list] = ([], [])  # clean, bad: keys of the pairs
    for t, r in rated:
        ids = number(t)
        docs[r >= 0.5].append(np.concatenate([_FIRST, ids[:-1]]) * v + ids if len(ids) else ids)
    clean, bad = docs
    ordinary = _counted(clean)
    # first round: pairs of words that documents rated 1 have more often; ratings err, so either side may hold any pair
    df = [_counted([np.unique(k) for k in side]) for side in (bad, clean)]
    dw = [_counted([np.unique(k % v) for k in side]) for side in (bad, clean)]
    odds = lambda x, y: np.log((x + 0.5) / (len(bad) + 1)) - np.log((y + 0.5) / (len(clean) + 1))
    spans = toxic_spans([0.5 * (odds(_at(df[0], k), _at(df[1], k)) + odds(_at(dw[0], k % v), _at(dw[1], k % v))) - 0.2 for k in bad], 0.4)
    models = None
    for _ in range(rounds):
        # the rest of a document rated 1 may hold remarks not found yet, so it is no ordinary text
        toxic = _counted([k[a:b] for k, s in zip(bad, spans) for a, b in s])
        models = Models(words_, toxic, ordinary)
        spans = toxic_spans(models.scorer().differences([k % v for k in bad]))
    return models


def toxic_spans(diffs: list[np.ndarray], least: float = 0.5) -> list[list[tuple[int, int]]]:
    """All spans above ``least`` of each text, best first, without overlap."""
    diffs, out = [np.array(d, np.float64) for d in diffs], [[] for _ in diffs]
    left = list(range(len(diffs)))
    while left:
        v, a, b = best_spans([diffs[i] for i in left])
        left, found = [i for i, x in zip(left, v) if x >= least], [(int(p), int(q)) for x, p, q in zip(v, a, b) if x >= least]
        for i, (p, q) in zip(left, found):
            d = diffs[i]
            while q < len(d) and d[q] > 0.5:
                q += 1
            out[i].append((p, q))
            d[p:q] = -5.0
    return out


def score(models: Models | None, toks: list[str]) -> float:
    return models.scorer().scores([toks])[0] if models and toks else 0.0


def threshold(rated: list[tuple[list[str], float]], folds: int = FOLDS, rarer: float = RARER) -> float:
    """The score that separates held-out ratings with the best F1, where documents rated 0 count ``rarer`` times."""
    got = []
    for k in range(folds):
        m = fit([x for i, x in enumerate(rated) if i % folds != k])
        held = [x for i, x in enumerate(rated) if i % folds == k]
        got += zip(m.scorer().scores([t for t, _ in held]) if m else [0.0] * len(held), [r >= 0.5 for _, r in held])
    got.sort(reverse=True)
    positives, best, cut, hit, found = sum(y for _, y in got), -1.0, math.inf, 0, 0.0
    for n, (s, y) in enumerate(got, 1):
        hit, found = hit + y, found + (1 if y else rarer)
        f = 2 * hit / (found + positives)
        if f > best and s > 0:
            following = next((x for x, _ in got[n:] if x < s), 0.0)
            best, cut = f, (s + following) / 2
    return cut


def tokenized(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``toks``."""
    x = documents.select(*keep, F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"`{c}` {t}" for c, t in x.dtypes if c != "_t") + ", toks array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = [words(t) if t else [] for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(toks, pa.list_(pa.string()))], names=[*b.schema.names[:-1], "toks"])

    return x.mapInArrow(run, schema)


def rated_documents(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[tuple[list[str], float]]:
    """Tokens and mean rating of at most ``limit`` labelled documents; the sample is fixed by a hash of the id."""
    rated = labels.where("doc_id is not null and offensive is not null").groupBy("doc_id").agg(F.avg("offensive").alias("rating"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    x = documents.where("text <> ''")
    got = tokenized(x.join(F.broadcast(sample), "doc_id"), ["doc_id", "rating"]).toLocalIterator()  # the sample's size is bounded
    once = {r["doc_id"]: ([sys.intern(w) for w in r["toks"]], float(r["rating"])) for r in got}
    return [once[k] for k in sorted(once)]


def scored(documents: DataFrame, models: Models | Scorer | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` of every row; a narrow pass over the text."""
    shared = documents.sparkSession.sparkContext.broadcast(models.scorer() if isinstance(models, Models) else models)
    x = documents.select(*keep, F.col(text).cast("string").alias("_t"))
    schema = ", ".join(f"`{c}` {t}" for c, t in x.dtypes if c != "_t") + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            s = [round(x, 6) for x in m.scores([words(t) if t else [] for t in texts])] if m else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return x.mapInArrow(run, schema)


def rated_scores(spark, d: str, keep: list[str]) -> tuple[DataFrame, float]:
    """Scores of all documents and the threshold."""
    docs = table(spark, d, "documents")
    rated = rated_documents(docs, table(spark, d, "moderation_labels"))
    models, cut = fitted(rated)
    return scored(docs, models, keep), cut


def fitted(rated: list[tuple[list[str], float]]) -> tuple[Models | None, float]:
    """The models and their threshold. The last fit is kept, as several queries of one session use the same labels."""
    key = hashlib.sha256(repr(rated).encode()).digest()
    if key not in _LAST:
        if 0 < len(rated) < FEW:
            warnings.warn(f"abuse models from {len(rated)} labelled documents are weak; at least {FEW} are needed", stacklevel=2)
        models = fit(rated)
        got = models, threshold(rated) if models else math.inf
        _LAST.clear()
        _LAST[key] = got
    return _LAST[key]


def abusive_documents(spark, d: str) -> DataFrame:
    """p8_found."""
    x, cut = rated_scores(spark, d, ["doc_id"])
    return x.where(F.col("score") > cut).select("doc_id")


def document_scores(spark, d: str) -> DataFrame:
    """p8_scores: doc_id, source, score and whether it passes the threshold."""
    x, cut = rated_scores(spark, d, ["doc_id", "source"])
    return x.withColumn("abusive", F.col("score") > cut)


def rates_by_source(spark, d: str) -> DataFrame:
    """p8_rates."""
    x = document_scores(spark, d)
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"))


QUERIES = {"p8_found": abusive_documents, "p8_scores": document_scores, "p8_rates": rates_by_source}
SQL: dict[str, str] = {}
