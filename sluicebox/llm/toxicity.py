"""Toxicity of deobfuscated text: a noisy channel over character lattices, then a lexical score.

The source model is a character trigram model counted over all documents. Tokens that look
disfigured (look-alike digits and signs, stretched letters, letters set apart) become lattices
of the letters they may stand for; a Viterbi search under the model restores the likeliest
reading. The restored words are scored with weights fitted on labelled documents: words and word
beginnings that stand out, by a significance test, in toxic ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import narrow, text_slices, unused, written

#: Labelled documents that the classifier is fitted on at most (those of the least hash of doc_id).
FIT_ROWS = 20_000
#: A feature needs at most this chance of its toxic share arising from the overall share,
SIGNIFICANCE = 1e-7
#: and at least so many toxic documents, which are at least this share of the documents that have it.
LEAST_TOXIC, LEAST_SHARE = 4, 0.9
#: Word tokens that a worker remembers; beyond it, it starts anew (memory, not results).
REMEMBERED = 300_000

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœßšž"
SIZE = 64  # boundary 0, the letters, and SIZE - 1 for any other letter
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.zeros(0x10000, dtype=np.int64)
for _i in range(0x80, 0x10000):
    if not 0xD800 <= _i < 0xE000 and chr(_i).isalpha():
        _TABLE[_i] = SIZE - 1
for _c, _k in CODE.items():
    _TABLE[ord(_c)] = _k

#: What a sign may stand for, with the channel's log probability.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l"}
_SUB, _DROP, _JOIN, _DOUBLE = math.log(0.3), math.log(0.0005), math.log(0.5), math.log(0.02)
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|])(?:[ .\-_*/,|~·]{1,3}(?:[^\W_]|[@$!|+])(?![^\W_])){2,}")
#: A bar between two letters set apart is a separator, not a letter.
_BAR = re.compile(r"(?<=[^\W_])\|(?=[^\W_])")
_RUN = re.compile(r"([^\W\d_])\1\1")
_TWICE = re.compile(r"(.)\1+", re.S)
_SIGN = re.compile(r"[0-9@$!|+€(¡£*._\-]")
_EDGE = ".,;:?\"'()[]{}<>%&#*-_…«»„“”"


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, dtype=np.int64)
    for batch in text_slices(batches):
        for text in batch.column("text").to_pylist():
            if text:
                codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
                x = np.r_[0, 0, _TABLE[np.where(codes < 0x10000, codes, 0)], 0]
                grams = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
                if len(grams) > 50_000:
                    total += np.bincount(grams, minlength=SIZE**3)
                else:
                    np.add.at(total, grams, 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["gram", "n"])


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``gram int, n bigint``: trigrams of letter classes over every character of every text."""
    return narrow(docs, "text").where("text is not null").mapInArrow(_trigrams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def log_model(grams: np.ndarray, counts: np.ndarray, words: dict[str, float]) -> np.ndarray:
    """Interpolated log P(c | a, b). The words of the lexicon are part of the source: each as one in 20,000 trigrams."""
    total = np.zeros(SIZE**3)
    total[grams] = counts
    boost = max(1.0, total.sum() / 20_000)
    for word in words:
        x = [0, 0, *(CODE.get(c, SIZE - 1) for c in word), 0]
        for a, b, c in zip(x, x[1:], x[2:]):
            total[(a * SIZE + b) * SIZE + c] += boost
    t3 = total.reshape(SIZE, SIZE, SIZE)
    t2, t1 = t3.sum(0), t3.sum((0, 1))
    p1 = (t1 + 1) / (t1.sum() + SIZE)
    kinds2 = (t2 > 0).sum(1, keepdims=True)
    p2 = (t2 + kinds2 * p1) / np.maximum(t2.sum(1, keepdims=True) + kinds2, 1e-9)
    p2 = np.where(kinds2 > 0, p2, p1)
    kinds3 = (t3 > 0).sum(2, keepdims=True)
    p3 = (t3 + kinds3 * p2[None]) / np.maximum(t3.sum(2, keepdims=True) + kinds3, 1e-9)
    return np.log(np.where(kinds3 > 0, p3, p2[None])).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters, the strings that it may stand for and their log probabilities."""
    columns = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            options = [(c * min(n, 2), 0.0)] if n < 3 else [(c, _SUB), (c + c, _SUB + _DOUBLE)]
            if n == 2:
                options = [(c + c, 0.0), (c, _DOUBLE)]
        elif c in " .-_*/,~·":
            options = [("", _JOIN * n), (" ", _JOIN)]
        else:
            letters = LEET.get(c, "")
            options = [(x, _SUB) for x in letters] + [(x + x, _SUB + _DOUBLE) for x in letters if n > 1] + [("", _DROP), (" ", _DROP)]
        columns.append(options)
    return columns


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a disfigured token, by a Viterbi search over its lattice."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for column in lattice(token):
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, back) in states.items():
            for text, cost in column:
                s, x, y = score + cost, a, b
                for c in text:
                    k = 0 if c == " " else CODE.get(c, SIZE - 1)
                    s += float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in nxt or nxt[(x, y)][0] < s:
                    nxt[(x, y)] = (s, (back, text) if text else back)
        states = nxt
    best = max(states.items(), key=lambda kv: kv[1][0] + float(model[kv[0][0], kv[0][1], 0]))[1][1]
    out: list[str] = []
    while best is not None:
        best, text = best
        out.append(text)
    return "".join(reversed(out)).strip()


def disfigured(token: str) -> bool:
    """Whether a token (lower case, without the punctuation around it) may hide another word."""
    if _RUN.search(token):
        return True
    return bool(_SIGN.search(token)) and any(c.isalpha() for c in token) and (not token.isalpha())


def once(token: str) -> str:
    return _TWICE.sub(r"\1", token)


class Scorer:
    """Weights of words (prefix features by length), the model, and what a worker remembers."""

    def __init__(self, words: dict[str, float], starts: dict[str, float], model: np.ndarray):
        self.words, self.starts, self.model = words, starts, model
        self.lengths = sorted({len(x) for x in starts})
        # What words and beginnings look like with each run of a letter written once.
        self.once = {once(x) for x in words}
        self.once_starts = tuple({once(x) for x in starts})
        self.known: dict[str, tuple[float, int]] = {}

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) >= n:
                found = max(found, self.starts.get(word[:n], 0.0))
        return found

    def hides(self, token: str) -> bool:
        """Whether a token may hide a word: it is disfigured, or a letter written twice is all that parts it from one.

        The lattice of a token of letters alone has only readings that are the same with each run written once, so no other one can score.
        """
        if len(token) < 3:
            return False
        if disfigured(token):
            return True
        single = once(token)
        return single != token and any(x in self.once or x.startswith(self.once_starts) for x in re.split(r"[\W_]+", single))

    def restored(self, text: str) -> list[float]:
        """The weights above 0 of the words of the likeliest reading."""
        return [w for w in map(self.weight, restore(text, self.model).split()) if w]

    def token(self, token: str) -> tuple[float, int]:
        """(weight, whether it was restored) of one white-space token."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            bare = token.strip(_EDGE)
            plain = bare.strip(_EDGE + "!$@|")
            got = (max((self.weight(w) for w in re.split(r"[\W_]+", plain)), default=0.0), 0)
            # A bracket in front may be a letter's look-alike: read with it, where the token without it gives nothing.
            for x in (bare, token.strip(_EDGE.replace("(", ""))) if "(" in token else (bare,):
                if not got[0] and self.hides(x):
                    # A very long token (a key, an encoded blob) is read in one pass too: the search is linear in its length.
                    w = max(self.restored(x), default=0.0)
                    got = (w, int(w > 0))
            self.known[token] = got
        return got

    def score(self, text: str | None) -> tuple[float, int, int]:
        """(sum of weights, hits, restored hits) of a text."""
        if not text or not (self.words or self.starts):
            return 0.0, 0, 0
        lower = text.lower()
        total, hits, restored = 0.0, 0, 0
        for token in lower.split():
            w, r = self.known.get(token) or self.token(token)
            if w:
                total += w
                hits += 1
                restored += r
        for m in SPACED.finditer(lower):
            for w in self.restored(_BAR.sub(" ", m[0])):
                total += w
                hits += 1
                restored += 1
        return total, hits, restored


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {w for w in re.split(r"[\W_]+", text.lower()) if len(w) > 2 and not w.isdigit()}
            names = ["w" + w for w in words] + ["s" + x for x in {w[:n] for w in words for n in (4, 5, 6) if len(w) >= n}]
            if names:
                yield pa.RecordBatch.from_pydict({"feature": names, "toxic": pa.array([toxic] * len(names), pa.int32())})


def _tail(k: int, n: int, p: float) -> float:
    """An upper bound (Chernoff) of the chance of at least k of n at share p."""
    q = k / n
    if q <= p:
        return 1.0
    return math.exp(-n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)))


class Fitted:
    def __init__(self, scorer: Scorer, threshold: float):
        self.scorer, self.threshold = scorer, threshold


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, rows: int = FIT_ROWS) -> Fitted:
    """A scorer and the threshold from which on a document is toxic.

    ``labels`` gives ``doc_id, toxic`` (null in either: not used). At most ``rows`` labelled ids,
    and of their documents at most ``rows`` distinct texts, are used, those of the least hashes;
    equal texts count once, as toxic if one label says so. A feature of these texts (a word of
    three letters or more, or its first 4, 5 or 6) counts if at least LEAST_TOXIC toxic texts
    have it, they are at least LEAST_SHARE of the texts with it, and SIGNIFICANCE holds. The
    trigram model is counted over all of ``corpus`` (docs where not given). Without toxic or
    without clean labels, nothing is toxic.
    """
    spark = docs.sparkSession
    marks = narrow(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    # At most ``rows`` rows, so the labels go to the texts: the corpus isn't exchanged.
    labelled = narrow(docs, "doc_id", "text").where("text is not null and doc_id is not null").join(F.broadcast(marks), F.col("doc_id") == F.col("label_id"))
    sample = written(labelled.groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")
    if sample.count() > rows:  # ids that many texts share
        least = sample.select(F.xxhash64("text").alias("h"), "text").select("h", F.sha2("text", 256).alias("s")).orderBy("h", "s").limit(rows)
        sample = written(sample.join(F.broadcast(least), F.sha2("text", 256) == F.col("s"), "left_semi"), "sample")
    counts = sample.mapInArrow(_features, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    n, t = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not t or t == n:
        return Fitted(Scorer({}, {}, np.zeros((SIZE, SIZE, SIZE), np.float32)), math.inf)
    share = t / n
    # Bounded by the sample: only features far above chance leave the executors.
    strong = counts.where((F.col("t") >= LEAST_TOXIC) & (F.col("t") / F.col("n") >= LEAST_SHARE)).orderBy("feature").collect()
    words: dict[str, float] = {}
    starts: dict[str, float] = {}
    for feature, k, m in strong:
        if _tail(k, m, share) <= SIGNIFICANCE:
            weight = math.log(((k + 0.5) / (t + 1)) / ((m - k + 0.5) / (n - t + 1)))
            (words if feature[0] == "w" else starts)[feature[1:]] = weight
    found = trigram_counts(docs if corpus is None else corpus).collect()  # at most SIZE ** 3 rows, whatever the corpus
    model = log_model(np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=float), words)
    scorer = Scorer(words, starts, model)
    sent = spark.sparkContext.broadcast((words, starts, model))
    # A row per labelled document of the bounded sample.
    scored = sample.mapInArrow(_score_sample(sent), "score double, toxic int").collect()
    return Fitted(scorer, best_threshold([(r[0], r[1]) for r in scored]))


def best_threshold(scored: list[tuple[float, int]]) -> float:
    """The score with the best F1 if it and higher ones are toxic; between two scores, the middle."""
    ordered = sorted(scored, reverse=True)
    positives = sum(y for _, y in ordered)
    best, at, tp = (0.0, math.inf), 0, 0
    while at < len(ordered):
        s = ordered[at][0]
        while at < len(ordered) and ordered[at][0] == s:
            tp += ordered[at][1]
            at += 1
        if s > 0:
            f1 = 2 * tp / (at + positives)
            below = ordered[at][0] if at < len(ordered) else 0.0
            if f1 > best[0]:
                best = (f1, (s + below) / 2)
    return best[1]


def _score_sample(sent):  # noqa: ANN001, ANN202
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([scorer.score(t)[0] for t in batch.column("text").to_pylist()], pa.float64()), batch.column("toxic")], names=["score", "toxic"])

    return score


def scores(docs: DataFrame, fitted: Fitted, name: str) -> DataFrame:
    """docs with a column ``name``: struct of score, hits, restored (hits in deobfuscated words) and toxic."""
    s = fitted.scorer
    sent = docs.sparkSession.sparkContext.broadcast((s.words, s.starts, s.model))  # lexicon of the bounded sample, model of fixed size
    threshold = fitted.threshold

    @F.pandas_udf("score double, hits int, restored int, toxic boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*sent.value)
        for texts in batches:
            got = [scorer.score(t) for t in texts]
            yield pd.DataFrame({"score": [x[0] for x in got], "hits": [x[1] for x in got], "restored": [x[2] for x in got], "toxic": [x[0] >= threshold for x in got]})

    # Else the filter and the columns beside it would each run it.
    return docs.withColumn(name, score.asNondeterministic()(F.col("text")))


def toxic_documents(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """One row per rejected document: ``doc_id, score, hits, restored``.

    Null and empty texts are never toxic. Repeated rows have a row each. Extra columns are
    ignored. See :func:`fit` for what happens without labels.
    """
    scored = scores(narrow(docs, "doc_id", "text"), fit(docs, labels, **options), "s")
    return scored.where("s.toxic").select("doc_id", "s.score", "s.hits", "s.restored")


def without_toxic(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The documents that aren't rejected, columns as they came; null texts stay."""
    name = unused(docs, "toxicity")
    return scores(docs, fit(docs, labels, **options), name).where(f"not {name}.toxic").select(*[F.col(f"`{x}`") for x in docs.columns])
