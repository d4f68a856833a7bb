"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Grades 0 < 1 < ... < K share one weight vector: P(grade >= k) = sigmoid(w.x - theta_k) with
ascending thresholds.  The expected severity is the sum of these over k.  Features are
log(1 + count) of lower-cased words and of their beginnings, chosen on the labelled sample.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fit sees at most this many labelled rows of either label: those of the smallest id hash.
SAMPLE_PER_LABEL = 6_000
#: Words that serve as features, at most: those that differ most between the two labels.
MAX_FEATURES = 4_000
#: A feature's share of the toxic documents is larger than that of the others by this much and
#: by this many standard errors, and the others' share is at most this part of it.
MIN_GAP, MIN_ERRORS, MAX_CLEAN = 0.02, 5.0, 0.1
#: Grades above 0; toxic rows of the sample are graded by how many of the words that tell them
#: from the others they hold, cut at the quantiles.
GRADES = 3
#: A document is toxic if P(grade >= 1) reaches this.
THRESHOLD = 0.5

#: Bytes to lower case; ASCII marks and digits to spaces; bytes of other letters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Besides a whole word, its first letters are features, in these lengths.
PREFIXES = (3, 4, 5, 6)
#: The memo of words without any chosen feature and with some is emptied at this many.
MEMO_WORDS = 500_000


def word_counts(text: bytes) -> Counter:
    """Words of a UTF-8 text, lower-cased and without ASCII marks, with their counts."""
    return Counter(text.translate(_FOLD).split())


def features_of(word: bytes) -> list[str]:
    """A word's features: itself, and its beginnings, which a language's stems share."""
    letters = word.decode("utf-8", "replace")
    return [f"={letters}", *(f"{letters[:k]}-" for k in PREFIXES if len(letters) > k)]


def feature_counts(text: bytes, among: set[str]) -> Counter:
    """Those of a text's features that are in ``among``, with their counts."""
    found: Counter = Counter()
    for word, n in word_counts(text).items():
        for f in features_of(word):
            if f in among:
                found[f] += n
    return found


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature, ascending thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def scorer(self) -> Callable[[bytes], np.ndarray]:
        """A function of a text to P(grade >= k) for k = 1 to K."""
        weights, thresholds = self.weights, np.array(self.thresholds)
        memo: dict[bytes, list[str]] = {}

        def probabilities(text: bytes) -> np.ndarray:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            found: Counter = Counter()
            for word, n in word_counts(text).items():
                known = memo.get(word)
                if known is None:
                    known = memo[word] = [f for f in features_of(word) if f in weights]
                for f in known:
                    found[f] += n
            z = sum(weights[f] * math.log1p(n) for f, n in sorted(found.items()))
            return 1 / (1 + np.exp(np.clip(thresholds - z, -500, 500)))

        return probabilities

    def to_json(self) -> str:
        return json.dumps({"weights": self.weights, "thresholds": self.thresholds})

    @staticmethod
    def from_json(told: str) -> OrdinalModel:
        x = json.loads(told)
        return OrdinalModel(x["weights"], tuple(x["thresholds"]))


def first_of_copies(texts: list[bytes]) -> list[int]:
    """Indices of the rows that aren't near copies of an earlier one.

    Copies share at least half of the 8 smallest hashes of their 3-word shingles.
    """
    by_hash: dict[int, list[int]] = {}
    kept = []
    for i, text in enumerate(texts):
        words = text.translate(_FOLD).split()
        least = sorted({zlib.crc32(b" ".join(x)) for x in zip(words, words[1:], words[2:])} or {zlib.crc32(b" ".join(words))})[:8]
        shared = Counter(j for h in least for j in by_hash.get(h, ()))
        if shared and 2 * shared.most_common(1)[0][1] >= len(least):
            continue
        kept.append(i)
        for h in least:
            by_hash.setdefault(h, []).append(i)
    return kept


def choose_features(texts: list[bytes], toxic: np.ndarray, limit: int = MAX_FEATURES) -> list[tuple[str, float]]:
    """Features that toxic documents hold more often, strongest first, and by how much."""
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    of_toxic: Counter = Counter()
    for text, y in zip(texts, toxic):
        if y:
            of_toxic.update({f for w in word_counts(text) for f in features_of(w)})
    able = {f for f, n in of_toxic.items() if n >= max(MIN_GAP * n1, 2)}
    of_clean: Counter = Counter()
    for text, y in zip(texts, toxic):
        if not y:
            of_clean.update({f for w in word_counts(text) for f in features_of(w)} & able)
    scored = []
    for f in able:
        a, b = of_toxic[f], of_clean[f]
        gap, pooled = a / n1 - b / n0, (a + b + 1) / (n1 + n0 + 2)
        errors = gap / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
        if gap >= MIN_GAP and errors >= MIN_ERRORS and b / n0 <= MAX_CLEAN * a / n1:
            scored.append((errors, f, gap))
    scored.sort(key=lambda x: (-x[0], x[1]))
    return [(f, gap) for _, f, gap in scored[:limit]]


def grade(texts: list[bytes], toxic: np.ndarray, features: list[tuple[str, float]], grades: int = GRADES) -> np.ndarray:
    """0 for rows that aren't toxic; the others by how many words with a telling feature they
    hold, cut at the quantiles, equal numbers together."""
    telling = {w for w, gap in features if gap > 0}
    told = np.array([sum(n for w, n in word_counts(t).items() if not telling.isdisjoint(features_of(w))) if y else 0 for t, y in zip(texts, toxic)], int)
    of_toxic = told[toxic == 1]
    if not len(of_toxic):
        return np.zeros(len(texts), int)
    cuts = np.quantile(of_toxic, np.arange(1, grades) / grades)
    return np.where(toxic == 1, 1 + (told[:, None] > cuts[None, :]).sum(1), 0)


def fit(counts: list[Counter], grades: np.ndarray, words: list[str], n_grades: int = GRADES, steps: int = 3000, l2: float = 1e-4, rate: float = 0.05) -> OrdinalModel:
    """Minimise the weighted negative log likelihood of all threshold decisions by Adam.

    The decisions grade >= k share the weights; each label counts for half of the loss.
    """
    number = {w: j for j, w in enumerate(words)}
    rows, cols, values = [], [], []
    for i, c in enumerate(counts):
        for w in c.keys() & number.keys():
            rows.append(i)
            cols.append(number[w])
            values.append(np.log1p(c[w]))
    rows, cols, values = np.array(rows, int), np.array(cols, int), np.array(values, float)
    n = len(counts)
    above = grades[:, None] >= np.arange(1, n_grades + 1)[None, :]
    positive = max(int(above[:, 0].sum()), 1)
    weight = np.where(above[:, :1], 0.5 / positive, 0.5 / max(n - positive, 1))
    w, base, gaps = np.zeros(len(words)), np.array([1.0]), np.zeros(n_grades - 1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, base, gaps)]
    for t in range(1, steps + 1):
        theta = base[0] + np.r_[0, np.cumsum(np.exp(gaps))]
        z = np.bincount(rows, weights=values * w[cols], minlength=n)
        error = (1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -50, 50))) - above) * weight
        of_theta = -error.sum(0)
        tail = np.cumsum(of_theta[::-1])[::-1]
        slopes = (np.bincount(cols, weights=values * error.sum(1)[rows], minlength=len(words)) + l2 * w, np.array([of_theta.sum()]), tail[1:] * np.exp(gaps))
        for p, g, (m, v) in zip((w, base, gaps), slopes, state):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = base[0] + np.r_[0, np.cumsum(np.exp(gaps))]
    return OrdinalModel(dict(zip(words, w.tolist())), tuple(theta.tolist()))


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((str(i), int(y), t) for b in batches for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3))))
    texts = [(t or "").encode() for _, _, t in rows]
    own = first_of_copies(texts)
    texts, toxic = [texts[i] for i in own], np.array([rows[i][1] for i in own], int)
    features = choose_features(texts, toxic)
    chosen = {f for f, _ in features}
    model = fit([feature_counts(t, chosen) for t in texts], grade(texts, toxic, features), [f for f, _ in features])
    yield pa.RecordBatch.from_arrays([pa.array([model.to_json()])], ["model"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """Fit on the labelled sample in one task; the sample's size is bounded by SAMPLE_PER_LABEL.

    An id labelled twice counts as toxic if one label says so; of rows that repeat an id the least
    text is read.  Null ids and other labels are left out; without any label nothing is toxic.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter("_id IS NOT NULL AND y IN (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    of = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_LABEL)
    sample = F.broadcast(of(0).unionByName(of(1)))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(sample, "_id")
    one = texts.groupBy("_id", "y").agg(F.min("text").alias("text"))
    told = one.select("_id", "text", "y").repartition(1).mapInArrow(_fit_sample, "model string").collect()
    return OrdinalModel.from_json(told[0]["model"]) if told else OrdinalModel({}, tuple(float(9 + k) for k in range(GRADES)))


def _scorer(model: OrdinalModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            p = np.array([of(t.as_py() or b"") for t in texts]).reshape(len(texts), len(model.thresholds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1))], ["doc_id", "p_toxic", "expected_severity", "grade"])

    return score


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, p_toxic, expected_severity, grade, toxic`` of every row's whole text.

    A null or empty text has no features, and gets the grade that the thresholds alone give.
    Rows that repeat give rows that repeat; an empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_scorer(model), "doc_id long, p_toxic double, expected_severity double, grade long")
    return scored.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all columns; nothing shuffles.

    A null or empty text stays unless the thresholds alone call it toxic; rows that repeat are
    told alike, an id isn't looked at, and a very long text is read whole.
    """
    column = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            texts = batch.column(column).cast(pa.binary())
            yield batch.filter(pa.array([bool(of(t.as_py() or b"")[0] < THRESHOLD) for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
