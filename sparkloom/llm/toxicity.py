"""Severity of toxicity by cumulative-link ordinal regression on sparse word features.

Grades are 0 to ``GRADES`` - 1.  One weight vector is shared by all thresholds:
``P(grade > k) = sigmoid(w . x - t_k)`` with ``t_0 < t_1 < ...``, so the expected
severity is the sum of these probabilities.

The labels only say toxic or not, so no grade above 0 is a judgement of people.  Grade 0
is "not toxic"; a toxic row is in grade 1, 2 or 3 as its share of marker words (those far
more common in toxic rows than in others) is in the lowest, middle or highest third of
the toxic rows of the sample.  Grades and expected severity thus tell how dense a text
is with such words, relative to the labelled toxic rows, and nothing beyond that; the
model sees the same words, so its fit to the grades proves little.  What can be judged
against the labels is ``toxic`` alone, P(grade > 0).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

GRADES = 4
#: Most labelled rows of each class that the model is fitted on, and most words that get a weight.
SAMPLE, VOCABULARY = 3000, 4000
#: Least log-likelihood ratio (G squared) of a word between the classes to be a feature.
CLEAR = 30.0
#: A document is toxic from this probability of a grade above 0.
TOXIC = 0.5
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Beginnings of words stand for inflected forms: ``stem*`` for these lengths.
STEMS = (4, 5)


def features(text: str) -> tuple[Counter, int]:
    """Counts of words and of longer words' beginnings, and the number of words."""
    found = words(text)
    counts = Counter(found)
    for w, n in list(counts.items()):
        for k in STEMS:
            if len(w) > k:
                counts[w[:k] + "*"] += n
    return counts, len(found)


def _strength(count, total):
    """Feature value: occurrences in a hundred words, five at most."""
    return np.minimum(100 * count / total, 5.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    """Word weights and ascending thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (4.0, 5.0, 6.0)

    def above(self, text: str) -> list[float]:
        """P(grade > k) for each threshold."""
        counts, total = features(text)
        known = sorted(self.weights.keys() & counts.keys())
        score = sum(self.weights[w] * _strength(counts[w], total) for w in known)
        return [round(float(_sigmoid(np.float64(score - t))), 6) for t in self.thresholds]


def fit_ordinal(doc: np.ndarray, word: np.ndarray, value: np.ndarray, grade: np.ndarray, n_words: int, weight: np.ndarray, steps: int = 1000, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model over sparse rows (doc, word, value), by Adam."""
    n = len(grade)
    w, gaps = np.zeros(n_words), np.concatenate(([1.0], np.zeros(GRADES - 2)))  # t_0, then log gaps
    target = (grade[:, None] > np.arange(GRADES - 1)[None, :]).astype(float)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, gaps)]
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:]))))
        score = np.bincount(doc, w[word] * value, n)
        # d/dscore of the likelihood of the cumulative links, all thresholds weighing alike
        error = (_sigmoid(score[:, None] - t[None, :]) - target) * weight[:, None]
        g_w = np.bincount(word, error.sum(1)[doc] * value, n_words) + l2 * w
        g_t = -error.sum(0)
        g_gaps = np.concatenate(([g_t.sum()], [g_t[k:].sum() * np.exp(gaps[k]) for k in range(1, GRADES - 1)]))
        rate = 0.05 * min(1.0, 2 * (1 - step / (steps + 1)))
        for x, g, (m, v) in zip((w, gaps), (g_w, g_gaps), state):
            m += 0.1 * (g - m)
            v += 0.03 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.97**step)) + 1e-9)
    return w, np.cumsum(np.concatenate((gaps[:1], np.exp(gaps[1:]))))


def _word_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, word, count, total) of (doc_id, toxic, text)."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, toxic, text in zip(batch.column("doc_id"), batch.column("toxic"), batch.column("text")):
                counts, total = features(text.as_py() or "")
                n = len(counts)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, batch.column("doc_id").type), pa.array([toxic.as_py()] * n, pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([total] * n, pa.int64())], names=["doc_id", "toxic", "word", "count", "total"])

    return rows.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, word string, count long, total long")


def fit(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str, label_col: str, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> OrdinalModel:
    """Fit on at most ``sample`` labelled documents of each class (lowest hashes of their ids).

    Rows without id, label or document are left out; several labels of one
    document count as the highest, of several texts of one id the one of least hash
    counts, of equal texts the one of least id: the same rows give the same model.  Without both classes the model calls nothing
    toxic.  The driver gets at most ``2 * sample`` rows' counts of at most ``vocabulary`` words.
    """
    given = pick(labels, doc_id=label_id, toxic=label_col).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in given.where("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return OrdinalModel()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = given.where("toxic = 0").orderBy(*order).limit(sample).union(given.where("toxic = 1").orderBy(*order).limit(sample))
    # at most 2 * sample short rows: small enough to send to every task
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    # copies would make features of their own words
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "toxic", "text")).alias("r")).select("doc_id", "r.*")
    rows = rows.groupBy("key", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("r")).select("toxic", "r.*")
    counts = _word_counts(rows).persist()
    taken = {r["toxic"]: r["n"] for r in counts.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if not (taken.get(0) and taken.get(1)):
        counts.unpersist()
        return OrdinalModel()
    n0, n1 = taken[0], taken[1]
    use = counts.groupBy("word").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("p"), F.count(F.when(F.col("toxic") == 0, 1)).alias("q")).where("p + q >= 3")
    odds = F.log((F.col("p") + 0.5) / (n1 + 1)) - F.log((F.col("q") + 0.5) / (n0 + 1))
    share, g = (F.col("p") + F.col("q")) / (n0 + n1), F.lit(0.0)
    for seen, size in (("p", n1), ("q", n0)):  # each word in the rows of a class or not, against the share in both
        for k, e in ((F.col(seen), share * size), (size - F.col(seen), (1 - share) * size)):
            g = g + F.when((k > 0) & (e > 0), 2 * k * F.log(k / e)).otherwise(0.0)
    best = use.select("word", "p", "q", odds.alias("odds"), F.round(g, 6).alias("g")).where(F.col("g") >= CLEAR).orderBy(F.desc("g"), "word").limit(vocabulary).toPandas().sort_values("word").reset_index(drop=True)
    index = counts.sparkSession.createDataFrame(best[["word"]].reset_index(), "i int, word string")
    data: pd.DataFrame = counts.join(F.broadcast(index), "word").select("doc_id", "toxic", "i", "count", "total").toPandas()
    every: pd.DataFrame = counts.select("doc_id", "toxic").distinct().toPandas()
    counts.unpersist()
    every = every.sort_values("doc_id").reset_index(drop=True)
    data = data.merge(every[["doc_id"]].reset_index().rename(columns={"index": "row"}), on="doc_id").sort_values(["row", "i"])
    row, col, n = data["row"].to_numpy(), data["i"].to_numpy(), len(every)
    value = _strength(data["count"].to_numpy(), data["total"].to_numpy())
    marker = (best["odds"] > np.log(8)).to_numpy()
    share = np.bincount(row, marker[col] * data["count"].to_numpy() / data["total"].to_numpy(), n)
    toxic = every["toxic"].to_numpy() == 1
    grade = np.zeros(n, int)
    if toxic.any():
        cuts = np.quantile(share[toxic], [1 / 3, 2 / 3])
        grade[toxic] = 1 + np.searchsorted(cuts, share[toxic], side="left")
    # the sample is balanced by class; weights restore the labels' proportions
    weight = np.where(toxic, sizes[1] / n1, sizes[0] / n0)
    w, t = fit_ordinal(row, col, value, grade, len(best), weight / weight.sum())
    return OrdinalModel({word: round(float(x), 6) for word, x in zip(best["word"], w) if abs(x) > 1e-4}, tuple(round(float(x), 6) for x in t))


def score(df: DataFrame, id_col: str, text_col: str, model: OrdinalModel) -> DataFrame:
    """Severity of every row, by its whole text.

    Columns: ``doc_id``, ``expected_severity`` (0 to 3), ``grade`` (the median
    one: thresholds passed with probability ``TOXIC`` or more), ``p_toxic`` = P(grade > 0), ``p_severe`` = P(grade > 1),
    ``p_extreme`` = P(grade > 2), ``toxic`` (``p_toxic`` >= ``TOXIC``).  Null and empty
    texts have no features; repeated rows are scored each; an empty table gives no
    rows.  The model (at most ``VOCABULARY`` words) is broadcast; no shuffle.
    """
    plain = pick(df, doc_id=id_col, text=text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            p = np.array([m.above(v.as_py() or "") for v in batch.column("text")]).reshape(-1, GRADES - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(1).round(6)), pa.array((p >= TOXIC).sum(1), pa.int32()), *[pa.array(p[:, k]) for k in range(GRADES - 1)], pa.array(p[:, 0] >= TOXIC)],
                names=["doc_id", "expected_severity", "grade", "p_toxic", "p_severe", "p_extreme", "toxic"],
            )

    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, expected_severity double, grade int, p_toxic double, p_severe double, p_extreme double, toxic boolean")


def drop_toxic(df: DataFrame, text_col: str, model: OrdinalModel) -> DataFrame:
    """The rows of ``df`` whose text isn't toxic, all columns as they were; only the text goes to Python."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([sent.value.above(t or "")[0] < TOXIC for t in text], dtype=bool)

    return df.where(clean(F.col(f"`{text_col}`")))
