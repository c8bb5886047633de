"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts whose label stays hidden are the unlabelled
ones. The risk estimator corrects the unlabelled part by the class prior and is kept from
going negative (Kiryo et al., 2017), so a flexible model cannot profit from the toxic texts
hidden among the unlabelled. The model is a linear one over words that stand out in the
positives; it is fitted in numpy on a bounded sample and applied to every whole text.
"""

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscript.llm.tables import staged, text_of

WORD = re.compile(r"\w+")
STEMS = (4, 5)


@dataclass(frozen=True)
class Fit:
    """Bounds and parameters of the fit. The two sample sizes bound what reaches the driver."""

    positives: int = 8_000
    unlabelled: int = 24_000
    features: int = 4_096
    least_positives: int = 8  # that must hold a word, or a quarter of them if that is fewer
    least_ratio: float = 2.5  # share of positives with the word over the share of unlabelled
    least_z: float = 5.0
    steps: int = 400
    rate: float = 0.1
    ridge: float = 3e-5
    slack: float = 0.0  # the negative part may fall this far below zero before the step is turned
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def scores(self, texts: list[str]) -> list[float]:
        known, weights, out = self.weights.keys(), self.weights, []
        for text in texts:
            z = self.bias + sum(weights[w] for w in sorted(known & features(text)))
            out.append(float(1 / (1 + np.exp(-z))))
        return out


def features(text: str) -> set[str]:
    """The words of a text, and the beginnings that inflected and compound words share."""
    words = set(WORD.findall(text.lower()))
    return words.union(*[{w[:n] + "-" for w in words if len(w) > n} for n in STEMS])


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def non_negative_fit(rows: np.ndarray, columns: np.ndarray, positive: np.ndarray, prior: float, width: int, fit: Fit) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss.

    ``rows`` and ``columns`` are the coordinates of ones, ``positive`` marks the confirmed rows.
    """
    n, n_pos = len(positive), int(positive.sum())
    share = np.where(positive, prior / n_pos, 0.0)
    hidden = np.where(positive, 0.0, 1.0 / (n - n_pos))
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, fit.steps + 1):
        z = theta[-1] + np.bincount(rows, theta[columns], n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss_negative = np.logaddexp(0, z)
        negative_part = (hidden - share) @ loss_negative
        up = share * (p - 1)  # gradient of the positives' risk as positives
        down = (hidden - share) * p  # gradient of the corrected risk of negatives
        slope = up + down if negative_part >= -fit.slack else -down
        gradient = np.append(np.bincount(columns, slope[rows], width), slope.sum()) + fit.ridge * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> tuple[DataFrame, float]:
    """Texts of the sampled label rows, and the share of toxic ones among the labelled."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = usable.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    order = [F.xxhash64("doc_id", F.lit("fit")), "doc_id"]
    positive = usable.filter("toxic = 1").orderBy(*order).limit(fit.positives).select("doc_id", F.lit(True).alias("_positive"))
    # Any labelled row may come here, toxic or not: its label is not looked at.
    hidden = usable.orderBy(F.xxhash64("doc_id", F.lit("hidden")), "doc_id").limit(fit.unlabelled).select("doc_id", F.lit(False).alias("_positive"))
    chosen = positive.unionByName(hidden)  # at most the two bounds
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id"), (toxic or 0) / total if total else 0.0


def _word_lists(sample: DataFrame) -> DataFrame:
    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], ["_positive", "_words"])

    return sample.select("_positive", "text").mapInArrow(split, "_positive boolean, _words array<string>")


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Fit on the labelled rows outside the held-out third. Without a confirmed toxic text no text is toxic."""
    sample, prior = _sample(docs, labels, fit)
    if not 0 < prior < 1:
        return Model({}, 40.0 if prior == 1 else -40.0)
    lists = staged(_word_lists(sample), "toxicity").withColumn("_row", F.monotonically_increasing_id())
    sizes = {r[0]: r[1] for r in lists.groupBy("_positive").count().collect()}
    n_pos, n_hidden = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_hidden:
        return Model({}, -40.0)
    counted = lists.select("_positive", F.explode("_words").alias("word")).groupBy("word").agg(
        F.count(F.when(F.col("_positive"), 1)).alias("a"), F.count(F.when(~F.col("_positive"), 1)).alias("b")
    )
    p, q = F.col("a") / n_pos, F.col("b") / n_hidden
    pooled = (F.col("a") + F.col("b")) / (n_pos + n_hidden)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_hidden) + 1e-12)
    least = min(fit.least_positives, max(1, n_pos // 4))
    telling = counted.filter((F.col("a") >= least) & (p >= fit.least_ratio * q) & (z >= fit.least_z))
    vocabulary = [r[0] for r in telling.orderBy(F.desc(z), "word").limit(fit.features).select("word").collect()]
    if not vocabulary:
        return Model({}, float(np.log(prior / (1 - prior))))
    number = {w: i for i, w in enumerate(vocabulary)}

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[w] for w in ws if w in number) for ws in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["_positive", "_found"])

    # One short list of word numbers per sampled text: the two bounds of the sample hold here too.
    rows = lists.select("_positive", "_words").mapInArrow(look_up, "_positive boolean, _found array<int>").collect()
    rows = sorted((r[0], list(r[1])) for r in rows)
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    columns = np.array([c for r in rows for c in r[1]], np.int64)
    weights, bias = non_negative_fit(at, columns, np.array([r[0] for r in rows]), prior, len(vocabulary), fit)
    return Model(dict(zip(vocabulary, weights.tolist())), bias)


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """held_out, score and predicted of every whole text; only the text enters a score.

    A null text counts as empty and gets the score of a text without a telling word. Null
    doc_ids are not held out. Repeated rows give repeated rows; an empty table an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(model.scores(batch.column(2).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    scored = rows.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    return score(docs, train(docs, labels, fit), fit.threshold)
