"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow gradient-boosted trees propose conjunctive rules (every path from a root), an L1-penalised
logistic regression weighs them and drops most, and what is left is compiled into one Spark
column expression over the statistics.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality_rules
from .linear import Sparse, fit_logistic, sigmoid

#: Bound of the labelled sample, taken in the order of a hash of the ids.
MAX_ROWS = 20_000
STATISTICS = (
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "unique_share", "top_word_share", "top3_share",
    "word_entropy", "digit_share", "upper_share", "punct_share", "line_words", "short_word_share", "capital_share", "no_letter_share", "max_word",
)
_DIGITS, _UPPER, _PUNCT = b"0123456789", bytes(range(65, 91)), b".,;:!?"
_SPACE, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _statistics(text: bytes) -> tuple[float, ...]:
    n, chars, symbols, again, repeat, lines, different = quality_rules._measure(text)
    if not n:
        return (0.0,) * len(STATISTICS)
    count = Counter(text.split())
    top = [c for _, c in count.most_common(3)]
    c = np.fromiter(count.values(), np.float64, len(count)) / n
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[raw].astype(np.int8), prepend=1, append=1))
    start, end = edge[::2], edge[1::2]  # of every word
    letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    length, head = end - start, raw[start]
    size = int(length.sum())
    has = lambda which: len(text) - len(text.translate(None, which))
    return (
        float(n), chars / n, symbols / n, again / lines, repeat / n, different / n, top[0] / n, sum(top) / n,
        float(-(c * np.log(c)).sum()) / math.log(n + 1), has(_DIGITS) / size, has(_UPPER) / size, has(_PUNCT) / size, n / lines,
        float((length <= 3).mean()), float(((head >= 65) & (head <= 90)).mean()), float((letters[end] == letters[start]).mean()), float(length.max()),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS doubles) of whole texts; null and empty texts have zeros."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([_statistics(t) for t in common.text_or_empty(batch.column(1))], np.float64).reshape(-1, len(STATISTICS))
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T.copy())], ["doc_id", *STATISTICS])

    return common.map_arrow(docs.select("doc_id", "text"), kernel, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A condition: (statistic, at most this threshold?, threshold). A rule: its conditions.
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], r: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: set[Rule], out: np.ndarray) -> None:
    """Split rows where the second-order gain is best; every node but the root is a rule."""
    if path:
        rules.add(path)
    best, total, weight = (1e-6, None, None), r[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 20:
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = bins[rows, f]
            g = np.cumsum(np.bincount(b, r[rows], len(e) + 1))[:-1]
            w = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            gain = g**2 / (w + 1) + (total - g) ** 2 / (weight - w + 1) - total**2 / (weight + 1)
            gain[(n < 5) | (len(rows) - n < 5)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        out[rows] += total / (weight + 1)
        return
    f, at = best[1:]
    left = bins[rows, f] <= at
    for side, keep in ((True, left), (False, ~left)):
        _grow(x, bins, edges, r, h, rows[keep], depth - 1, (*path, (f, side, float(edges[f][at]))), rules, out)


def _simplify(rule: Rule) -> Rule:
    """One bound per statistic and side."""
    best: dict[tuple[int, bool], float] = {}
    for f, low, t in rule:
        best[f, low] = t if (f, low) not in best else (min if low else max)(best[f, low], t)
    return tuple(sorted((f, low, t) for (f, low), t in best.items()))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, t in rule:
        out &= (x[:, f] <= t) if low else (x[:, f] > t)
    return out


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.bias + sum((w * _holds(r, x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x))))

    def column(self) -> Column:
        """The score as a Spark expression over STATISTICS."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            when = F.lit(True)
            for f, low, t in rule:
                c = F.col(STATISTICS[f])
                when = when & ((c <= t) if low else (c > t))
            z = z + F.when(when, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, l1: float = 1e-3) -> RuleEnsemble:
    """Rules from boosted trees, then lasso logistic weights. Rows of one label give a constant."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        return RuleEnsemble([], np.zeros(0), float(np.log(rate / (1 - rate))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: set[Rule] = set()
    draw = np.random.default_rng(5)
    for _ in range(trees):
        p = sigmoid(z)
        out = np.zeros(len(y))
        rows = draw.permutation(len(y))[: max(50, len(y) // 2)]
        found: set[Rule] = set()
        _grow(x, bins, edges, y - p, p * (1 - p), np.sort(rows), depth, (), found, out)
        rules |= {_simplify(r) for r in found}
        z[rows] += 0.3 * out[rows]
    listed = sorted(rules)
    held = np.stack([_holds(r, x) for r in listed], 1) if listed else np.zeros((len(y), 0), bool)
    rest = ~held.any(0) | held.all(0)
    listed, held = [r for r, skip in zip(listed, rest, strict=True) if not skip], held[:, ~rest]
    where, cols = np.nonzero(held)
    w, _, b = fit_logistic(Sparse(where, cols, held.shape), np.zeros((len(y), 0)), y.astype(float), l1=l1, steps=400)
    kept = np.abs(w) > 1e-9
    return RuleEnsemble([r for r, k in zip(listed, kept, strict=True) if k], w[kept], b)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, mod 3, is 1. A null id counts as no text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Learns from at most MAX_ROWS labelled rows outside the held-out fold. Null and empty texts are
    scored from zero statistics; repeated rows are scored each; labels with a null id or a null label
    are not used; without labels of both kinds the score is constant. Statistics are written once to the
    shared folder, so texts are read once.
    """
    stats = common.materialize(statistics(docs))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label_col)).cast("int").alias("y"))
    train = known.join(stats, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS).toArrow()
    x = np.stack([train.column(s).to_numpy() for s in STATISTICS], 1) if train.num_rows else np.zeros((0, len(STATISTICS)))
    model = fit(x, train.column("y").to_numpy().astype(np.int64))
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels outside the held-out fold; nulls, empty texts, ties and repeated rows as
    in score."""
    return score(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
