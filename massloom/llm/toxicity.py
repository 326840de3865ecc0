"""Toxicity by a classifier chain: categories are predicted in order, each linear model seeing the
probabilities of the earlier ones; the later models are trained on out-of-fold probabilities.

Features say that a word or a word beginning occurs, occurs often, or makes up much of the text, chosen on labelled
rows, for out-of-fold probabilities on the other folds' rows alone; and how long the text is. The labels only say toxic or
not, so the categories before the last one are kinds of toxic rows that the labels and the length give, not the
features: `brief` and `extended` (by the number of words) and `shoddy` (labelled of low quality too); the last link is
`toxic` itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .linear import Sparse, fit_logistic, sigmoid

CATEGORIES = ("brief", "extended", "shoddy", "toxic")
#: Words below which a text is brief; upper ends of the length features.
BRIEF, LENGTHS = 150, (10, 30, 100, 300, 1000, 3000)
#: Bound of the labelled sample: at most this many rows of each label, none of more bytes than that.
MAX_ROWS_PER_LABEL, MAX_ROW_BYTES = 2000, 1 << 16
#: Bound of the vocabulary.
MAX_FEATURES = 4096
#: Lengths, in bytes, of the word beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Levels of a mark: (name, least occurrences, least occurrences in 1000 words).
LEVELS = ((b"", 1, 0), (b"#2", 2, 0), (b"#3", 3, 0), (b"@10", 2, 10), (b"@30", 2, 30))
_STRIP = b".,;:!?\"'()[]{}*_"


@dataclass
class Chain:
    vocabulary: dict[bytes, int]
    weights: np.ndarray  # [category, feature]
    links: np.ndarray  # [category, earlier category]
    bias: np.ndarray  # [category]

    def predict(self, lists: list) -> np.ndarray:
        """Probabilities [row, category] for rows given as lists of features."""
        x = Sparse.of(lists, self.weights.shape[1])
        out = np.zeros((len(lists), len(self.bias)))
        for c in range(len(self.bias)):
            out[:, c] = sigmoid(x.dot(self.weights[c]) + out[:, :c] @ self.links[c, :c] + self.bias[c])
        return out


def _words(text: bytes) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(text.lower().split()).items():
        out[w.strip(_STRIP)] += n
    return out


def _marks(word: bytes) -> list[bytes]:
    """The marks of a word: itself, and its beginnings with a star."""
    return [word, *[word[:n] + b"*" for n in BEGINNINGS if len(word) > n]]


def _length(n: int) -> bytes:
    """The feature of a text's number of words; no word holds a space."""
    return b" %d" % sum(n >= k for k in LENGTHS)


def _features(words: Counter, memo: dict[bytes, tuple[bytes, ...]], vocabulary: dict[bytes, int], marks: set[bytes]) -> set[int]:
    """Features of a text given as counted words; memo holds which marks of a word are in the vocabulary."""
    counts: Counter = Counter()
    for w, n in words.items():
        got = memo.get(w)
        if got is None:
            got = tuple(m for m in _marks(w) if m in marks)
            if len(memo) < 500_000 and len(w) < 64:
                memo[w] = got
        for m in got:
            counts[m] += n
    total = sum(words.values())
    names = [m + name for m, c in counts.items() for name, least, rate in LEVELS if c >= least and 1000 * c >= rate * total]
    return {vocabulary[f] for f in (*names, _length(total)) if f in vocabulary}


def _hashed(words: Counter) -> np.ndarray:
    """All features of a text as sorted hashes, for choosing among very many."""
    hash_ = xxhash.xxh3_64_intdigest
    marks = np.fromiter((hash_(m) for w in words for m in _marks(w)), np.uint64)
    if not len(marks):
        return marks
    ids, of = np.unique(marks, return_inverse=True)
    count, total = np.bincount(of, [n for w, n in words.items() for _ in _marks(w)]), sum(words.values())
    held = [common.mix64(ids[(count >= least) & (1000 * count >= rate * total)] + np.uint64(k)) for k, (_, least, rate) in enumerate(LEVELS)]
    return np.sort(np.concatenate(held))


def _choose(rows: list[np.ndarray], y: np.ndarray, least_g2: float = 20.0) -> np.ndarray:
    """Hashes of the features that mark toxic rows: by the likelihood ratio, far beyond chance; the best first."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    every = np.concatenate([r for r, t in zip(rows, y, strict=True) if t])
    every.sort()
    ends = np.flatnonzero(np.r_[every[1:] != every[:-1], True])
    a = np.diff(ends, prepend=-1)
    mark, a = every[ends[a >= 6]], a[a >= 6].astype(float)  # fewer can't be beyond chance
    b = np.zeros(len(mark))
    for r, t in zip(rows, y, strict=True):
        if not t:
            b += np.isin(mark, r, assume_unique=True)
    e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    g2 = 2 * (a * np.log(a / np.maximum(e1, 1e-9)) + b * np.log(np.maximum(b, 1) / np.maximum(e0, 1e-9)))
    fit = np.flatnonzero((a * n0 > 3 * b * n1) & (g2 >= least_g2))
    return mark[fit[np.lexsort((mark[fit], -g2[fit]))][:MAX_FEATURES]]


def _named(chosen: np.ndarray, rows: Iterable[Counter]) -> dict[bytes, int]:
    """The chosen features by name, found again in the rows: a name's place is that of its hash."""
    place = {int(h): i for i, h in enumerate(chosen)}
    shift = [np.uint64(k) for k in range(len(LEVELS))]
    out: dict[bytes, int] = {}
    seen: set[bytes] = set()
    for words in rows:
        new = [m for w in words for m in _marks(w) if m not in seen]
        seen.update(new)
        ids = np.array([xxhash.xxh3_64_intdigest(m) for m in new], np.uint64)
        for (name, _, _), k in zip(LEVELS, shift, strict=True):
            hashed = common.mix64(ids + k)
            for i in np.flatnonzero(np.isin(hashed, chosen)).tolist():
                out[new[i] + name] = place[int(hashed[i])]
        if len(seen) > 200_000:  # forgotten marks are only looked up again
            seen.clear()
    return out


def _base(feature: bytes) -> bytes:
    for name, _, _ in LEVELS[1:]:
        if feature.endswith(name):
            return feature[: -len(name)]
    return feature


def fit(texts: list[bytes], y: np.ndarray, prior: float, shoddy: np.ndarray | None = None, folds: int = 4) -> Chain:
    """Fit the chain on labelled texts; prior is the share of toxic rows in the corpus's labels, shoddy says which rows are
    labelled of low quality."""
    if not len(y) or not 0 < y.sum() < len(y):  # nothing to tell apart: nothing is rejected
        k = len(CATEGORIES)
        return Chain({}, np.zeros((k, 0)), np.zeros((k, k)), np.full(k, -7.0))
    hashed, size = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):  # one text's words at a time: the driver's memory is small
        words = _words(t)
        hashed.append(_hashed(words))
        size[i] = sum(words.values())
    length = np.array([sum(n >= k for k in LENGTHS) for n in size.tolist()])
    low = np.zeros(len(y), bool) if shoddy is None else shoddy.astype(bool)
    targets = [y * (size < BRIEF), y * (size >= BRIEF), y * low, y]

    def table(chosen: np.ndarray) -> Sparse:
        order = np.argsort(chosen)
        lists = []
        for h, n in zip(hashed, length.tolist(), strict=True):
            at = np.searchsorted(chosen[order], h) if len(chosen) else np.zeros(0, np.int64)
            hit = at[chosen[order][np.minimum(at, len(chosen) - 1)] == h] if len(chosen) else at
            lists.append([*order[hit].tolist(), len(chosen) + n])
        return Sparse.of(lists, len(chosen) + len(LENGTHS) + 1)

    fold = np.arange(len(texts)) % folds
    held = np.zeros((len(texts), len(targets)))  # out-of-fold probabilities
    tables = [table(_choose([h for h, g in zip(hashed, fold, strict=True) if g != f], y[fold != f])) for f in range(folds)]
    chosen = _choose(hashed, y)
    x = table(chosen)
    weights, links, bias = np.zeros((len(targets), x.shape[1])), np.zeros((len(targets), len(targets))), np.zeros(len(targets))
    for c, t in enumerate(targets):
        t = t.astype(float)
        for f in range(folds):
            out, test = fold != f, fold == f
            w, v, b = fit_logistic(tables[f].take(out), held[out, :c], t[out], l2=1e-4)
            held[test, c] = sigmoid(tables[f].take(test).dot(w) + held[test, :c] @ v + b)
        w, v, b = fit_logistic(x, held[:, :c], t, l2=1e-4)
        weights[c], links[c, :c], bias[c] = w, v, b
    # the sample's share of toxic rows is not the corpus's
    bias[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    vocabulary = _named(chosen, (_words(w) for w, t in zip(texts, y, strict=True) if t)) | {b" %d" % k: len(chosen) + k for k in range(len(LENGTHS) + 1)}
    return Chain(vocabulary, weights, links, bias)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", quality_col: str = "quality") -> Chain:
    """Fit on at most MAX_ROWS_PER_LABEL labelled rows of each label, taken in the order of a hash of
    their ids; of these, texts of more than MAX_ROW_BYTES teach nothing (all texts are scored whole). Rows with a null id
    or label are not used; labels may lack the quality. Without rows of both labels nothing is rejected."""
    y = F.col(common.quoted(label_col))
    low = F.col(common.quoted(quality_col)) == 0 if quality_col in labels.columns else F.lit(False)
    known = labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1)).select("doc_id", y.cast("int").alias("y"), F.coalesce(low, F.lit(False)).alias("low"))
    n0, n1 = (known.agg(F.count_if(F.col("y") == v)).first()[0] for v in (0, 1))
    order = F.xxhash64("doc_id")
    some = known.where("y = 1").orderBy(order, "doc_id").limit(MAX_ROWS_PER_LABEL).union(known.where("y = 0").orderBy(order, "doc_id").limit(MAX_ROWS_PER_LABEL))
    # at most 2 * MAX_ROWS_PER_LABEL ids: their size is bounded, so they can be broadcast
    some = some.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("low").alias("low"))
    picked = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_ROW_BYTES).join(F.broadcast(some), "doc_id")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:  # the bounded sample's words
        words = [b" ".join(t.lower().split()) for t in common.text_or_empty(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), batch.column(2), batch.column(3)], ["doc_id", "words", "y", "low"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    words = common.map_arrow(picked.select("doc_id", "text", "y", "low"), kernel, f"doc_id {kind}, words binary, y int, low boolean")
    # one row per id, however often the id is repeated in docs
    got = words.groupBy("doc_id").agg(F.max("words").alias("words"), F.max("y").alias("y"), F.max("low").alias("low")).toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(np.int64)
    return fit(got.column("words").to_pylist(), y, prior=(n1 + 0.5) / (n0 + n1 + 1.0), shoddy=np.array(got.column("low").to_pylist(), bool))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Add p_<category> doubles and rejected (p_toxic >= 0.5) to docs(doc_id, text, ...).

    Null and empty texts have no marks and get the chain's probabilities of texts without words; repeated rows are
    scored each; an empty table gives no rows. Columns of docs may have any names; an added column whose name is taken
    has an underscore before it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"p_{c}" for c in CATEGORIES]
    names = [*docs.columns, *[common.unused(docs, c) for c in (*added, "rejected")]]
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("text")
    memo: dict[bytes, tuple[bytes, ...]] = {}
    marks: set[bytes] = set()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        chain = sent.value
        if not marks:
            marks.update(_base(m) for m in chain.vocabulary)
        lists = [list(_features(_words(t), memo, chain.vocabulary, marks)) for t in common.text_or_empty(batch.column(at))]
        p = chain.predict(lists)
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, c]) for c in range(p.shape[1])]], [*batch.schema.names, *added])

    kinds = T.StructType([*inner.schema.fields, *[T.StructField(a, T.DoubleType()) for a in added]])
    return common.map_arrow(inner, kernel, kinds).withColumn("rejected", F.col("p_toxic") >= 0.5).toDF(*names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the chain's probabilities and verdict; nulls, empty texts, ties and repeated rows as in score."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, common.table(spark, sf_dir, "labels"))
    out = score(docs, chain)
    return out.select("doc_id", *[f"p_{c}" for c in CATEGORIES], F.col("rejected").alias("toxic"), (~F.col("rejected")).alias("kept"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with their own columns, whatever their names."""
    out = score(docs, train(docs, labels))
    return out.where(~F.col(out.columns[-1])).select(*common.columns(docs))
