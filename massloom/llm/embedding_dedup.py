"""Embedding near-dedup by product quantisation.

Equal vectors are first merged into classes. A coarse quantiser gives each class a cell (an inverted
list) and the residual is coded by sub-space codebooks. Every class probes the cells whose border lies
within reach; inside a cell, asymmetric table-lookup distances to the codes, loosened by each code's own
error, leave the pairs whose cosine is then computed in double precision.
How far to probe is measured on the data: a bounded query set is compared with all vectors exactly, and the reach
covers the border distances of nearly all links found (no link needs more than the threshold's own distance, whatever
the data). A pair is found from either end and counted once, for both. Links leave a task as counts and as a
spanning forest, never as pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.9
#: Bounds of what is fitted on the driver and broadcast: sampled vectors, cells, codes per sub-space.
MAX_SAMPLE, MAX_CELLS, CODES = 32_768, 8192, 256
#: Sub-space width.
SUB = 4
#: Bound of the query set that measures the reach, the share of its links to be reached, and the least reach in standard
#: deviations of a displacement without direction; with fewer links than LEAST the widest one seen counts.
QUERIES, SHARE, SPREADS, LEAST = 2048, 0.999, 2.0, 500
#: Members and queries of a cell that one task compares, about.
BLOCK = 4096


@dataclass
class Index:
    cells: np.ndarray  # [cell, dim]
    books: list[np.ndarray]  # per sub-space: [code, width]
    splits: list[slice]
    radius: float
    reach: float  # a vector probes the cells whose border is nearer

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distances [vector, cell]."""
        return np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.cells.T + (self.cells**2).sum(1), 0)

    def borders(self, d: np.ndarray, own: np.ndarray) -> np.ndarray:
        """From squared distances, how far the border to each cell is: half way between it and the own cell."""
        home, norm = self.cells[own], (self.cells**2).sum(1)
        gaps = np.sqrt(np.maximum(norm[own][:, None] - 2 * home @ self.cells.T + norm, 1e-18))
        return (d - d[np.arange(len(d)), own][:, None]) / (2 * gaps)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest cell of each unit vector, and [vector, cell] whether to probe it."""
        d = self.squares(x)
        own = d.argmin(1)
        probe = self.borders(d, own) <= self.reach
        probe[np.arange(len(x)), own] = True
        return own, probe

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes [vector, sub-space] of the residuals, and the length of what they miss."""
        rest = x - self.cells[own]
        codes, miss = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, (s, book) in enumerate(zip(self.splits, self.books, strict=True)):
            r = rest[:, s]
            d = (r**2).sum(1)[:, None] - 2 * r @ book.T + (book**2).sum(1)
            codes[:, m] = d.argmin(1)
            miss += ((r - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(miss)

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances [query, member] to coded members of a cell, from lookup tables."""
        rest = x - self.cells[cell]
        out = np.zeros((len(x), len(codes)), np.float32)
        for m, (s, book) in enumerate(zip(self.splits, self.books, strict=True)):
            r = rest[:, s]
            tables = ((r**2).sum(1)[:, None] - 2 * r @ book.T + (book**2).sum(1)).astype(np.float32)
            out += tables[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    norm = (c**2).sum(1)
    return np.concatenate([(norm - 2 * x[i : i + 1024] @ c.T).argmin(1) for i in range(0, len(x), 1024)])


def _means(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int) -> np.ndarray:
    k = min(k, len(x))
    c = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, seed: int = 3) -> Index:
    """Index for about n unit vectors from a sample of them; its reach is the threshold's distance until it is measured."""
    draw = np.random.default_rng(seed)
    k = 2 ** round(math.log2(max(1.0, 8 * math.sqrt(n))))
    cells = _means(sample, min(k, MAX_CELLS, max(1, len(sample) // 4)), draw, 6)
    own = _nearest(sample, cells)
    rest = sample - cells[own]
    splits = [slice(i, min(i + SUB, sample.shape[1])) for i in range(0, sample.shape[1], SUB)]
    books = [_means(rest[:, s], CODES, draw, 6) for s in splits]
    radius = math.sqrt(2 - 2 * threshold)
    return Index(cells, books, splits, radius, radius)


def _classes(embeddings: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(usable rows, one row per different vector with its number of rows), both with a key. Components stay
    floats where they are, and are doubles otherwise."""
    col = F.col(common.quoted(vec_col))
    v = col if embeddings.schema[vec_col].dataType.simpleString() == "array<float>" else col.cast("array<double>")
    fine = col.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col(common.quoted(id_col)).alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return rows, common.materialize(classes.withColumn("key", F.monotonically_increasing_id()))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that squares stay finite."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1))[:, None]


def _flat(array: pa.Array) -> np.ndarray:
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


#: Steps in which border distances are counted, over the threshold's distance.
STEPS = 200


def _measured(classes: DataFrame, index: Index, queries: np.ndarray, names: np.ndarray, threshold: float) -> float:
    """The reach that covers SHARE of the links of the queries with all vectors; each link counts with the nearer border of
    its two ends. Tasks send STEPS counts."""
    home = index.squares(queries).argmin(1)
    sent = classes.sparkSession.sparkContext.broadcast((index, queries, names, home))

    def count(batches):
        index, x, names, home = sent.value
        n = np.zeros(STEPS + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                y = _unit(_flat(batch.column("v")))
                i, j = np.nonzero(y @ x.T >= threshold)
                other = batch.column("key").to_numpy()[i] != names[j]
                i, j = i[other], j[other]
                ys = np.unique(i)
                if not len(ys):
                    continue
                d = index.squares(y[ys])
                own = d.argmin(1)
                to = np.searchsorted(ys, i)
                far = index.borders(d, own)[to, home[j]]
                for lo in range(0, len(j), 1024):
                    q = j[lo : lo + 1024]
                    back = index.borders(index.squares(x[q]), home[q])[np.arange(len(q)), own[to[lo : lo + 1024]]]
                    far[lo : lo + 1024] = np.minimum(far[lo : lo + 1024], back)
                far[home[j] == own[to]] = 0
                n += np.bincount(np.clip(np.ceil(far / index.radius * STEPS), 0, STEPS).astype(np.int64), minlength=STEPS + 1)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n[k], pa.int64())], ["step", "n"])

    steps = np.zeros(STEPS + 1, np.int64)
    for step, n in classes.select("key", "v").mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n")).collect():
        steps[step] = n
    total = steps.sum()
    least = min(1.0, SPREADS / math.sqrt(queries.shape[1])) * index.radius
    if not total:
        return least
    share = SHARE if total >= LEAST else 1.0
    return max(least, min(1.0, (np.searchsorted(np.cumsum(steps), math.ceil(share * total)) + 1) / STEPS) * index.radius)


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """(key, n_links, root) partial results for the classes of one vector length, from each comparing task."""
    spark = classes.sparkSession
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("v"), "key").limit(MAX_SAMPLE).select("key", "v").toArrow()
    names, sample = sample.column("key").to_numpy(), _unit(_flat(sample.column("v")))
    fitted = fit(sample, n, threshold)
    fitted.reach = _measured(classes, fitted, sample[:QUERIES], names[:QUERIES], threshold)
    index = spark.sparkContext.broadcast(fitted)

    def place(batches):
        """A row for each class as a member of its cell, with the cells that it probes, and one for each of those."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                raw = np.ascontiguousarray(_flat(batch.column("v")))
                x = _unit(raw)
                own, probe = index.value.assign(x)
                codes, miss = index.value.encode(x, own)
                key, count = batch.column("key").to_numpy(), batch.column("n").to_numpy()
                q, cell = np.nonzero(probe)
                row = np.r_[np.arange(len(x)), q]
                member = np.r_[np.ones(len(x), bool), np.zeros(len(q), bool)]
                probed = np.split(cell.astype(np.int32), np.searchsorted(q, np.arange(1, len(x))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[own, cell].astype(np.int32)), pa.array(own[row].astype(np.int32)), pa.array(member), pa.array(key[row]), pa.array(count[row]),
                        pa.array([raw[i].tobytes() for i in row], pa.binary()),
                        pa.array([codes[i].tobytes() if m else None for i, m in zip(row, member, strict=True)], pa.binary()),
                        pa.array([probed[i].tobytes() if m else None for i, m in zip(row, member, strict=True)], pa.binary()),
                        pa.array(np.where(member, miss[row], 0.0)),
                    ],
                    ["cell", "home", "member", "key", "n", "v", "codes", "probed", "miss"],
                )

    placed = classes.select("key", "n", "v").mapInArrow(place, "cell int, home int, member boolean, key long, n long, v binary, codes binary, probed binary, miss double")
    # a cell of any size is compared block by block; the number of blocks is estimated from the sample, at most MAX_CELLS rows
    members, probes = np.zeros(len(fitted.cells)), np.zeros(len(fitted.cells))
    for at in range(0, len(sample), 1024):
        own, probe = fitted.assign(sample[at : at + 1024])
        members += np.bincount(own, minlength=len(members))
        probes += probe.sum(0)
    m, q = (np.ceil(c * n / len(sample) / BLOCK).astype(int) for c in (members, probes))
    large = [(int(c), int(max(m[c], 1)), int(max(q[c], 1))) for c in np.flatnonzero((m > 1) | (q > 1))]
    if large:
        blocks = F.broadcast(spark.createDataFrame(large, "cell int, m int, q int"))
        placed = placed.join(blocks, "cell", "left").fillna(1, ["m", "q"])
        mine = F.pmod(F.xxhash64("key"), F.when(F.col("member"), F.col("m")).otherwise(F.col("q"))).cast("int")
        placed = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("q")).otherwise(F.col("m")) - 1)))
        placed = placed.withColumn("mb", F.when(F.col("member"), F.col("mine")).otherwise(F.col("other"))).withColumn("qb", F.when(F.col("member"), F.col("other")).otherwise(F.col("mine"))).drop("mine", "other", "m", "q")
    else:
        placed = placed.withColumn("mb", F.lit(0)).withColumn("qb", F.lit(0))
    width, kind = sample.shape[1], np.float32 if classes.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def compare(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        member, home = table.column("member").to_numpy(), table.column("home").to_numpy()
        key, count = table.column("key").to_numpy(), table.column("n").to_numpy()
        blobs = table.column("v").to_pylist()
        vectors = lambda rows: _unit(np.frombuffer(b"".join([blobs[i] for i in rows]), kind).reshape(-1, width))
        ms, qs = np.flatnonzero(member), np.flatnonzero(~member)
        names, of = np.unique(key, return_inverse=True)  # a class may be both a member and a query
        links, forest, seen = np.zeros(len(names), np.int64), common.Union(len(names)), np.zeros(len(names), bool)
        if len(ms) and len(qs):
            y = vectors(ms)
            codes, probed = ([c[i] for i in ms] for c in (table.column("codes").to_pylist(), table.column("probed").to_pylist()))
            codes = np.frombuffer(b"".join(codes), np.uint8).reshape(len(ms), -1)
            # (member, cell that it probes) as one number
            pairs = np.repeat(np.arange(len(ms)), [len(p) // 4 for p in probed]) * MAX_CELLS + np.frombuffer(b"".join(probed), np.int32)
            limit = (index.value.radius + table.column("miss").to_numpy()[ms] + 1e-4).astype(np.float32)
            for at in range(0, len(qs), 256):
                part = qs[at : at + 256]
                x = vectors(part)
                near = index.value.distances(x, cell, codes) <= limit
                near &= key[part][:, None] != key[ms]
                a, b = np.nonzero(near)
                for lo in range(0, len(a), 1 << 14):
                    p, q = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
                    good = (x[p] * y[q]).sum(1) >= threshold
                    p, q = p[good], q[good]
                    # a pair that meets in both its cells counts in the smaller one, for both ends; inside a cell it
                    # meets twice, once for each end
                    inside = home[part[p]] == cell
                    here = inside | (home[part[p]] > cell) | ~np.isin(q * MAX_CELLS + home[part[p]], pairs)
                    i, j = of[part[p[here]]], of[ms[q[here]]]
                    np.add.at(links, i, count[ms[q[here]]])
                    outer = ~inside[here]
                    np.add.at(links, j[outer], count[part[p[here]]][outer])
                    seen[i] = seen[j] = True
                    roots = np.array([forest.root(r) for r in np.unique(np.r_[i, j])])
                    at_root = np.zeros(len(names), np.int64)
                    at_root[np.unique(np.r_[i, j])] = roots
                    apart = np.unique(np.stack([at_root[i], at_root[j]], 1)[at_root[i] != at_root[j]], axis=0)
                    for r, s in apart.tolist():
                        forest.join(r, s)
        rows = np.flatnonzero(seen)
        return pa.table({"key": pa.array(names[rows]), "n_links": pa.array(links[rows]), "root": pa.array(names[[forest.root(r) for r in rows.tolist()]] if len(rows) else rows)})

    return placed.groupBy("cell", "mb", "qb").applyInArrow(compare, "key long, n_links long, root long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of embeddings: vec_id, n_links (other rows linked directly), component_id (smallest
    vec_id reachable), kept (vec_id = component_id).

    Null and zero vectors and those with null or non-finite components link with nothing, nor do
    vectors of different lengths. Repeated rows are vectors of their own, linked with each other; a null vec_id stays
    null and is never a component's id if there is another; an empty table gives no rows; other columns are ignored.
    The index is fitted on at most MAX_SAMPLE different vectors, and its reach on the links of QUERIES of them with all;
    every vector is indexed.
    """
    rows, classes = _classes(embeddings, id_col, vec_col)
    sizes = [r[0] for r in classes.select(F.size("v").alias("s")).distinct().collect()]  # usually one
    parts = [_links(classes.where(F.size("v") == s), threshold) for s in sorted(sizes)]
    if not parts:
        none = F.lit(None).cast(rows.schema["vec_id"].dataType)
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("vec_id", none).alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = common.materialize(found)
    counts = found.groupBy("key").agg(F.sum("n_links").alias("links"))
    comp = common.components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    each = classes.join(counts, "key", "left").join(comp, "key", "left").withColumn("component", F.coalesce("component", "key"))
    each = common.materialize(each.select("v", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    names = each.groupBy("component").agg(F.min("least").alias("component_id"))
    each = each.join(names, "component").select("v", "n_links", "component_id")
    linked = rows.where("v is not null").join(each, "v").select("vec_id", "n_links", "component_id")
    lone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all embeddings; nulls, zero and non-finite vectors, ties and repeated rows as there."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(a, c) AS (SELECT a, a FROM l UNION SELECT l.a, r.c FROM l JOIN r ON l.b = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(m.c, e.vec_id) AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id"""
