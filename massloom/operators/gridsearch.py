"""Scores of all spectra that are asked with all spectra of one grid: blocks of rows meet chunks of queries in numpy, so a task
holds one block, one chunk and a tile of scores, whatever the tables' sizes. The pairs themselves are the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, queries of a chunk, about; rows of a tile and pairs of a batch that leaves the task.
BLOCK, CHUNK, TILE, BATCH = 4096, 1024, 512, 1 << 18


def cosine(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, None]:
    norm = np.sqrt(np.einsum("ik,ik->i", q, q)[:, None] * np.einsum("ik,ik->i", y, y))
    with np.errstate(all="ignore"):
        return np.where(norm > 0, q @ y.T / norm, np.nan), None


def _shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intensities as shares, and their entropies; not a number where there is no intensity."""
    total = x.sum(1, keepdims=True)
    with np.errstate(all="ignore"):
        p = np.where(total > 0, x / total, np.nan)
    return p, -(p * np.log(np.maximum(p, 1e-300))).sum(1)


def entropy(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, None]:
    (p, hp), (r, hr) = _shares(q), _shares(y)
    mixed, m, log = np.empty((len(q), len(y))), np.empty_like(r), np.empty_like(r)
    for i, row in enumerate(p):
        np.add(r, row, out=m)
        np.multiply(m, 0.5, out=m)
        np.maximum(m, 1e-300, out=m)
        np.log(m, out=log)
        mixed[i] = -np.einsum("ik,ik->i", m, log)
    mixed[np.isnan(hp)] = np.nan
    mixed[:, np.isnan(hr)] = np.nan
    return 1 - (2 * mixed - hp[:, None] - hr) / np.log(4), None


def adjacent_assignment(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosine of the best assignment, matched peaks) where a peak may match in its own bin and in both bins next to it. Walks
    the bins once: what lies behind bin i matters only by whether its two peaks are taken from before."""
    unit = lambda x: x / np.where((n := np.sqrt((x**2).sum(1, keepdims=True))) > 0, n, 1)
    a, b = unit(q), unit(y)
    shape, width = (len(q), len(y)), a.shape[1]
    free, right, left, both = np.zeros(shape), np.full(shape, -1.0), np.full(shape, -1.0), np.full(shape, -1.0)
    n_free, n_right, n_left, n_both = (np.zeros(shape, np.int16) for _ in range(4))
    dense = bool((a > 0).all() and (b > 0).all())
    for i in range(width):
        own = a[:, i, None] * b[:, i]
        one = 1 if dense else (own > 0).astype(np.int16)
        best, n = free + own, n_free + one
        for s, c in ((right, n_right), (left, n_left), (both, n_both)):
            better = s > best
            best, n = np.maximum(best, s), np.where(better, c, n)
        if i + 1 < width:
            r, l = a[:, i, None] * b[:, i + 1], a[:, i + 1, None] * b[:, i]
            nr, nl = (1, 1) if dense else ((r > 0).astype(np.int16), (l > 0).astype(np.int16))
            # right: b's next peak is taken, left: a's next one is
            from_right, from_left = right > free, left > free
            new = np.maximum(free, right) + r, np.maximum(free, left) + l, free + r + l
            counts = np.where(from_right, n_right, n_free) + nr, np.where(from_left, n_left, n_free) + nl, n_free + nr + nl
            (right, left, both), (n_right, n_left, n_both) = new, counts
        free, n_free = best, n
    return np.minimum(free, 1.0), n_free


METHODS = {"cosine": cosine, "entropy": entropy, "hungarian": adjacent_assignment}


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Arrays of numbers; None where one is null or holds a null."""
    return [None if v is None or any(x is None for x in v) else np.asarray(v, float) for v in column.to_pylist()] if column.null_count or column.flatten().null_count else _split(column)


def _split(column: pa.Array) -> list[np.ndarray]:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return list(flat.reshape(len(sizes), int(sizes[0])))
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def search(spectra: DataFrame, asked: Column, method: str, digits: int) -> DataFrame:
    """(id, lib_id, score, n_matched) of the spectra(id, x: intensities on one grid) where `asked` holds with all spectra; scores
    are rounded half up, n_matched is null but for `hungarian`. A spectrum without intensity has no score by cosine and entropy
    and 0 by assignment; neither has one that is null or holds nulls, nor have two of different lengths."""
    f, kind = METHODS[method], spectra.schema["id"].dataType.simpleString()
    n, m = spectra.agg(F.count("*"), F.count_if(asked)).first()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-m // CHUNK))
    place = lambda k, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rows = spectra.select("id", "x", F.lit(False).alias("asks"), place(blocks, 1).alias("block"), every(chunks).alias("chunk"))
    queries = spectra.where(asked).select("id", "x", F.lit(True).alias("asks"), every(blocks).alias("block"), place(chunks, 2).alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bool, list] = {True: [], False: []}
        held: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            vectors = _vectors(batch.column("x"))
            for side in (True, False):
                at = np.flatnonzero(asks == side)
                ids[side].append(batch.column("id").take(pa.array(at)))
                held[side] += [vectors[k] for k in at]
        if not held[True] or not held[False]:
            return
        names = {side: pa.concat_arrays(ids[side]) for side in ids}
        lengths = {side: np.array([-1 if v is None else len(v) for v in held[side]]) for side in held}
        for lq in np.unique(lengths[True]):
            mine = np.flatnonzero(lengths[True] == lq)
            for ly in np.unique(lengths[False]):
                other = np.flatnonzero(lengths[False] == ly)
                same = lq == ly and lq > 0
                q = np.stack([held[True][k] for k in mine]) if same else None
                for lo in range(0, len(other), TILE):
                    tile = other[lo : lo + TILE]
                    y = np.stack([held[False][k] for k in tile]) if same else None
                    step = max(1, BATCH // len(tile)) if method != "hungarian" else 64
                    for first in range(0, len(mine), step):
                        part = mine[first : first + step]
                        score, n_matched = f(q[first : first + step], y) if same else (np.full((len(part), len(tile)), np.nan), None)
                        score = (np.floor(score * 10**digits + 0.5) / 10**digits).ravel()
                        count = pa.nulls(len(score), pa.int32()) if n_matched is None else pa.array(n_matched.ravel().astype(np.int32))
                        left = names[True].take(pa.array(np.repeat(part, len(tile))))
                        right = names[False].take(pa.array(np.tile(tile, len(part))))
                        yield pa.RecordBatch.from_arrays([left, right, pa.array(score, mask=np.isnan(score)), count], ["id", "lib_id", "score", "n_matched"])

    # a number of partitions that isn't lowered: the input is small, the work isn't
    dealt = rows.union(queries).repartition(min(4 * blocks * chunks, 4096), "block", "chunk")
    return dealt.groupBy("block", "chunk").applyInArrow(run, f"id {kind}, lib_id {kind}, score double, n_matched int")
