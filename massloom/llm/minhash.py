"""MinHash near-dedup with bottom-k sketches from one hash function.

A document is its set of word shingles, each hashed once to 64 bits; equal sets form classes.
 1. A count sketch of bounded size (one row, never too low) tells roughly how many documents hold a
    value, and so puts every value into a frequency tier, the same for all documents: tier 0 is below what the
    sketch can tell apart, each further tier doubles.
 2. A class retains its first values in the order (tier, hash): as many as are needed for two sets of the asked
    similarity to share one (a fifth of the set at 0.8), all of them. Inverted lists of the retained values generate
    overlaps. Two sets can be alike only if they share enough retained values, so overlaps are counted over
    the lists of up to SHORT members, and pairs with too few of them are dropped; this is exact for pairs that
    share no longer list. A longer list first ties its members along their sizes.
 3. The smallest SKETCH hashes of both sets of a pair, merged, estimate the Jaccard similarity; pairs well
    below the threshold are dropped. What is left ties classes into loose groups. Then the longer lists, of any
    length, are compared in full wherever they hold more than one loose group, block by block, so no pair is left
    out by its values' frequency; that work grows with the square of a list of unlike sets.
 4. Inside a loose group full sets are compared exactly, block by block; a task returns a spanning forest
    of the links it found. Components of the forests are the groups of near copies.
The estimate's filter is set far below the threshold (six standard deviations at its size of sketch).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, PERCENT = 5, 80
SKETCH = 64
#: Pairs estimated below this are not tied together (loose on purpose: groups are compared exactly).
LOOSE = 0.5
#: Lists of up to SHORT members give all their pairs at once, longer ones ties first and the rest block by block.
SHORT = 32
#: A value held by more documents than this is dealt to several tasks; sizes of compared blocks and of bins of small groups.
LIST, BLOCK, BIN = 4096, 1024, 2048
#: Bounds of the count sketch: counters (a byte each once it is broadcast).
MIN_COUNTERS, MAX_COUNTERS, CHUNK = 1 << 16, 1 << 24, 1 << 16


def _row() -> Column:
    """A row's name: rows equal in id and text share it."""
    return F.xxhash64("doc_id", "text")


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: windows of n words of the text with A-Z lower-cased;
    with fewer words the whole sequence is one shingle; without words there is none."""
    words = [t.lower().split() for t in texts]
    hashes = common.hash_words([w for ws in words for w in ws])
    grams = common.hash_grams(hashes, n)
    out, at = [], 0
    for ws in words:
        if len(ws) >= n:
            out.append(np.unique(grams[at : at + len(ws) - n + 1]))
        elif ws:
            short = np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=len(ws))], np.uint64)
            out.append(common.mix64(short))
        else:
            out.append(grams[:0])
        at += len(ws)
    return out


def _set_id(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def _place(values: np.ndarray, counters: int) -> np.ndarray:
    return (values >> np.uint64(64 - counters.bit_length() + 1)).astype(np.int64)


def _scan(docs: DataFrame, n: int, counters: int) -> DataFrame:
    """(doc_id, rid, n_shingles, set_id) of every document, and each task's counts of values as (chunk, counts). rid is
    a hash of id and text, by which a row is found again."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "rid", "n_shingles", "set_id", "chunk", "counts"]

    def run(batches):
        counts, id_type = np.zeros(counters, np.uint32), None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                id_type = batch.column(0).type
                sets = shingle_sets(common.text_or_empty(batch.column(1)), n)
                for s in sets:
                    np.add.at(counts, _place(s, counters), np.uint32(1))
                k = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_id(s) for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        if id_type is not None:
            small = np.minimum(counts, 65_535).astype("<u2").reshape(-1, CHUNK)
            rows = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(small) if c.any()]
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names)

    return docs.select("doc_id", "text", _row().alias("rid")).mapInArrow(run, f"doc_id {kind}, rid long, n_shingles long, set_id binary, chunk int, counts binary")


def _tiers(scanned: DataFrame, counters: int) -> tuple[np.ndarray, int]:
    """(a byte per counter, floor): tier 0 below the floor, twice the counters' mean load, else 1 + log2 of count / floor.
    The counters are merged by chunk on the executors; at most MAX_COUNTERS bytes come to the driver."""

    total = scanned.where("chunk is null").agg(F.sum("n_shingles")).first()[0] or 0
    floor = max(2, -(-2 * total // counters))

    def merge(batches):
        # partial sums per task, so that a chunk's counts meet in few rows
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(blob), "<u2")
                sums[c] = sums[c] + got if c in sums else got.astype(np.uint64)
        for c, total in sums.items():
            tier = np.where(total < floor, 0, 1 + np.floor(np.log2(np.maximum(total / floor, 1)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(tier.tobytes(), 1)], pa.binary())], ["chunk", "tiers"])

    chunks = scanned.where("chunk is not null").select("chunk", "counts").repartition(min(256, counters // CHUNK), "chunk")
    tiers = np.zeros(counters, np.uint8)
    for row in chunks.mapInArrow(merge, "chunk int, tiers binary").collect():
        tiers[row[0] * CHUNK : (row[0] + 1) * CHUNK] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return tiers, floor


def retained(values: np.ndarray, tier: np.ndarray, percent: int) -> np.ndarray:
    """Indices of a set's first values in the order (tier, hash), among which any other set of the asked similarity has one;
    none if no other set can be that similar."""
    n = len(values)
    if 100 * n < percent * (n + 1):
        return np.zeros(0, np.int64)
    return np.argsort(tier, kind="stable")[: n - (-(-percent * n // 100)) + 1]  # values are sorted: hashes rise inside a tier


def _sketches(docs: DataFrame, n: int, percent: int, tiers) -> DataFrame:
    """(set_id, n, prefix, part, sketch) of each different set. prefix: the retained values in their order; part: the parts
    of their lists to which the set is dealt, -1 for lists that one task can hold (null: all are such)."""
    names = ["set_id", "n", "prefix", "part", "sketch"]

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                rows = []
                for s in shingle_sets(common.text_or_empty(whole.column(0).slice(at, 1024)), n):
                    sid = _set_id(s)
                    if sid is None or sid in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(sid)
                    by, floor = tiers.value
                    tier = by[_place(s, len(by))]
                    first = retained(s, tier, percent)
                    low = floor * (1 << np.maximum(tier[first].astype(np.int64) - 1, 0))  # held by about as many or more
                    part = None
                    if (many := (tier[first] > 0) & (low > LIST)).any():
                        own = common.mix64(s[first] ^ np.uint64(int.from_bytes(sid[:8], "little")))
                        part = np.where(many, (own % np.maximum(2 * low // LIST, 1).astype(np.uint64)).astype(np.int64), -1)
                    rows.append((sid, len(s), s[first].astype(np.int64), part, s[:SKETCH].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names)

    return docs.select("text").mapInArrow(run, "set_id binary, n long, prefix array<long>, part array<long>, sketch binary")


def _ordered(a: np.ndarray, b: np.ndarray, na, nb) -> tuple:
    """Pairs with the smaller key first."""
    swap = a > b
    return np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)


def list_pairs(key: np.ndarray, n: np.ndarray, starts: np.ndarray, size: np.ndarray, percent: int) -> list[tuple]:
    """All pairs (a, b, na, nb) of the lists at starts, whose members are in the order of their sizes n, but for
    those whose sizes rule the similarity out."""
    out = []
    for k in np.unique(size):
        at = starts[size == k]
        p, q = np.triu_indices(k, 1)
        p, q = (at[:, None] + p).ravel(), (at[:, None] + q).ravel()
        fit = n[p] * 100 >= n[q] * percent
        out.append(_ordered(key[p[fit]], key[q[fit]], n[p[fit]], n[q[fit]]))
    return out


def _lists(sketches: DataFrame, percent: int) -> DataFrame:
    """What the inverted lists tell, as rows (a, b, na, nb, v, pos): a pair of a short list with its sizes, once for each list
    that it shares; a pair of neighbours in a longer list, without sizes; a member a of a longer list v, without b.
    The lists stream through their tasks in order, so a list of any length is never held."""
    part = F.coalesce(F.element_at("part", (F.col("pos") + 1).cast("int")), F.lit(-1))
    posted = sketches.select("key", F.col("n").cast("int").alias("n"), "part", F.posexplode("prefix").alias("pos", "v")).select("v", part.alias("part"), "key", "n", "pos")
    names = ["a", "b", "na", "nb", "v", "pos"]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())

    def rows(*columns) -> pa.RecordBatch:
        k = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(k, t) if c is None else pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds, strict=True)], names)

    def long_rows(x: list[np.ndarray], lo: int, hi: int, before: tuple | None):
        """Rows of x[lo:hi], a stretch of one longer list; before: first and last key and sizes of what went before."""
        v, _, key, n, pos = (c[lo:hi] for c in x)
        head = (key[0], n[0]) if before is None else before[0]
        k, m = (key, n) if before is None else (np.r_[before[1][0], key], np.r_[before[1][1], n])
        for p, q, np_, nq in ((k[:-1], k[1:], m[:-1], m[1:]), (np.full(len(key), head[0]), key, np.full(len(key), head[1]), n)):
            fit = (np_ * 100 >= nq * percent) & (p != q)
            a, b, _, _ = _ordered(p[fit], q[fit], np_[fit], nq[fit])
            yield rows(a, b, None, None, None, None)
        yield rows(key, None, n, None, v, pos)

    def run(batches):
        rest, open_ = None, None  # rows of the last list so far; the longer list that is going on
        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            x = x if rest is None else [np.r_[r, c] for r, c in zip(rest, x, strict=True)]
            if not len(x[0]):
                continue
            starts = np.flatnonzero(np.r_[True, (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])])
            ends = np.r_[starts[1:], len(x[0])]
            first = 0
            if open_ is not None:
                if (x[0][0], x[1][0]) == open_[0]:
                    yield from long_rows(x, 0, int(ends[0]), open_[1:])
                    open_ = (open_[0], open_[1], (x[2][ends[0] - 1], x[3][ends[0] - 1]))
                    first = 1
                if first < len(starts) or not first:
                    open_ = None
            yield from closed(x, starts[first:-1], ends[first:-1])
            rest = None
            if first < len(starts):
                lo, hi = int(starts[-1]), int(ends[-1])
                if hi - lo > SHORT:
                    yield from long_rows(x, lo, hi, None)
                    open_ = ((x[0][lo], x[1][lo]), (x[2][lo], x[3][lo]), (x[2][hi - 1], x[3][hi - 1]))
                else:
                    rest = [c[lo:hi] for c in x]
        if rest is not None:
            yield from closed(rest, np.array([0]), np.array([len(rest[0])]))

    def closed(x, starts, ends):
        size = ends - starts
        short = (size > 1) & (size <= SHORT) & (x[1][starts] < 0)
        for a, b, na, nb in list_pairs(x[2], x[3], starts[short], size[short], percent):
            yield rows(a, b, na, nb, None, None)
        for i in np.flatnonzero((size > SHORT) | (x[1][starts] >= 0)):
            yield from long_rows(x, int(starts[i]), int(ends[i]), None)

    dealt = posted.repartition("v", "part").sortWithinPartitions("v", "part", "n", "key")
    return dealt.mapInArrow(run, "a long, b long, na int, nb int, v long, pos int")


def _pairs(found: DataFrame, percent: int) -> DataFrame:
    """(a, b) keys of classes that share enough retained values to be alike, or are neighbours in a longer list. What two sets
    share beyond their retained values is at most the larger's number of other values."""
    most = F.ceil(F.greatest("na", "nb") * percent / 100) - 1
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent)) - most
    short = found.where("b is not null and na is not null").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k")).where(F.col("k") >= need)
    return short.select("a", "b").union(found.where("b is not null and na is null").select("a", "b")).distinct()


def estimate(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard estimate from two bottom sketches: of the union's smallest values, the share in both."""
    union, n = np.unique(np.concatenate([x, y]), return_counts=True)
    low = n[: max(SKETCH if max(len(x), len(y)) >= SKETCH else len(union), 1)]
    return float((low == 2).mean())


def _tied(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches' estimate is at least LOOSE."""
    side = sketches.select("key", "sketch")
    both = pairs.join(side.select(F.col("key").alias("a"), F.col("sketch").alias("x")), "a").join(side.select(F.col("key").alias("b"), F.col("sketch").alias("y")), "b").select("a", "b", "x", "y")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [estimate(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= LOOSE for p, q in zip(x, y, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.map_arrow(both, kernel, "a long, b long", 8192)


def cross_forest(keys, parts, n, pos, home, side, sketches: list[np.ndarray], percent: int, cross: bool) -> list[tuple[int, int]]:
    """Links (key, key) that tie the parts of one list: every two members of different parts are compared by their
    sketches, but for those whose sizes or places (pos) of the list's value rule the asked similarity out. Pairs of two
    guests (not home) meet in another list, with cross only pairs of different sides meet here. Two sets share at most
    what lies before the list's value in the one and the other, and behind it."""
    k = len(keys)
    size = np.array([len(s) for s in sketches], np.int64)
    values, ids = np.unique(np.concatenate(sketches), return_inverse=True)
    first = np.r_[0, np.cumsum(size)[:-1]]
    owner = np.repeat(np.arange(k), size)
    names, part = np.unique(parts, return_inverse=True)
    rank = np.where(part == np.bincount(part).argmax(), k, np.arange(k))  # members of the largest part are only looked at
    forest, out, mark = common.Union(len(names)), [], np.zeros(len(values), bool)
    for i in np.flatnonzero(rank < k).tolist():
        after = (rank > i) & (part != part[i]) & (home | home[i]) & (n * 100 >= n[i] * percent) & (n[i] * 100 >= n * percent)
        after &= (np.minimum(pos, pos[i]) + np.minimum(n - pos, n[i] - pos[i])) * (100 + percent) >= percent * (n + n[i])
        if cross:
            after &= side != side[i]
        if not after.any():
            continue
        mine = ids[first[i] : first[i] + size[i]]
        mark[mine] = True
        both = np.bincount(owner[mark[ids]], minlength=k)
        mark[mine] = False
        after &= both >= LOOSE * np.where(np.maximum(size, size[i]) >= SKETCH, SKETCH, size + size[i] - both)
        for j in np.flatnonzero(after).tolist():
            if forest.root(part[i]) != forest.root(part[j]) and estimate(sketches[i], sketches[j]) >= LOOSE:
                forest.join(int(part[i]), int(part[j]))
                out.append((int(keys[i]), int(keys[j])))
    return out


def _across(sketches: DataFrame, found: DataFrame, tied: DataFrame, percent: int) -> DataFrame:
    """(a, b) ties between sets of different components of tied: the longer lists are compared in full, where they hold
    more than one component. Lists are split by size (a set is at home in its class and a guest
    in the next, so all that can be alike meet) and long ones go block against block."""
    members = found.where("b is null").select(F.col("a").alias("key"), F.col("na").alias("n"), "v", "pos")
    posted = members.join(tied.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("key", "n", F.coalesce("component", "key").alias("part"), "v", "pos")
    mixed = posted.groupBy("v").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("v")
    kind = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent * 1.0001))).cast("int")
    ends = F.array(F.struct(kind.alias("kind"), F.lit(True).alias("home")), F.struct((kind + 1).alias("kind"), F.lit(False).alias("home")))
    rows = posted.join(mixed.hint("merge"), "v").select("key", "n", "part", "pos", "v", F.explode(ends).alias("e")).select("key", "n", "part", "pos", "v", "e.kind", "e.home")
    rows = common.materialize(rows)
    lists = rows.groupBy("v", "kind").agg(F.count("*").alias("c"), F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("home").alias("any"))
    lists = lists.where("lo < hi and any").select("v", "kind", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(lists.hint("merge"), ["v", "kind"]).withColumn("mine", F.pmod(F.xxhash64("key", "v"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bins = max(1, -(-rows.count() // BIN))
    small = F.col("blocks") == 1
    name = F.xxhash64("v", "kind")
    rows = rows.select("key", "n", "part", "pos", "home", name.alias("list"), F.when(small, F.pmod(name, F.lit(bins))).otherwise(name).alias("bin"),
        F.when(small, -1).otherwise(F.least("mine", "o")).alias("one"), F.when(small, -1).otherwise(F.greatest("mine", "o")).alias("other"), (F.col("mine") > F.col("o")).alias("side"))
    rows = rows.join(sketches.select("key", "sketch").hint("merge"), "key")

    def compare(table: pa.Table) -> pa.Table:
        cross = table.column("one")[0].as_py() != table.column("other")[0].as_py()
        col = {c: table.column(c).to_numpy() for c in ("key", "part", "n", "pos", "home", "side", "list")}
        sets = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        order = np.argsort(col["list"], kind="stable")
        out = []
        for own in np.split(order, np.flatnonzero(np.diff(col["list"][order])) + 1):
            if len(own) > 1:
                n, pos = col["n"][own].astype(np.int64), col["pos"][own].astype(np.int64)
                out += cross_forest(col["key"][own], col["part"][own], n, pos, col["home"][own].astype(bool), col["side"][own].astype(bool), [sets[i] for i in own], percent, cross)
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return rows.groupBy("bin", "one", "other").applyInArrow(compare, "a long, b long").distinct()


def link_forest(keys: list[int], sets: list[np.ndarray], percent: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest (key, root key) of all pairs with 100 * |x & y| >= percent * |x | y|, on full sets.

    cross: for each set which of two sides it is on; then only pairs across are compared. A set is compared
    with all others at once, through marks of its values; pairs already connected are not linked again.
    """
    k = len(keys)
    size = np.array([len(s) for s in sets], np.int64)
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(values), np.int32)
    forest = common.Union(k)
    rows = range(k) if cross is None else np.flatnonzero(~cross).tolist()
    for i in rows:
        after = np.arange(i + 1, k) if cross is None else np.flatnonzero(cross)
        after = after[(size[after] * 100 >= size[i] * percent) & (size[i] * 100 >= size[after] * percent)]
        if not len(after):
            continue
        mine = ids[first[i] : first[i + 1]]
        mark[mine] = 1
        if len(after) * 4 < k:
            inter = np.array([mark[ids[first[j] : first[j + 1]]].sum() for j in after])
        else:
            inter = np.add.reduceat(mark[ids], first[:-1])[after]
        mark[mine] = 0
        for j in after[100 * inter >= percent * (size[i] + size[after] - inter)].tolist():
            forest.join(i, j)
    return [(keys[i], keys[r]) for i in range(k) if (r := forest.root(i)) != i]


def _verified(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) links that connect the near copies of each loose group. members: rid (of one document that
    has the set), set_id, key, grp (loose group), size (of the group)."""
    total = members.count()
    bins = max(1, -(-total // BIN))
    # both sides grow with the data: always a merge join, never a broadcast one on small inputs only
    texts = docs.select("text", _row().alias("rid")).join(members.hint("merge"), "rid").select("text", "set_id", "key", "grp", "size")
    names = ["bin", "one", "other", "grp", "key", "side", "values"]

    def load(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sid, key, grp, size = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
                rows = []
                for i, s in enumerate(shingle_sets(common.text_or_empty(batch.column(0)), n)):
                    if _set_id(s) != sid[i]:
                        continue  # another row with the same hash
                    blob, blocks = s.tobytes(), -(-size[i] // BLOCK)
                    if blocks == 1:
                        rows.append((xxhash.xxh3_64_intdigest(grp[i].to_bytes(8, "little", signed=True)) % bins, 0, 0, grp[i], key[i], False, blob))
                        continue
                    mine = xxhash.xxh3_64_intdigest(key[i].to_bytes(8, "little", signed=True)) % blocks
                    rows += [(grp[i], min(mine, o) + 1, max(mine, o) + 1, grp[i], key[i], mine > o, blob) for o in range(blocks)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names)

    loaded = texts.mapInArrow(load, "bin long, one int, other int, grp long, key long, side boolean, values binary")

    def compare(table: pa.Table) -> pa.Table:
        one, other = table.column("one")[0].as_py(), table.column("other")[0].as_py()
        groups: dict[int, dict[int, tuple[bytes, bool]]] = {}
        for g, k, v, s in zip(*(table.column(c).to_pylist() for c in ("grp", "key", "values", "side")), strict=True):
            groups.setdefault(g, {})[k] = (v, s)
        out = []
        for held in groups.values():
            if len(held) > 1:
                sets = [np.frombuffer(v, np.uint64) for v, _ in held.values()]
                out += link_forest(list(held), sets, percent, None if one == other else np.array([s for _, s in held.values()], bool))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return loaded.groupBy("bin", "one", "other").applyInArrow(compare, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One row per document: doc_id, rid, n_shingles, label (of its group; null without words), component_id."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    counters = min(MAX_COUNTERS, max(MIN_COUNTERS, 1 << (size // 8).bit_length()))
    scanned = common.materialize(_scan(docs, shingle, counters))
    tiers = docs.sparkSession.sparkContext.broadcast(_tiers(scanned, counters))
    every = scanned.where("chunk is null").select("doc_id", "rid", "n_shingles", "set_id")
    sketches = _sketches(docs, shingle, percent, tiers).dropDuplicates(["set_id"])
    sketches = common.materialize(sketches.withColumn("key", F.monotonically_increasing_id()))
    found = common.materialize(_lists(sketches, percent))
    tied = common.materialize(common.components(_tied(_pairs(found, percent), sketches)))
    more = common.materialize(_across(sketches, found, tied, percent))
    if not more.isEmpty():
        tied = common.materialize(common.components(tied.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    common.release(found, more)
    sizes = tied.groupBy("component").agg(F.count("*").alias("size"))
    members = sketches.select("set_id", "key").join(tied.withColumnRenamed("node", "key"), "key").join(sizes, "component")
    names = every.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"))
    members = common.materialize(members.join(names, "set_id").select("rid", "set_id", "key", F.col("component").alias("grp"), "size"))
    links = common.components(_verified(docs, members, shingle, percent))
    merged = sketches.select("set_id", "key").join(links.withColumnRenamed("node", "key"), "key").select("set_id", "component")
    # classes by component where they have one, else by set; the smallest doc_id names them
    classes = names.join(merged, "set_id", "left")
    label = F.coalesce(F.col("component").cast("string").cast("binary"), F.col("set_id"))
    classes = common.materialize(classes.select("set_id", "doc_id", label.alias("label")))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    class_of = classes.join(least, "label").select("set_id", "label", "component_id")
    full = every.where("set_id is not null").join(class_of, "set_id").select("doc_id", "rid", "n_shingles", "label", "component_id")
    bare = every.where("set_id is null").select("doc_id", "rid", "n_shingles", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("component_id"))
    return full.union(bare)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Two documents are linked if their shingle sets are alike by percent / 100 or more. Null, empty and
    wordless texts have no shingles and link with nothing; texts of any length are taken whole. Repeated
    rows are documents of their own and linked with each other. A null doc_id is kept as it is: it is never a
    component's id while there is another, and its row is kept if there is none. An empty table gives no
    rows; other columns are ignored.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return _grouped(docs, shingle, percent).select("doc_id", "n_shingles", "component_id").withColumn("kept", kept)


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near copies, with their own columns, whatever their names: one row per group, that of the
    smallest doc_id (a null one only where there is no other; among equal ids that of the smallest hash of the text).
    Rows without words (null and empty texts) are copies of nothing and stay, all of them."""
    rid, name = common.unused(docs, "rid"), common.unused(docs, "first_id")
    grouped = _grouped(docs, shingle, percent).where("label is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    kept = grouped.groupBy("label").agg(first).select(F.col("first.rid").alias(rid), F.col("first.doc_id").alias(name))
    worded = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False))
    own = common.columns(docs)
    named = docs.where(worded).withColumn(rid, _row()).join(kept.hint("merge"), rid).where(F.col("doc_id").eqNullSafe(F.col(name)))
    named = named.dropDuplicates([rid, name]).select(*own)
    return named.union(docs.where(~worded).select(*own))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents by pairs of words; nulls, empty texts, ties and repeated rows as there."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), shingle=2)


#: Brute force: every pair with a common shingle, compared on full sets.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
       ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep, s FROM s),
x AS (SELECT doc_id, n, unnest(s) AS g FROM n WHERE rep = doc_id AND n > 0),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 80 * (na + nb - k)
      UNION SELECT rep, doc_id FROM n WHERE n > 0 AND rep <> doc_id),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, c) AS (SELECT a, a FROM e UNION SELECT e.a, r.c FROM e JOIN r ON e.b = r.a),
m AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.c, n.doc_id) AS component_id, coalesce(m.c, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN m ON m.a = n.doc_id"""
