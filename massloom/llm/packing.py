"""Lexical retrieval packing: documents are dealt to shards by what they are about, each shard builds a
BM25 inverted index over token ids, and every window is filled greedily with its seed document and
the seed's best unused neighbours.

Document frequencies and the mean length are those of all documents. A document's place comes from minimum
hashes of its ids, weighted by their inverse document frequency, so that documents share their first key about as
often as they are alike; ranges of these keys go to tasks, and each task cuts its range into shards of a few
megabytes in the order of the keys. A range splits wherever it is too large, in the middle of equal keys too.
A document that does not fit is cut, and its rest stays in the index; so every window is full but
the last of a shard, which is cut into sequences of powers of two and needs no padding either.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
END_ID = 2
#: Tokens of a shard, about, which a task indexes at a time, and of a task's range of shards.
SHARD_TOKENS, RANGE_TOKENS = 1_000_000, 4_000_000
#: Ids are below this; keys of a document.
MOST_IDS, KEYS = 1 << 16, 3
K1, B = 1.2, 0.75
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class WordTokenizer:
    """The ids of a lower-casing tokenizer that never joins across white space, by remembering words.

    Words of plain letters with sentence marks behind them are looked up in two parts, as the
    tokenizer's own splitting does; any other word is given to the tokenizer whole.
    """

    MOST = 1_200_000  # remembered words; beyond that they are forgotten and learnt anew
    #: A full stop or comma that may be one token with its neighbours: not between a plain letter or digit and white space.
    JOINED = re.compile(rb"[.,](?:(?<![A-Za-z0-9][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,])|(?![ \n\t\r\x0b\x0c]|\Z))")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.bare.model
        self.words: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        return array("H", [t.id for t in self.model.tokenize(part)] if part.isascii() else self.bare.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        simple = _SIMPLE.fullmatch(text)
        if simple:
            marks = simple[2]
            if marks not in self.marks:
                if len(marks) > 8:
                    return self._part(simple[1].lower()) + self._part(marks)
                self.marks[marks] = self._part(marks)
            return self._part(simple[1].lower()) + self.marks[marks]
        return array("H", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of a whole text, without special tokens around it."""
        if b"<|" not in text and not self.JOINED.search(text):
            # fewer different words: lower case (special tokens, which heed case, can't occur), marks apart
            text = text.lower().replace(b".", b" .").replace(b",", b" ,")
        words, known = text.split(), self.words
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u2")
        except KeyError:
            pass
        if len(known) >= self.MOST:
            known.clear()
        here = {}
        for w in set(words):
            if w not in known:
                got = self._word(w)
                if len(w) < 64:
                    known[w] = got
                else:
                    here[w] = got
        if here:
            return np.frombuffer(b"".join([known[w] if w in known else here[w] for w in words]), "<u2")
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u2")


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """BM25 postings of a shard's documents over token ids, weighted by the frequencies df in all n documents of a
    mean length."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n: int, mean: float) -> None:
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in docs), strict=True)
        self.terms = terms
        length = np.array([len(d) for d in docs], np.float64)
        term, tf = np.concatenate(terms).astype(np.int64), np.concatenate(counts).astype(np.float64)
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in terms])
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order]
        self.first = np.r_[0, np.cumsum(np.bincount(term, minlength=int(term.max()) + 1))]
        norm = K1 * (1 - B + B * length / mean)
        self.weight = _idf(df, n)[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.terms[seed] if self.first[t + 1] - self.first[t] > 1]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def pack_documents(docs: list[np.ndarray], window: int = WINDOW, df: np.ndarray | None = None, n: int = 0, mean: float = 0.0) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id exactly once. Each sequence
    has `window` ids, but for the last ones, whose lengths are different powers of two below it. df, n and mean are the
    document frequencies, the number and the mean length of all documents; without them, those of docs."""
    if not docs:
        return []
    size = np.array([len(d) for d in docs], np.int64)
    out = [[(int(i), int(at), window)] for i in np.flatnonzero(size >= window) for at in range(0, size[i] - window + 1, window)]
    at = size // window * window
    left = size - at
    if df is None:
        df = np.bincount(np.concatenate([np.unique(d) for d in docs]).astype(np.int64), minlength=MOST_IDS)
        n, mean = len(docs), float(size.mean())
    index = Index(docs, df, n, mean)
    last: list[tuple[int, int, int]] = []
    for seed in np.argsort(-left, kind="stable"):  # long documents first: short ones fill gaps well
        if not left[seed]:
            continue
        row, room = [(int(seed), int(at[seed]), int(left[seed]))], int(window - left[seed])
        at[seed] += left[seed]
        left[seed] = 0
        if room:
            score = index.scores(seed)
            rest = np.flatnonzero(left > 0)
            for j in rest[np.argsort(-score[rest], kind="stable")]:
                take = int(min(left[j], room))
                row.append((int(j), int(at[j]), take))
                at[j] += take
                left[j] -= take
                room -= take
                if not room:
                    break
        if room:
            last = row
        else:
            out.append(row)
    size_left = sum(n for _, _, n in last)
    for bit in reversed(range(window.bit_length())):
        if size_left >> bit & 1:
            row, need = [], 1 << bit
            while need:
                i, start, n = last[0]
                take = min(n, need)
                row.append((i, start, take))
                last[0] = (i, start + take, n - take)
                if n == take:
                    last.pop(0)
                need -= take
            out.append(row)
    return out


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, crc, ids) of every document, ids as unsigned 16-bit numbers, and each task's document frequencies in df."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "crc", "ids", "df"]

    def run(batches):
        tok, end, df, id_type = _tokenizer(tokenizer), np.array([end_id], "<u2"), np.zeros(MOST_IDS, np.int64), None
        held = np.zeros(MOST_IDS, bool)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                id_type, texts = batch.column(0).type, common.text_or_empty(batch.column(1))
                ids = [np.concatenate([tok.ids(t), end]) for t in texts]
                for i in ids:
                    held[:] = False
                    held[i] = True
                    df += held
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.nulls(len(texts), pa.binary())], names)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, crc long, ids binary, df binary")


def _frequencies(tokenized: DataFrame) -> np.ndarray:
    """How many of all documents hold each id: the tasks' counts are added on the executors, in up to 64 parts, and then here."""

    def add(batches):
        total = np.zeros(MOST_IDS, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(blob), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["df"])

    parts = tokenized.where("df is not null").select("df").repartition(64).mapInArrow(add, "df binary").toArrow()
    return sum((np.frombuffer(b, np.int64) for b in parts.column("df").to_pylist()), np.zeros(MOST_IDS, np.int64))


def key_races(df: np.ndarray, n: int) -> np.ndarray:
    """[key, id]: the numbers whose minimum over a document's ids is its key: exponential draws by id, slower by
    inverse document frequency, so that two documents share a minimum by the weight of their common ids."""
    u = np.stack([(common.mix64(np.arange(MOST_IDS, dtype=np.uint64) + np.uint64((k + 1) << 32)) >> np.uint64(11)) * 2.0**-53 for k in range(KEYS)])
    return (-np.log1p(-u) / np.maximum(_idf(df, n), 1e-9)).astype(np.float32)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, shard, and
    with with_ids the piece's ids (array of int).

    tokenizer is the path of a tokenizer file on every executor; it must lower-case, drop white space and
    have fewer than 65,536 ids. Null and empty texts are documents of the end id alone; repeated rows are
    documents of their own; a null doc_id stays null; an empty table gives no rows; other columns are
    ignored. A document of any length is cut into windows; a shard holds whole documents. Token ids are written once
    to the shared folder.
    """
    tokenized = common.materialize(_tokenized(docs, tokenizer, end_id))
    each = tokenized.where("ids is not null").select("doc_id", "crc", "ids")
    n, tokens = each.agg(F.count("*"), F.sum(F.octet_length("ids").cast("long") / 2)).first()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, shard long" + (", ids array<int>" if with_ids else "")
    df = _frequencies(tokenized)
    mean = float(tokens or 0) / max(n, 1)
    sent = docs.sparkSession.sparkContext.broadcast((df, key_races(df, n)))

    def keyed(batches):
        races = sent.value[1]
        for batch in batches:
            ids = [np.frombuffer(b, "<u2") for b in batch.column(2).to_pylist()]
            keys = np.array([[i[races[k][i].argmin()] for k in range(KEYS)] for i in ids], np.int32).reshape(-1, KEYS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(k) for k in keys.T.copy()]], [*batch.schema.names, *names])

    names = [f"key{k}" for k in range(KEYS)]
    placed = each.mapInArrow(keyed, f"doc_id {kind}, crc long, ids binary, " + ", ".join(f"{k} int" for k in names))
    # equal keys, of however many documents, are split by the checksum, the id and, for rows alike in all, by chance
    order = [*names, "crc", "doc_id"]
    ranges = max(1, int(-(-(tokens or 0) // RANGE_TOKENS)))
    dealt = placed.repartitionByRange(ranges, *order, F.rand(7)).sortWithinPartitions(*order)

    def shard_rows(task: int, number: int, doc_ids: list, ids: list[np.ndarray], id_type) -> pa.RecordBatch:
        shard = (task << 20) + number
        rows = [(i, start, m, seq, off) for seq, row in enumerate(pack_documents(ids, window, sent.value[0], n, mean)) for (i, start, m), off in zip(row, np.cumsum([0, *[p[2] for p in row]])[:-1].tolist(), strict=True)]
        piece = [ids[i][start : start + m].astype("<u4") for i, start, m, _, _ in rows]
        columns = {
            "doc_id": pa.array([doc_ids[r[0]] for r in rows], id_type),
            "start": pa.array([r[1] for r in rows], pa.int64()),
            "length": pa.array([r[2] for r in rows], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in piece], pa.int64()),
            "doc_tokens": pa.array([len(ids[r[0]]) for r in rows], pa.int64()),
            "sequence_id": pa.array([(shard << 20) + r[3] for r in rows], pa.int64()),
            "offset": pa.array([r[4] for r in rows], pa.int64()),
            "shard": pa.array([shard] * len(rows), pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([p.astype(np.int32) for p in piece], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        task, number, doc_ids, ids, size, id_type = TaskContext.get().partitionId(), 0, [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                doc_ids.append(name)
                ids.append(np.frombuffer(blob, "<u2"))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield shard_rows(task, number, doc_ids, ids, id_type)
                    number, doc_ids, ids, size = number + 1, [], [], 0
        if ids:
            yield shard_rows(task, number, doc_ids, ids, id_type)

    return dealt.mapInArrow(run, schema)


def production_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens; nulls, empty texts, ties and repeated rows as in pack."""
    return pack(common.table(spark, sf_dir, "documents"), production_tokenizer()).drop("shard")
