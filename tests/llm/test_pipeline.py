"""The five stages on a small corpus, each against what its documents say by brute force."""

import itertools

import numpy as np

import corpus_pipeline
from massloom.llm import minhash, packing, secrets

WORDS = [a + b for a in "bdfgklmnprst" for b in ("ala", "emo", "iru", "ona", "ute")]


def _corpus():
    draw = np.random.default_rng(21)
    prose = lambda n: " ".join(draw.choice(WORDS, n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0
        rows.append((i, prose(80) + (" vileword vileword hatestem%d" % i if toxic else ""), "en", f"s{i % 3}"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    for i in range(1, 61, 5):  # copies of clean documents, exact and with one word changed
        words = rows[i][1].split()
        rows.append((1000 + i, rows[i][1], "en", "s1"))
        words[40] = "changed"
        rows.append((2000 + i, " ".join(words), "en", "s2"))
    rows += [(3000, prose(60) + ' secret = "Zx81kQpLm20aBcDe"', "en", "s0"), (3001, prose(60) + " token: CopiedExample123", "en", "s0"), (3002, prose(60) + " token: CopiedExample123", "en", "s1"), (3003, prose(60) + " token: CopiedExample123", "en", "s2")]
    rows += [(4000, None, "en", "s0"), (4001, "", "de", None)]
    return [(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in rows], labels


def test_every_stage_and_the_whole(spark, tmp_path):
    rows, labels = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    where, docs = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.common.materialize(stage(spark, docs, where))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        out[name] = docs.collect()
    clean = [r for r in rows if "vileword" not in (r[1] or "")]
    assert {r.doc_id for r in out["toxicity"]} == {r[0] for r in clean}
    # one of each group of near copies: that of the smallest id; documents without words stay
    sets = [minhash.shingle_sets([(r[1] or "").encode()], 5)[0] for r in clean]
    least = {r[0]: r[0] for r in clean}
    for (x, a), (y, b) in itertools.combinations(zip(clean, sets, strict=True), 2):
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            low, high = sorted((least[x[0]], least[y[0]]))
            least = {k: low if v == high else v for k, v in least.items()}
    kept = {k for k, v in least.items() if k == v}
    assert len(kept) == len(clean) - 20 and {r.doc_id for r in out["minhash_dedup"]} == kept
    # live secrets are cut, copied examples and all else stay
    text = {r[0]: r[1] for r in rows}
    for r in out["secret_scan"]:
        if r.doc_id == 3000:
            assert "Zx81kQpLm20aBcDe" not in r.text and "[SECRET]" in r.text and r.n_chars == len(r.text)
        else:
            assert r.text == text[r.doc_id]
    assert {r.doc_id for r in out["secret_scan"]} == kept
    mixed = {}
    for r in out["mixing"]:
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + 1
    assert set(mixed) == kept and max(mixed.values()) <= 2
    # every token of every copy is in one piece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.production_tokenizer())
    now = {r.doc_id: r.text for r in out["secret_scan"]}
    length = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in now.items()}
    packed = {}
    for r in out["packing"]:
        assert r.doc_tokens == length[r.doc_id]
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {i: n * length[i] for i, n in mixed.items()}
    assert corpus_pipeline.run(spark, where).count() == len(out["packing"])
    assert secrets.scan(before.limit(0)).count() == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
