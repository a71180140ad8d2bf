"""The corpus pipeline against a brute-force version of its stages, and the
registration of its queries."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq


def write(path, rows, schema):
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), path)


def corpus(folder):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(240):
        words = rng.choices(["river", "stone", "light", "and", "the", "walks", "slowly."], k=rng.randint(4, 80))
        text = " ".join(words) if i % 4 else " ".join(w.upper() + "!!" for w in words)
        if i % 10 == 1:
            text += " call 4111 1111 1111 1111"
        docs.append([i, text])
        if i % 2 == 0 or i % 3 == 0:
            labels.append({"doc_id": i, "quality": int(i % 4 > 0), "toxic": 0})
    docs += [[300, docs[5][1]], [301, docs[5][1].replace(" ", "\n")], [302, docs[5][1] + "  "], [5, docs[5][1]], [None, docs[5][1]], [303, None], [304, ""]]
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": f"s{(i or 0) % 3}", "n_chars": len(t or "")} for i, t in docs]
    write(f"{folder}/documents.parquet", rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()),
                                                        ("source", pa.string()), ("n_chars", pa.int64())]))
    write(f"{folder}/labels.parquet", labels, pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]))
    return [(r["doc_id"], r["text"]) for r in rows]


def test_stages_and_run(spark, tmpdir_fresh):
    import corpus_pipeline as cp
    from trove.llm import pii, quality
    from trove.llm.simhash import fingerprint
    rows = corpus(tmpdir_fresh)
    docs = spark.read.parquet(f"{tmpdir_fresh}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "pii", "packing"]

    forest = quality.fit(docs, spark.read.parquet(f"{tmpdir_fresh}/labels.parquet"))
    import numpy as np
    scores = forest.score(np.array([quality.statistics(t or "") for _, t in rows]))
    now = [r for r, s in zip(rows, scores) if s >= 0.3]
    got = cp.STAGES[0][1](spark, docs, tmpdir_fresh)
    key = lambda xs: sorted((i is None, i or 0, t is None, t or "") for i, t in xs)
    assert got.columns == docs.columns and key((r.doc_id, r.text) for r in got.collect()) == key(now)
    assert len(now) < len(rows)

    groups = defaultdict(list)
    for i, t in now:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t))
    now = [min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()]
    got = cp.STAGES[1][1](spark, got, tmpdir_fresh)
    assert got.columns == docs.columns and key((r.doc_id, r.text) for r in got.collect()) == key(now)

    fp = {r: fingerprint(r[1] or "") & (2 ** 64 - 1) for r in now}
    parent = {r: r for r in now}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    order = lambda r: (r[0] is None, r[0] or 0)
    for a in now:
        for b in now:
            if a != b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)), key=order)
                parent[y] = x
    now = [r for r in now if find(r) == r]
    got = cp.STAGES[2][1](spark, got, tmpdir_fresh)
    assert got.columns == docs.columns and key((r.doc_id, r.text) for r in got.collect()) == key(now)

    p = pii.Pseudonyms(cp.KEY)
    now = [(i, p.replace(t or "")) for i, t in now]
    got = cp.STAGES[3][1](spark, got, tmpdir_fresh)
    out = got.collect()
    assert got.columns == docs.columns and key((r.doc_id, r.text) for r in out) == key(now)
    assert all(r.n_chars == len(r.text) for r in out) and not any("4111 1111" in r.text for r in out)

    pieces = cp.run(spark, tmpdir_fresh)
    per = defaultdict(int)
    for r in pieces.collect():
        per[r.doc_id] += r.length
        assert r.length > 0
    assert set(per) == {i for i, _ in now}


def test_empty_tables(spark, tmpdir_fresh):
    import corpus_pipeline as cp
    corpus(tmpdir_fresh)
    empty = f"{tmpdir_fresh}/empty"
    spark.read.parquet(f"{tmpdir_fresh}/documents.parquet").where("false").write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{tmpdir_fresh}/labels.parquet").where("false").write.parquet(f"{empty}/labels.parquet")
    assert cp.run(spark, empty).count() == 0


def test_registration():
    import __spark_entry__ as entry
    names = list(entry.queries())
    assert sorted(int(n.split("_")[0][2:]) for n in names if re.match(r"op\d+_", n)) == list(range(1, 14))
    assert "pipeline" in names


def test_dedup_stages_keep_unrelated_texts_that_share_an_id(spark):
    import corpus_pipeline as cp
    rng = random.Random(7)
    fresh = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    a, b, c, d, e = (fresh() for _ in range(5))
    rows = [(5, a), (5, b), (6, a), (7, c), (7, c), (8, c + " "), (None, d), (None, d), (None, d), (None, e), (9, e), (10, None), (None, ""), (11, " "),
            (12, None), (12, None)]
    extra = "__doc_id__ string, text_key int, root int, kept string, row int, best string"
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", 3, "z") for r in rows], f"doc_id long, text string, {extra}")
    for stage, want in ((cp.exact_stage, {(5, a), (5, b), (7, c), (None, d), (9, e)}), (cp.near_stage, {(5, a), (5, b), (7, c), (None, d), (9, e)})):
        got = stage(spark, df.drop("__doc_id__"), "")
        assert got.columns == [x for x in df.columns if x != "__doc_id__"]
        out = [(r.doc_id, r.text) for r in got.collect()]
        # 8 is the longer copy of 7 for exact dedup; the smaller id stands for near copies
        if stage is cp.exact_stage:
            want = (want - {(7, c)}) | {(8, c + " "), (11, " ")}
        else:
            want = want | {(10, None)}
        assert len(out) == len(want) and set(out) == want, (stage, out)
    # every way of joining the key tables keeps the same rows
    broadcast, cp.BROADCAST_ROWS = cp.BROADCAST_ROWS, 0
    try:
        out = [(r.doc_id, r.text) for r in cp.near_stage(spark, df.drop("__doc_id__"), "").collect()]
        assert len(out) == len(want) and set(out) == want
    finally:
        cp.BROADCAST_ROWS = broadcast
