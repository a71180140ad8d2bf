"""Production lengths, many blocks, shuffled instead of broadcast sides, long
texts and emptied memos, against brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_operators as base
from test_operators import WORD, by_row, frame


def removed(rows, length):
    key = [(2 ** 63 if i is None else i) for i, _ in rows]
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for k, w in sorted(zip(key, words), key=lambda x: x[0]):
        for j in range(len(w) - length + 1):
            first.setdefault(tuple(w[j:j + length]), k)
    out = Counter()
    for (i, _), k, w in zip(rows, key, words):
        gone = {x for j in range(len(w) - length + 1) if first[tuple(w[j:j + length])] < k for x in range(j, j + length)}
        out[i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_substring_dedup_at_production_length_with_a_long_text(spark, monkeypatch, broadcast):
    from trove.llm import substring_dedup as op
    monkeypatch.setattr(op, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    fresh = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 400)) for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(40):
        w = fresh(rng.randint(0, 30))
        for p in rng.sample(passages, rng.randint(0, 2)):
            w += p + fresh(rng.randint(0, 10))
        rows.append((i, " ".join(w)))
    long = fresh(30_000)
    rows += [(100, " ".join(long)), (101, " ".join(fresh(20) + long[7_000:22_000] + fresh(20))), (102, " ".join(long[29_900:] + passages[3])), (103, "the " * 5_000), (104, "the " * 60)]
    want = removed(rows, 50)
    got = op.substring_dedup(frame(spark, rows), length=50)
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want and max(k[2] for k in want) >= 15_000


def test_exact_dedup_with_shuffled_fingerprints(spark, monkeypatch):
    from trove.llm import exact_dedup as op
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(op, "FILTER_ROWS", 16)
    base.test_exact_dedup(spark, base.corpus_rows())


def test_exact_dedup_keeps_one_row_of_a_group_without_ids(spark):
    from trove.llm.exact_dedup import exact_dedup
    rows = [(None, "same text")] * 3 + [(None, "same  text")] + [(5, "x y"), (5, "x y"), (5, "x\ty"), (None, "xy")]
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert sorted(len(g) for g in by.values()) == [4, 4] and all(sum(r.kept for r in g) == 1 and g[0].group_size == 4 for g in by.values())
    assert {(r.doc_id, r.n_chars) for r in got if r.kept} == {(None, 10), (5, 3)}


@pytest.mark.parametrize("block,tile", [(64, 3), (7, 2)])
def test_topk_search_over_many_blocks(spark, monkeypatch, block, tile):
    from pyspark.sql import functions as F

    from trove.llm import topk_search as op
    monkeypatch.setattr(op, "BLOCK_ROWS", block)
    monkeypatch.setattr(op, "TILE_ROWS", tile)
    rng = np.random.default_rng(block)
    X = rng.integers(-3, 4, (300, 5)) / 64.0                               # many ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id long, embedding array<double>").repartition(5)
    Q = np.floor(64 * X).astype(int)
    want = set()
    for q in range(0, 300, 20):
        best = sorted((-int(Q[q] @ Q[i]), i) for i in range(300) if i != q)[:20]
        want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in op.topk_search(df, F.col("vec_id") % 20 == 0, k=20).collect()} == want


def test_packing_at_the_production_window(spark):
    from tokenizers import Tokenizer

    from trove.llm.common import tokenizer_path
    from trove.llm.packing import pack
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["red", "green", "blueish", "été"], k=rng.choice([0, 40, 700]))), rng.choice("ab")) for i in range(60)]
    rows += [(100, "word " * 30_000, "a"), (101, None, "b"), (102, "x" * 9_000, "b")]
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in rows}
    seqs, seen = defaultdict(list), defaultdict(list)
    for p in pack(frame(spark, rows), window=2048, end_id=1).collect():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4").tobytes())
        seqs[p.sequence_id].append((p.offset, p.length))
        seen[p.doc_id].append((p.start, p.length))
    for pieces in (*seqs.values(), *seen.values()):
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
    lengths = [sum(n for _, n in x) for x in seqs.values()]
    assert sum(lengths) == sum(map(len, ids.values())) and all(n == 2048 or n & (n - 1) == 0 for n in lengths) and lengths.count(2048) >= sum(lengths) // 2048


def test_counts_and_codec_on_long_texts_with_an_emptied_memo(spark, monkeypatch):
    from tokenizers import Tokenizer

    from trove.llm import bpe
    from trove.llm.common import tokenizer_path, vocabulary_bytes
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdeéß19", k=rng.randint(1, 9))) for _ in range(n)) for n in (20_000, 3_000, 3_000)] + ["y" * 60_000, "日本" * 4_000, "a b" * 20_000]
    byte, word = (Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    monkeypatch.setattr(bpe, "MEMO_LIMIT", 500)
    monkeypatch.setattr(bpe._Memo.trim, "__defaults__", (500,))
    counter = bpe.ByteCounter(bpe.load(vocabulary_bytes(tokenizer_path("byte_bpe_50k.json"))))
    pairs = bpe.PairIndexEncoder(bpe.load(vocabulary_bytes(tokenizer_path("word_bpe_49k.json"))))
    for t in texts + texts[:2]:
        assert counter.count(t) == len(byte.encode(t, add_special_tokens=False).ids)
        assert max(len(counter.tokens), len(counter.inner), len(counter.first)) <= 500
        runs = pairs.encode([t])[0]
        assert " ".join(r[1] for r in runs if r[0]).split() == [str(i) for i in word.encode(t, add_special_tokens=False).ids]
