"""Every corpus operator against a brute-force version on small fixtures with
nulls, empty and long texts, ties, repeated rows, clashing extra columns and
empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, d string, score string, key int"


def frame(spark, rows):
    """(doc_id, text[, source]) rows with extra columns whose names the
    operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "y", "z", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    return corpus_rows()


def corpus_rows():
    rng = random.Random(3)
    words = ["alpha", "beta,", "Gamma", "delta.", "été", "straße", "über", "no", "it's", "42", "x1", "!!"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5].replace(" ", "  ")) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one"), (None, "one"), (None, base[0])]
    rows += [(205, "one"), (205, "one"), (206, "word " * 30000)]
    return rows


def by_row(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_exact_dedup(spark, corpus):
    from trove.llm.exact_dedup import exact_dedup
    got = exact_dedup(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    groups = defaultdict(list)
    for i, t in corpus:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    want = Counter()
    for bare, rows in groups.items():
        best = min(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        for i, t in rows:
            kept = i == best[0] and len(t) == len(best[1])
            want[i, best[0], len(rows), kept, hashlib.sha256(bare.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup(frame(spark, [])).count() == 0


def test_counting_quotient_filter_is_lossless():
    from trove.llm.exact_dedup import CountingQuotientFilter as Cqf
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    b = np.unique(np.concatenate([a[::3], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    ca, cb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    filters = [Cqf.from_bytes(Cqf.build(x, c, 7).to_bytes()) for x, c in ((a, ca), (b, cb))]
    prints, counts = Cqf.merge(filters)
    want = Counter(dict(zip(a.tolist(), ca.tolist()))) + Counter(dict(zip(b.tolist(), cb.tolist())))
    assert dict(zip(prints.tolist(), counts.tolist())) == dict(want) and (np.diff(prints.astype(float)) > 0).all()


def test_quotient_filters_are_smaller_than_their_fingerprints():
    from trove.llm.exact_dedup import CountingQuotientFilter as Cqf
    from trove.llm.exact_dedup import _build_filters
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    import pyarrow as pa
    batches = list(_build_filters(5)(iter([pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], names=["fp"])])))
    blobs = [(r, x) for b in batches for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sum(len(x) for _, x in blobs) < 0.85 * 8 * len(prints)
    back = np.concatenate([(Cqf.from_bytes(x).entries()[0] >> np.uint64(5)) | (np.uint64(r) << np.uint64(59)) for r, x in blobs])
    assert sorted(back.tolist()) == sorted(set(prints.tolist()))
    # many filters of one range, in any order, counts added
    parts = [np.unique(rng.choice(prints, 900)) for _ in range(11)]
    got, counts = Cqf.merge([Cqf.from_bytes(Cqf.build(p, np.full(len(p), 3), 9).to_bytes()) for p in parts])
    want = Counter(np.concatenate(parts).tolist())
    assert got.tolist() == sorted(want) and counts.tolist() == [3 * want[x] for x in sorted(want)]
    assert [len(x) for x in Cqf.merge([])] == [0, 0]


def test_memos_keep_no_long_pieces():
    from trove.llm import bpe
    from trove.llm.common import MEMO_KEY, tokenizer_path, vocabulary_bytes
    v = bpe.load(vocabulary_bytes(tokenizer_path("byte_bpe_50k.json")))
    long = "x" * 5000 + " " + "AbC1" * 900
    counter, encoder = bpe.ByteCounter(v), bpe.ByteEncoder(v)
    want = v.library.encode(long, add_special_tokens=False).ids
    for _ in range(2):
        assert counter.count(long) == len(want) and encoder.encode(long).tolist() == want
    assert all(len(k) <= MEMO_KEY for m in (counter.tokens, counter.inner, counter.first, encoder.inner, encoder.first) for k in m)
    w = bpe.load(vocabulary_bytes(tokenizer_path("word_bpe_49k.json")))
    pairs = bpe.PairIndexEncoder(w)
    first = pairs.encode([long, "a b", long])
    assert first == pairs.encode([long, "a b", long])
    assert all(len(k) <= MEMO_KEY for m in (pairs.known, pairs.word_runs) for k in m)
    assert " ".join(r[1] for r in first[0] if r[1]).split() == [str(i) for i in w.library.encode(long, add_special_tokens=False).ids]


def simhash(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(nodes, linked):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark, corpus, monkeypatch):
    from trove.llm import simhash as op
    rows = [r for r in corpus if r[1] is None or len(r[1]) < 5000]
    fp = {(i, t): simhash(t) for i, t in rows}
    root = least_reachable(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    low = defaultdict(list)
    for (i, _), f in fp.items():
        low[root[f]].append(i)
    smallest = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    want = Counter((i, f"{fp[i, t]:016x}", smallest[root[fp[i, t]]]) for i, t in rows)
    assert by_row(op.near_duplicates(frame(spark, rows)), "doc_id", "fingerprint", "component_id") == want
    assert op.near_duplicates(frame(spark, [])).count() == 0
    # all ways to resolve a variant give the same components
    rng = random.Random(5)
    prints = {(0x123456789ABCDEF0 ^ sum(1 << rng.choice([0, 3, 40, 41, 42, 63]) for _ in range(3))) & (2 ** 64 - 1) for _ in range(60)}
    signed = [p - 2 ** 64 if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = least_reachable(signed, lambda a, b: ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2)
    for bucket in (4096, 3):
        monkeypatch.setattr(op, "BUCKET", bucket)
        got = {r.node: r.root for r in op.connected_components(op.links(fps)).collect()}
        assert {s: got.get(s, s) for s in signed} == want


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup(spark, seed):
    from trove.llm.substring_dedup import substring_dedup
    rng = random.Random(seed)
    length, gram = 6, 3
    passages = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(4, 15))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 5))]
            p = rng.choice(passages)
            w += p[rng.randint(0, 2):rng.randint(4, len(p))]
        rows.append((rng.randint(0, 50), " ".join(w)))
    rows += [(70, None), (71, ""), (72, "short text"), (73, "\t".join(passages[0] * 3)), (73, "\t".join(passages[0] * 3)), (None, " ".join(passages[0]))]
    key = [(2 ** 63 if i is None else i) for i, _ in rows]
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for k, w in sorted(zip(key, words)):
        for j in range(len(w) - length + 1):
            first.setdefault(tuple(w[j:j + length]), k)
    want = Counter()
    for (i, _), k, w in zip(rows, key, words):
        gone = set()
        for j in range(len(w) - length + 1):
            if first[tuple(w[j:j + length])] < k:
                gone |= set(range(j, j + length))
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    assert sum(k[2] for k in want) > 50
    got = substring_dedup(frame(spark, rows), length=length, gram=gram)
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    if seed == 0:
        assert substring_dedup(frame(spark, []), length=length, gram=gram).count() == 0


ODD = ["", None, " lead", "trail ", "two  spaces", "tab\tand\nnewline\n\n\nend", "it's we'll I'M", "no break", "emoji 🙂🙂 ok",
       "x<|endoftext|>y <|startoftext|> z", "é combining Å", "İstanbul ſ ǅ", "\x1c\x1d file", "日本語 text", "a" * 3000,
       "123 4567,89 $$$ *** |", "Straße ÜBER été ﬁ", " line　wide", "<|endoftext", "A" * 700 + " " + "ab" * 900, "—dash “quote” … €5"]


def test_token_counts_and_codec(spark):
    from tokenizers import Tokenizer

    from trove.llm.bpe_codec import bpe_decode, bpe_digests, bpe_encode
    from trove.llm.common import tokenizer_path
    from trove.llm.token_counts import token_counts
    rows = list(enumerate(ODD)) + [(0, ""), (None, "no id")]
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    got = token_counts(frame(spark, rows), limit=512)
    assert by_row(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want, texts = Counter(), Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        texts[i, back] += 1
    assert by_row(bpe_digests(frame(spark, rows)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert by_row(bpe_decode(bpe_encode(frame(spark, rows))), "doc_id", "text") == texts
    assert token_counts(frame(spark, []), limit=1).count() == 0 and bpe_digests(frame(spark, [])).count() == 0


def test_merge_methods_agree_with_the_library():
    from tokenizers import Tokenizer

    from trove.llm import bpe
    from trove.llm.common import tokenizer_path, vocabulary_bytes
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdeéßthing .,\n'", k=rng.randint(0, 200))) for _ in range(200)] + [t or "" for t in ODD]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        v = bpe.Vocabulary(vocabulary_bytes(tokenizer_path(name)))
        lib = Tokenizer.from_file(tokenizer_path(name))
        for t in texts:
            ids = lib.encode(t, add_special_tokens=False).ids
            if v.suffix:
                continue
            assert bpe.ByteCounter(v).count(t) == len(ids)
            assert bpe.ByteEncoder(v).encode(t).tolist() == ids
        if v.suffix:
            got = bpe.PairIndexEncoder(v).encode(texts)
            assert [" ".join(r[1] for r in runs if r[0]) for runs in got] == \
                [" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)) for t in texts]


def test_packing(spark):
    from tokenizers import Tokenizer

    from trove.llm.common import tokenizer_path
    from trove.llm.packing import pack
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["red", "green", "blueish", "été"], k=rng.choice([0, 3, 40, 900]))), rng.choice(["a", "a", "b", None]))
            for i in range(60)] + [(100, None, "c"), (100, None, "c"), (None, "no id", "b")]
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = pack(frame(spark, rows), window=128, packet=32).collect()
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(i, []).append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert sum(p.length for p in pieces) == total
    per = defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][0][p.start:p.start + p.length], "<u4").tobytes())
        assert p.doc_tokens == len(ids[p.doc_id][0])
        per[p.doc_id].extend(range(p.start, p.start + p.length))
    for i, xs in ids.items():
        assert sorted(per[i]) == sorted(list(range(len(xs[0]))) * len(xs))
    seqs = defaultdict(list)
    for p in pieces:
        seqs[p.sequence_id].append((p.offset, p.length))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 128 or at & (at - 1) == 0
    # the mixture: after every window each source is within a packet of its share
    share = Counter()
    for p in pieces:
        share[p.source] += p.length
    seen = Counter()
    for s in range(total // 128):
        for p in pieces:
            if p.sequence_id == s:
                seen[p.source] += p.length
        for source, n in share.items():
            assert abs(seen[source] - n * 128 * (s + 1) / total) <= 2 * 32 + len(share) * 32
    assert pack(frame(spark, [])).count() == 0
    heavy = pack(frame(spark, rows), window=128, packet=32, targets={"a": 0.9}).collect()
    assert sum(p.length for p in heavy) == total
    early = [p for p in heavy if p.sequence_id < 3]
    assert sum(p.length for p in early if p.source == "a") > 0.8 * sum(p.length for p in early)


def test_quality(spark):
    from trove.llm import quality
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        w = rng.choices(["plain", "words", "follow", "here."], k=rng.randint(5, 60))
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        if i % 2:
            labels.append((i, int(good), 0))
    labels += [(1, 1, 0), (None, 1, 0), (3, None, 0)]
    rows += [(900, None), (901, ""), (902, "plain words follow " * 20000), (None, "plain words follow here."), (903, "PLAIN!! WORDS!!"), (903, "PLAIN!! WORDS!!")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, rows), lab).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 3 > 0)
    flat = quality.classify(frame(spark, rows), lab.where("false")).collect()
    assert {r.score for r in flat} == {0.5}
    assert quality.classify(frame(spark, []), lab).count() == 0
    # the flattened walk equals a plain walk from the root
    x = np.random.default_rng(0).normal(size=(300, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.grow(x, y, trees=10, depth=3)
    for row, s in zip(x[:20], f.score(x)[:20]):
        t = f.base
        for n in f.root:
            while f.child[n][0] != n:
                n = f.child[n][int(row[f.feature[n]] > f.threshold[n])]
            t += f.value[n]
        assert math.isclose(1 / (1 + math.exp(-t)), s)
    assert ((f.score(x) > 0.5) == y).mean() > 0.9


def test_quality_fits_one_row_of_each_id(spark, monkeypatch):
    from trove.llm import quality as op
    rows = [(i, f"{'good words here ' * (i % 7 + 1)}{i}") for i in range(60)] + [(2, f"copy {k} of many") for k in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    ids = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    fitted, inner, grown = [], type(labels).toPandas, op.grow
    monkeypatch.setattr(type(labels), "toPandas", lambda self: fitted.append(inner(self)) or fitted[-1])
    monkeypatch.setattr(op, "grow", lambda x, y: fitted.append(len(x)) or grown(x, y))
    op.fit(frame(spark, rows), labels)
    assert sorted(fitted[0]["doc_id"]) == sorted(ids) and fitted[1] == len(ids)
    fitted.clear()
    op.fit(frame(spark, rows), labels, max_train=20)
    assert len(fitted[0]) == fitted[1] == 20 and fitted[0]["doc_id"].nunique() == 20


def test_pii(spark):
    from trove.llm import pii
    p = pii.Pseudonyms(b"k")
    values = {"card": "4111 1111 1111 1111", "email": "Ana.López@mail.example.com", "ip": "10.0.255.1", "ssn": "123-45-6789",
              "iban": "GB82 WEST 1234 5698 7654 32", "phone": "+1 (017) 555-7713", "date": "2001-02-28"}
    for kind, v in values.items():
        new = p.replace(f"see {v}, ok")
        assert p.found == {kind: 1} and v not in new and len(new) == len(f"see {v}, ok") or kind == "ip"
        again = pii.Pseudonyms(b"k")
        again.replace(new)
        assert again.found == {kind: 1}, (kind, new)                  # the pseudonym is valid in the same format
        assert pii.Pseudonyms(b"k", undo=True).replace(new) == f"see {v}, ok"
        assert pii.Pseudonyms(b"other").replace(f"see {v}, ok") != new
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', p.replace(secret)) and p.replace(secret) != secret
    assert p.replace(secret.upper()).lower() == p.replace(secret)
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(p.replace("4111-1111-1111-1111")) == digits(p.replace("4111111111111111"))
    assert p.replace("28.02.2001")[6:] + "-" + p.replace("28.02.2001")[3:5] + "-" + p.replace("28.02.2001")[:2] == p.replace("2001-02-28")
    for clean in ("4111111111111112", "2021-02-30", "256.1.1.1", "000-12-3456", "version 2.0.1", "GB82 WEST 1234 5698 7654 33", "pages 12-34", ""):
        assert p.replace(clean) == clean and not p.found
    assert p.replace("13/02/2001") != "13/02/2001" and int(p.replace("13/02/2001")[:2]) > 12
    f = pii.Feistel(b"k")
    for n in (1, 2, 7, 100, 1000):
        image = [f.permute("t", n, x) for x in range(n)]
        assert sorted(image) == list(range(n)) and [f.permute("t", n, y, undo=True) for y in image] == list(range(n))
    rows = [(1, "a 4111111111111111 b"), (2, "c 4111111111111111"), (2, "c 4111111111111111"), (3, None), (None, ""), (4, "plain " * 20000)]
    got = pii.find_and_replace(frame(spark, rows), b"k").collect()
    assert Counter((r.doc_id, r.n_found, r.kinds) for r in got) == \
        Counter([(1, 1, "card:1"), (2, 1, "card:1"), (2, 1, "card:1"), (3, 0, ""), (None, 0, ""), (4, 0, "")])
    assert len({digits(r.text) for r in got if r.n_found}) == 1
    out = pii.pseudonymise(frame(spark, rows), b"k")
    assert out.columns == frame(spark, rows).columns and out.where("fp = 'x'").count() == len(rows)
    assert pii.find_and_replace(frame(spark, []), b"k").count() == 0


def test_pii_cuts_what_follows_a_value():
    from trove.llm import pii
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    for value, tail, kind in (
            ("4111 1111 1111 1111", " 123", "card"), ("4111 1111 1111 1111", " 12/26", "card"), ("4111-1111-1111-1111", "-123", "card"),
            ("ES9121000418450200051332", " I paid", "iban"), ("BE68 5390 0754 7034", " BIC GEBABEBB", "iban"),
            ("AT61 1904 3002 3457 3201", " PAID NOW", "iban"), ("+49 30 1234 5678", " 2024", "phone")):
        new = p.replace(f"see {value}{tail}")
        assert p.found == {kind: 1} and value not in new and new.endswith(tail), (value, new)
        assert new == p.replace(f"see {value}.")[:-1] + tail                        # the same pseudonym as alone
        assert back.replace(new) == f"see {value}{tail}"
    for head in ("AB12 ", "1234 ", "+1 "):                                          # a failed match starts before the card
        assert p.replace(head + "4111 1111 1111 1111") == head + p.replace("4111 1111 1111 1111")
    rng = random.Random(4)
    for _ in range(300):                                                            # cuts stay where they are
        body = f"{rng.randrange(10 ** 15):015d}"
        digits = body + pii.luhn_digit(body)
        text = f"{' '.join(digits[i:i + 4] for i in range(0, 16, 4))} {rng.randrange(1000):03d}"
        assert back.replace(p.replace(text)) == text
        body = f"{rng.randrange(10 ** 18):018d}"
        digits = body + pii.luhn_digit(body)
        text = " ".join(digits[i:i + 4] for i in range(0, 19, 4))
        assert back.replace(p.replace(text)) == text != p.replace(text)


def test_pii_long_secrets_and_other_digits():
    from trove.llm import pii
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    rng = random.Random(12)
    for n in (16, 96, 97, 120, 128, 129, 500, 5000):
        for letters in ("abcdefgh0123XYZ_-/+", "0123456789abcdef"):
            v = "".join(rng.choices(letters, k=n - 1)) + "z0"[letters[0] == "0"]
            text = f"api_key={v} and more"
            new = p.replace(text)
            kept = sum(a == b for a, b in zip(v, new[8:]) if a.isalnum())
            assert p.found == {"secret": 1} and len(new) == len(text) and kept < 0.3 * n + 4 and back.replace(new) == text
            assert p.replace(text.upper()).lower() == p.replace(text).lower()
    jwt = ".".join("".join(rng.choices("abcXYZ019_-", k=k)) for k in (36, 90, 43))
    new = p.replace(f"token: {jwt}. Next")
    assert all(a != b for a, b in zip(jwt.split("."), new[7:-6].split("."))) and new.endswith(". Next") and back.replace(new) == f"token: {jwt}. Next"
    for other in ("١٩٩٠-٠٥-١٧ x1", "١٩٩٠-٠٥-١٧", "४१११ १११११ 1", "１９９０-０５-１７ 7"):
        assert p.replace(other) == other and not p.found


def test_pii_finds_what_hand_written_rules_find():
    """Random texts of valid and broken values between plain words, against
    rules written without the operator's patterns."""
    import ipaddress
    from datetime import date

    from trove.llm import pii
    rng = random.Random(13)
    num = lambda k: "".join(rng.choices("0123456789", k=k))

    def luhn(d):
        odd, even = d[-1::-2], d[-2::-2]
        return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0

    def card():
        d = num(16)
        return d, luhn(d)

    def iban():
        body = num(18)
        check = num(2) if rng.random() < .5 else f"{98 - int(body + '131400') % 97:02d}"
        return f"DE{check}{body}", int(body + "1314" + check) % 97 == 1 and 2 <= int(check) <= 98

    def ip():
        v = ".".join(str(rng.randrange(0, 400)) for _ in range(4))
        try:
            return v, bool(ipaddress.ip_address(v))
        except ValueError:
            return v, False

    def iso():
        v = f"{rng.choice([1899, 1900, 1987, 2024, 2099, 2100])}-{rng.randrange(0, 14):02d}-{rng.randrange(0, 33):02d}"
        try:
            return v, 1900 <= date.fromisoformat(v).year <= 2099
        except ValueError:
            return v, False

    def ssn():
        a, b, c = num(3), num(2), num(4)
        return f"{a}-{b}-{c}", a not in ("000", "666") and a < "900" and b != "00" and c != "0000"

    def email():
        return rng.choice([("ann.b@example.org", True), ("a@b", False), ("@example.org", False), ("x-1@mail.example.co", True)])
    p = pii.Pseudonyms(b"k")
    for _ in range(400):
        parts = [rng.choice([card, iban, ip, iso, ssn, email])() for _ in range(rng.randint(0, 6))]
        plain = [" ".join(rng.choices(["word", "see", "ünd", "no", "(x)", "a-b"], k=rng.randint(1, 4))) for _ in range(len(parts) + 1)]
        text = plain[0] + "".join(f" {v} {w}" for (v, _), w in zip(parts, plain[1:]))
        out = p.replace(text)
        assert sum(p.found.values()) == sum(ok for _, ok in parts), text
        for (v, ok), w in zip(parts, plain[1:]):
            if not ok:
                assert f" {v} {w}" in out, (text, out)
        assert len(out) == len(text) or any("." in v and ok for v, ok in parts)


def test_pii_letters_of_every_script():
    from trove.llm import pii
    p, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", undo=True)
    for local in ("иван.Петров", "γιώργος", "ΝΙΚΟΣ", "王小明", "たなか", "タナカ", "김철수", "łukasz", "Čapek", "İnci", "محمد", "ivan٣", "ﬁona"):
        new = p.replace(f"to {local}@example.com!")
        image = new[3:-len("@example.com!")]
        assert p.found == {"email": 1} and len(image) == len(local) and back.replace(new) == f"to {local}@example.com!", (local, new)
        assert sum(a == b for a, b in zip(image, local) if a.isalnum()) < sum(map(str.isalnum, local)) and image != local
        assert [c.isupper() for c in image] == [c.isupper() for c in local] and p.replace(new) != new
    shared = [[a for a, b in zip("łčžğżśćń", p.replace(f"łčžğżśćń{i}@example.com")) if a == b] for i in range(20)]
    assert sum(map(len, shared)) < 8                                                # no letter stays by rule
    for one in ("_@example.com", "__%+-@example.com"):
        assert p.replace(one) == one and not p.found
    sets = pii._alphabets()
    assert all(sets[d] is sets[c] for c in "жω王かł" for d in sets[c])               # closed
    assert min(map(len, sets.values())) > 1
    assert all(len(c.upper()) == 1 and c.upper().lower() == c for c in sets["ж"] + sets["ł"])


def test_lm_scoring(spark, monkeypatch):
    from trove.llm import lm_scoring as lm
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abcé ", k=rng.randint(0, 60)))) for i in range(30)] + [(40, None), (41, ""), (None, "abc"), (5, "aab"), (42, "ab" * 20000)]
    good = {0, 3, 5, 9, 12}
    targets = spark.createDataFrame([(i,) for i in [*good, 999, None]], "doc_id long")
    vocabulary = len({c for _, t in rows for c in t or ""}) + 1
    count = [Counter(), Counter()]
    for i, t in rows:
        s = "\0\0" + (t or "")
        for k in range(2, len(s)):
            for n in (1, 2, 3):
                g = s[k - n + 1:k + 1]
                count[1][g] += 1
                count[0][g] += i in good
    after = [defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])]
    for m in (0, 1):
        for g, c in count[m].items():
            if c:
                e = after[m][len(g), g[:-1]]
                e[0] += c
                e[1] += 1

    def loss(m, g):
        p = 1 / vocabulary
        for n in (1, 2, 3):
            total, kinds = after[m].get((n, g[-n:][:-1]), (0, 0))
            if total:
                p = (count[m][g[-n:]] + kinds * p) / (total + kinds)
        return -math.log(p)
    for model_rows in (lm.MODEL_ROWS, 20):
        monkeypatch.setattr(lm, "MODEL_ROWS", model_rows)
        got = lm.lm_scores(frame(spark, rows), targets, order=3).collect()
        assert len(got) == len(rows)
        want = defaultdict(list)
        for i, t in rows:
            s = "\0\0" + (t or "")
            n = len(s) - 2
            want[i].append((n, *[sum(loss(m, s[k - 2:k + 1]) for k in range(2, len(s))) / n if n else 0.0 for m in (0, 1)]))
        for r in got:
            assert any(r.n_tokens == n and math.isclose(r.loss_target, a, abs_tol=1e-5) and math.isclose(r.loss_background, b, abs_tol=1e-5)
                       for n, a, b in want[r.doc_id])
            assert math.isclose(r.score, r.loss_target - r.loss_background, abs_tol=1e-9)
    assert lm.lm_scores(frame(spark, []), targets).count() == 0


def test_lm_scoring_holds_a_bounded_model(spark, monkeypatch):
    import pandas as pd

    from trove.llm import lm_scoring as lm
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abcdefé ", k=rng.randint(0, 300)))) for i in range(40)] + [(7, "aab"), (None, "abc"), (50, None), (51, "xyz" * 5000)]
    targets = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    want = sorted(map(tuple, lm.lm_scores(frame(spark, rows), targets, order=3).collect()), key=str)
    seen = []
    inner = type(spark.range(0)).toPandas

    def spy(self):
        out = inner(self)
        seen.append(len(out))
        assert isinstance(out, pd.DataFrame)
        return out
    monkeypatch.setattr(type(spark.range(0)), "toPandas", spy)
    monkeypatch.setattr(lm, "CHUNK", 1000)                       # documents in several parts
    for limit in (0, 50):
        monkeypatch.setattr(lm, "MODEL_ROWS", limit)
        seen.clear()
        got = sorted(map(tuple, lm.lm_scores(frame(spark, rows), targets, order=3).collect()), key=str)
        assert sum(seen) <= limit                                # all that passes the driver
        assert [g[:2] for g in got] == [w[:2] for w in want]
        for g, w in zip(got, want):
            assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(g[2:], w[2:]))


def test_topk_search(spark):
    from pyspark.sql import functions as F

    from trove.llm.topk_search import topk_search
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(140, [0.5] * 6), (160, [-0.5] * 6)]     # ties
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (None, [0.1] * 6)]
    rows += [(220, [1.0, 2.0]), (240, [1.0, -2.0]), (260, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, "a", 1, "b") for i, v in rows], "vec_id long, embedding array<double>, q string, rank int, ids string")
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) and abs(64 * x) < 2 ** 28 for x in v)}
    want = set()
    for q in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk_search(df, F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk_search(df.union(df), F.col("vec_id") % 20 == 0).count() == len(want)             # repeated rows
    assert topk_search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_search_keeps_every_finite_row(spark):
    from pyspark.sql import functions as F

    from trove.llm.topk_search import topk_search
    inf = float("inf")
    rows = [(0, [1.0, -2.0]), (20, [5e6, 1.0]), (40, [-3e7, 0.5]), (1, [-inf, 0.0]), (2, [inf, -inf]), (3, [4.2e6, 3.0]),
            (4, [2.0, 2.0]), (4, [-7.0, 9.0]), (4, [-7.0, 9.0]), (60, [1.0, 1.0]), (60, [-1.0, 3.0]), (5, [2e15, 1.0]), (6, [-2e15, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = {(i, *[math.floor(64 * x) for x in v]) for i, v in rows if all(map(math.isfinite, v))}

    def best(ok, k):
        pairs = defaultdict(list)
        for a in ok:
            for b in ok:
                if a[0] % 20 == 0 and a[0] != b[0]:
                    pairs[a[0]].append((-sum(x * y for x, y in zip(a[1:], b[1:])), b[0]))
        return Counter((q, r, i, -s) for q, found in pairs.items() for r, (s, i) in enumerate(sorted(found)[:k], 1))
    fits = {r for r in ok if r[0] not in (5, 6)}
    small = df.where("vec_id not in (5, 6)")
    for k in (3, 20):
        assert Counter(map(tuple, topk_search(small, F.col("vec_id") % 20 == 0, k=k).collect())) == best(fits, k)
    near = {r for r in ok if r[0] not in (20, 40)}                # scores close to a long's limits
    got = topk_search(df.where("vec_id not in (20, 40)"), (F.col("vec_id") % 20 == 0), k=20).collect()
    assert Counter(map(tuple, got)) == best(near, 20)
    with pytest.raises(Exception, match="no long"):
        topk_search(df, F.col("vec_id") % 20 == 0, k=20).collect()


def test_connected_components(spark):
    from trove.llm.components import connected_components
    rng = random.Random(10)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    linked = {frozenset(e) for e in edges}
    nodes = {x for e in edges for x in e}
    want = least_reachable(nodes, lambda a, b: frozenset((a, b)) in linked)
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert {n: got.get(n, n) for n in nodes} == want
    assert connected_components(df.where("false")).count() == 0
