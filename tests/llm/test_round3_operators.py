"""WARC, ranked lexical search and periodic runs against brute-force versions
on small fixtures with nulls, empty and long texts, ties, repeated rows,
clashing extra columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EXTRA = "row int, term string, item long, score string, digest string"


def frame(spark, rows, columns):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", "z") for r in rows], f"{columns}, {EXTRA}")


# ------------------------------------------------------------------ op11

PAGES = [(1, "http://a/1", "<p>" + "a" * 200), (2, "http://a/2?q=é x", "<p>" + "a" * 200), (7, None, "<p>" + "a" * 200),
         (3, "http://a/3", "short"), (4, "http://a/4", "short"), (5, "http://a/5", None), (6, "http://a/6", ""),
         (8, "http://a\r\nX: y", "ü" * 50), (9, "u", "ü" * 50), (10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20),
         (12, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (None, "u", "ü" * 50), (None, "v", "n" * 300), (None, "w", "n" * 300), (20, "u", "long " * 400_000)]


def want_pages(rows):
    groups = defaultdict(list)
    out = Counter()
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        digest = hashlib.sha256(payload).hexdigest()
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= 100
            out[i, len(payload), digest, "revisit" if again else "response", ids[0] if again else None] += 1
    return out


@pytest.mark.parametrize("file_bytes", [1 << 30, 300])
def test_warc_round_trip(spark, tmpdir_fresh, file_bytes):
    from pyspark.sql import functions as F

    from trove.llm import warc
    df = frame(spark, PAGES, "page_id long, url string, html string").repartition(3)
    df.write.parquet(f"{tmpdir_fresh}/pages")
    pages = spark.read.parquet(f"{tmpdir_fresh}/pages")
    folder = f"file://{tmpdir_fresh}/warc"
    index = warc.write_archives(pages, folder, min_bytes=100, file_bytes=file_bytes)
    got = warc.read_records(spark, index, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want_pages(PAGES)
    bodies = Counter(bytes(r.payload) for r in got if r.record_type == "response")
    assert set(bodies) == {(h or "").encode() for _, _, h in PAGES}
    assert {r.url for r in got if r.page_id == 8} == {"http://a%0D%0AX:%20y"} and {r.url for r in got if r.page_id == 7} == {"about:blank"}
    # the index alone tells the same, and any part of it can be read
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect()) == want_pages(PAGES)
    some = warc.read_records(spark, index, folder, where=F.col("page_id").isin(3, 12, 20), gap=0)
    assert sorted(r.page_id for r in some.collect()) == [3, 12, 12, 20]
    # the files are gzip members from end to end: other tools see whole WARC records
    import gzip
    import os
    kinds = Counter()
    for name in os.listdir(f"{tmpdir_fresh}/warc"):
        data = gzip.open(f"{tmpdir_fresh}/warc/{name}").read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n:n + 4] == b"\r\n\r\n"
            kinds[re.search(rb"WARC-Type: (\w+)", head)[1]] += 1
            data = rest[n + 4:]
    assert kinds[b"response"] + kinds[b"revisit"] == len(PAGES) and kinds[b"warcinfo"] == len(os.listdir(f"{tmpdir_fresh}/warc"))


def test_warc_empty_table_and_damage(spark, tmpdir_fresh):
    from trove.llm import warc
    empty = warc.write_archives(frame(spark, [], "page_id long, url string, html string"), f"{tmpdir_fresh}/none")
    assert empty.count() == 0 and warc.read_records(spark, empty, f"{tmpdir_fresh}/none").count() == 0
    rec = warc.page_record("0" * 32, "d", 1, 5, "u", "0" * 64, b"body", None, None)
    with pytest.raises(ValueError, match="not what was written"):
        warc._row(*warc.parse_record(rec), True)
    with pytest.raises(ValueError, match="another length"):
        warc.parse_record(rec[:-1])
    with pytest.raises(ValueError, match="no WARC record"):
        warc.parse_record(rec[1:])


def test_byte_ranges():
    from trove.llm.warc import byte_ranges
    places = [("a", 0, 10), ("a", 10, 5), ("a", 40, 10), ("a", 500, 10), ("b", 510, 5), ("b", 515, 900), ("b", 1415, 10)]
    got = list(byte_ranges(places, gap=25, most=600))
    assert got == [places[:3], places[3:4], places[4:5], places[5:6], places[6:]]
    assert list(byte_ranges([])) == []


# ------------------------------------------------------------------ op12

def ranked(docs, items, k):
    fold = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, Counter(fold(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    if not texts:
        return Counter()
    n, tokens = len(texts), sum(sum(c.values()) for _, c in texts)
    holding = Counter(t for _, c in texts for t in c)
    merged = defaultdict(Counter)
    for item, t in items:
        merged[item].update(fold(t))
    out = Counter()
    for item, terms in merged.items():
        scores = []
        for i, c in texts:
            m = 100 - 75 + (75 * sum(c.values()) * n) // tokens
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, r in terms.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank, i, -s] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lexical_search(spark, seed, monkeypatch):
    from trove.llm import lexical_search as op
    rng = random.Random(seed)
    words = ["the", "The", "été", "Été", "straße", "x1", "42", "a b", "日本", "foo", "bar", "Foo-bar", "it's", "un_der", "\x7f", "!!", "zeta"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(120)]
    docs += [(500 + i, docs[3][1]) for i in range(20)] + [(7, "the foo"), (7, "the foo"), (7, "bar"), (None, docs[3][1]), (None, None), (900, None), (901, ""), (902, "foo " * 60_000)]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(20, None), (21, ""), (22, "!! --"), (3, "foo foo zeta"), (None, "the 42"), (23, "unseen")]
    d = frame(spark, docs, "doc_id long, text string").repartition(5)
    b = frame(spark, items, "item_id long, text string")
    want = ranked(docs, items, 10)
    assert Counter(map(tuple, op.lexical_search(d, b, k=10).collect())) == want
    if seed == 0:
        assert Counter(map(tuple, op.lexical_search(d, b, k=1).collect())) == ranked(docs, items, 1)
        monkeypatch.setattr(op, "BLOCK_BYTES", 60)                      # several automata
        assert Counter(map(tuple, op.lexical_search(d, b, k=10).collect())) == want
        monkeypatch.setattr(op, "BLOCK_BYTES", 1 << 20)
        assert op.lexical_search(d.where("false"), b).count() == 0 == op.lexical_search(d, b.where("false")).count()
        assert op.lexical_search(d.where("text is null"), b).columns == ["item_id", "rank", "doc_id", "score"]


def test_best_keeps_the_best_whatever_the_slices():
    from trove.llm.lexical_search import Best
    rng = np.random.default_rng(4)
    scores = rng.integers(0, 6, (300, 7))
    docs = rng.permutation(300)
    for cut in (1, 7, 300):
        best = Best(7, 5)
        for at in range(0, 300, cut):
            best.add(scores[at:at + cut], docs[at:at + cut])
        for j in range(7):
            want = sorted((-s, d) for s, d in zip(scores[:, j].tolist(), docs.tolist()) if s > 0)[:5]
            assert list(zip((-best.score[j]).tolist(), best.doc[j].tolist())) == want


# ------------------------------------------------------------------ op13

def brute_runs(w, least=24, repeats=3):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def noisy(rng, n, kinds, block):
    w = []
    while len(w) < n:
        b = [rng.randrange(kinds) for _ in range(rng.randint(1, block))]
        w += [b[i % len(b)] for i in range(rng.randint(1, len(b) * 6 + 30))] if rng.random() < .6 else b
        if rng.random() < .3:
            w[rng.randrange(len(w))] = rng.randrange(kinds)
    return w


@pytest.mark.parametrize("direct", [4096, 8])
def test_periodic_runs_of_random_words(direct, monkeypatch):
    from trove.llm import periodic_runs as op
    monkeypatch.setattr(op, "DIRECT", direct)
    rng = random.Random(direct)
    for t in range(250):
        w = noisy(rng, rng.randint(0, 600), rng.choice([1, 2, 3, 5, 40]), rng.choice([3, 20, 90]))
        assert op.periodic_runs(np.array(w, np.int32), 24, 3) == brute_runs(w)
    for repeats in (2, 4):
        w = noisy(rng, 500, 3, 20)
        assert op.periodic_runs(np.array(w, np.int32), 40, repeats) == brute_runs(w, 40, repeats)


def test_segments_split_until_stable():
    from trove.llm.periodic_runs import segments
    rng = random.Random(2)

    def plain(w, base=0):
        if len(w) < 24:
            return []
        count = Counter(w)
        cuts = [-1] + [i for i, x in enumerate(w) if count[x] < 3] + [len(w)]
        if len(cuts) == 2:
            return [(base, base + len(w))]
        return [s for a, b in zip(cuts, cuts[1:]) for s in plain(w[a + 1:b], base + a + 1)]
    for t in range(200):
        w = [min(int(rng.paretovariate(.4)), 400) for _ in range(rng.randint(0, 700))]
        assert segments(np.array(w, np.int32), 3, 24) == plain(w)


def test_find_runs(spark):
    from trove.llm.queries import _with_planted_period
    from trove.llm.periodic_runs import find_runs
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{x}" for x in noisy(rng, rng.randint(1, 300), rng.choice([2, 6, 300]), 12))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, " \t\n"), (73, "a " * 24), (74, "a " * 23), (75, "a b　 " * 30), (None, "x y " * 40), (None, None),
             (76, "é ü " * 20_000), (5, docs[5][1]), (5, docs[5][1])]
    df = frame(spark, docs, "doc_id long, text string")
    for rewrite in (None, _with_planted_period):
        want = Counter()
        for i, t in docs:
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            h = zlib.crc32(str(i).encode())
            if rewrite and i is not None and h % 10 == 0 and words:
                g, n = h // 10, len(words)
                a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
                words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            runs = brute_runs(words) if len(words) < 5000 else [(0, 40_000, 2)]
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            from fractions import Fraction
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            want[i, len(words), tuple(runs), best, " ".join(x for k, x in enumerate(words) if k not in gone)] += 1
        got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.strongest and tuple(r.strongest), r.collapsed)
                      for r in find_runs(df, rewrite=rewrite).collect())
        assert got == want
    assert find_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        find_runs(df, min_length=10)


def test_periodic_query_digests(spark, tmpdir_fresh):
    from trove.llm.queries import QUERIES
    frame(spark, [(1, "a b " * 30), (2, "c"), (3, None)], "doc_id long, text string").write.parquet(f"{tmpdir_fresh}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, tmpdir_fresh).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [zlib.crc32(str(i).encode()) % 10 == 0 for i in (1, 2, 3)] == [False] * 3
    assert tuple(got[1]) == (1, 1, 0, 60, 2, 30000, sha("0,60,2\n"), sha("a b"))
    assert tuple(got[2]) == (2, 0, None, None, None, None, sha(""), sha("c"))
    assert tuple(got[3]) == (3, 0, None, None, None, None, sha(""), sha(""))
