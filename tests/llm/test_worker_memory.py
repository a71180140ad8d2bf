"""What the Python workers of the corpus operators hold, and for how long."""

import pyarrow as pa
import pytest


def _captured(monkeypatch, module, call):
    """The function of batches that ``call`` hands to ``map_batches``."""
    seen = []
    monkeypatch.setattr(module, "map_batches", lambda df, fn, schema: seen.append(fn) or df)
    call()
    return seen[0]


@pytest.mark.parametrize("stage", ["pii", "found", "quality"])
def test_a_large_batch_leaves_in_pieces(spark, monkeypatch, stage):
    from trove.llm import pii, quality
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    texts = [f"mail a{i}@b.org on 2021-03-{i % 28 + 1:02d} " + "word " * 60_000 for i in range(30)] + [None, ""]
    forest = quality.Forest(0.0, *map(quality.np.array, ([0], [0.5], [[0, 0]], [0.25], [0])), 1)
    if stage == "quality":
        fn = _captured(monkeypatch, quality, lambda: quality.score(docs, forest))
    elif stage == "pii":
        fn = _captured(monkeypatch, pii, lambda: pii.pseudonymise(docs, b"k"))
    else:
        fn = _captured(monkeypatch, pii, lambda: pii.find_and_replace(docs, b"k"))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(32)), "text": texts, "source": [None] * 32})
    out = list(fn(iter([batch])))
    size = lambda b: sum(len(t or "") for t in b.column(1).to_pylist())
    assert max(map(size, out)) < 2_400_000 < size(batch)
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(32))
    p = pii.Pseudonyms(b"k")
    want = texts if stage == "quality" else [p.replace(t or "") for t in texts]
    assert [t for b in out for t in b.column(1).to_pylist()] == want
    if stage == "quality":
        assert {round(s, 6) for b in out for s in b.column(3).to_pylist()} == {0.562177}


def test_a_worker_keeps_the_tables_of_one_operator():
    from trove.llm import bpe, common, packing, substring_dedup
    common.begin_task("one")
    bpe._LOADED[b"x"] = packing._ENCODERS[1] = "table"
    substring_dedup._MEMO[b"word"]
    common.begin_task("one")
    assert bpe._LOADED and packing._ENCODERS and substring_dedup._MEMO
    common.begin_task("two")
    assert not bpe._LOADED and not packing._ENCODERS and not substring_dedup._MEMO
    assert substring_dedup._MEMO[b"word"]


def test_packing_ids_leave_in_pieces(spark, monkeypatch):
    from pyspark import TaskContext
    from trove.llm import packing
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    monkeypatch.setattr(packing, "write_scratch", lambda df, name: df)
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 3})()))
    fn = _captured(monkeypatch, packing, lambda: packing.tokenised(docs, packing.tokenizer_path("byte_bpe_50k.json"), 1, "doc_id", "text", "source"))
    texts = ["some words here " * 40_000 for _ in range(8)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(8)), "text": texts, "queue": ["+a", "+b"] * 4})
    out = list(fn(iter([batch])))
    t = pa.Table.from_batches(out)
    assert len(out) > 1 and t.column("row").to_pylist() == list(range(8)) and set(t.column("part").to_pylist()) == {3}
    n = t.column("n").to_pylist()
    assert t.column("before").to_pylist() == [sum(n[i % 2:i:2]) for i in range(8)]
