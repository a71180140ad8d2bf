"""Operator 9, language-model scoring by cross-entropy difference.

Two n-gram models of the same order, vocabulary and smoothing are counted in
one pass: the target model over the documents that ``is_target`` marks, the
background model over all documents. Tokens are characters, the vocabulary is
the set of characters of the whole corpus, shared by both models. A document's
score is the mean over its tokens of target loss minus background loss (lower:
more like the target).

Counts are exact and cover every document: n-grams are packed into 63 bits
without hashing, pre-aggregated per batch, and summed by a shuffle. The
probabilities (Witten-Bell, from order 1 up) are DataFrame joins over the
n-gram tables. For scoring, the losses of at most ``MODEL_ROWS`` n-grams, the
most frequent ones, are broadcast: all that the driver and a worker hold of the
model, however large the corpus. The texts are read once. Occurrences of rarer
n-grams leave that pass as (row, n-gram, count) per chunk of a document, meet
their losses in an equi-join and are summed by row. Hot keys are all among the
broadcast ones, so no key of the join is hot.

Defined results: null and empty texts have 0 tokens, losses and score 0;
repeated rows count and score as often as they occur; null ids are never
targets but are counted and scored; without targets both models' lower orders
fall back to the uniform distribution over the vocabulary. Extra columns are
left behind. If a corpus has over 2**15 - 2 different characters, the rarer
ones share one symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import map_batches, text_slices, texts_of

#: Entries of the loss table that are broadcast (16 bytes each).
MODEL_ROWS = 2_000_000
#: Characters whose n-grams are made at a time.
CHUNK = 1 << 20
BITS = 15
OTHER, BEGIN = 0, 1


def _runs(text: str, symbols: np.ndarray, order: int):
    """n-grams of a text, oldest symbol in the highest bits, in chunks; the
    text starts with order - 1 begin symbols."""
    before = np.full(order - 1, BEGIN, dtype=np.int64)
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at:at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        line = np.concatenate([before, symbols[codes].astype(np.int64)])
        key = line[order - 1:].copy()
        for j in range(1, order):
            key |= line[order - 1 - j:len(line) - j] << (BITS * j)
        before = line[len(line) - (order - 1):] if order > 1 else before
        yield key


def _symbols(docs: DataFrame) -> tuple[np.ndarray, int]:
    """code point -> symbol, and the size of the shared vocabulary."""
    def run(batches):
        for b in batches:
            for _, texts in text_slices(b):
                code, n = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    counts = map_batches(docs.select("doc_id", "text"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.col("n").desc(), "code").limit((1 << BITS) - 2).collect()      # at most 2**15 - 2 numbers
    table = np.zeros(0x110000, dtype=np.uint16)
    for i, r in enumerate(rows):
        table[r["code"]] = i + 2
    return table, len(rows) + 1


def _count(docs: DataFrame, symbols, order: int) -> DataFrame:
    """(key, t, b): n-gram counts of target and background."""
    def run(batches):
        for b in batches:
            flags = b.column(2).to_pylist()
            for at, texts in text_slices(b, chars=4_000_000):
                held: dict[bool, list] = {True: [], False: []}
                for k, t in enumerate(texts, at):
                    held[bool(flags[k])].extend(_runs(t, symbols.value, order))
                for target, keys in held.items():
                    if keys:
                        key, n = np.unique(np.concatenate(keys), return_counts=True)
                        n = n.astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n if target else n * 0), pa.array(n)], names=["key", "t", "b"])
    return map_batches(docs, run, "key long, t long, b long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def _frequent(counts: DataFrame) -> tuple[int, int]:
    """The least background count so that at most MODEL_ROWS n-grams have it or
    more (to a tenth; found from 10 classes an octave), and the number of rarer n-grams."""
    band = F.floor(F.log2("b") * 10).cast("int").alias("band")
    bands = sorted(counts.groupBy(band).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("least")).collect(), reverse=True)   # 640 at most
    held, least = 0, 1 << 62
    for r in bands:
        if held + r["n"] > MODEL_ROWS:
            break
        held, least = held + r["n"], r["least"]
    return least, sum(r["n"] for r in bands) - held


def _losses(counts: DataFrame, order: int, vocabulary: int) -> DataFrame:
    """(key, b, lt, lb): background count and negative log probability of the last symbol of every
    counted n-gram under both models, by Witten-Bell smoothing."""
    def shorter(df: DataFrame, n: int) -> DataFrame:
        return df.groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("key")).agg(F.sum("t").alias("t"), F.sum("b").alias("b"))

    tables = {order: counts}
    for n in range(order - 1, 0, -1):
        tables[n] = write_scratch(shorter(tables[n + 1], n), "lm-order")
    p = None
    for n in range(1, order + 1):
        own = tables[n].withColumn("context", F.shiftrightunsigned("key", BITS))
        context = own.groupBy("context").agg(*[x for m in "tb" for x in (F.sum(m).alias(m + "_all"), F.count(F.when(F.col(m) > 0, 1)).alias(m + "_kinds"))])
        own = own.join(context, "context")
        if p is None:
            lower = {m: F.lit(1.0 / max(1, vocabulary)) for m in "tb"}
        else:
            own = own.withColumn("tail", F.col("key").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))).join(p.select(F.col("key").alias("tail"), "p_t", "p_b"), "tail")
            lower = {m: F.col("p_" + m) for m in "tb"}
        new = {m: F.when(F.col(m + "_all") == 0, lower[m]).otherwise(
            (F.col(m) + F.col(m + "_kinds") * lower[m]) / (F.col(m + "_all") + F.col(m + "_kinds"))) for m in "tb"}
        p = write_scratch(own.select("key", "b", new["t"].alias("p_t"), new["b"].alias("p_b")), "lm-probability")
    return p.select("key", "b", (-F.log("p_t")).cast("float").alias("lt"), (-F.log("p_b")).cast("float").alias("lb"))


def lm_scores(docs: DataFrame, targets: DataFrame, order: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every document.

    ``targets`` has the ids (``doc_id``) of the target documents."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    sc = docs.sparkSession.sparkContext
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("mark", F.lit(True))
    src = texts_of(docs, id_col, text_col)
    n_ids = ids.count()
    marked = src.join(F.broadcast(ids) if n_ids <= 1_000_000 else ids, "doc_id", "left").select("doc_id", "text", F.coalesce("mark", F.lit(False)).alias("mark"))
    table, vocabulary = _symbols(src)
    symbols = sc.broadcast(table)                                  # one number per Unicode code point
    counts = write_scratch(_count(marked, symbols, order), "lm-counts")
    model = _losses(counts, order, vocabulary)
    least, rare = _frequent(counts)
    got = model.where(F.col("b") >= least).toPandas().sort_values("key")          # MODEL_ROWS entries at most
    entries = sc.broadcast((got["key"].to_numpy(np.int64), got["lt"].to_numpy(np.float64), got["lb"].to_numpy(np.float64)))
    scored = src.withColumn("n_tokens", F.length("text").cast("long"))
    if not rare:
        out = map_batches(scored, _add(symbols, entries, order), "doc_id long, n_tokens long, lt double, lb double")
    else:
        # Row numbers are fixed by the write; a document has a further part for each CHUNK of its text.
        parts = write_scratch(map_batches(
            scored.withColumn("row", F.monotonically_increasing_id()), _add(symbols, entries, order, True),
            "row long, doc_id long, n_tokens long, lt double, lb double, keys array<long>, ns array<int>"), "lm-parts")
        left = parts.select("row", F.explode(F.arrays_zip("keys", "ns")).alias("g")).select("row", F.col("g.keys").alias("key"), F.col("g.ns").alias("n"))
        late = left.join(model.where(F.col("b") < least), "key").select("row", *[(F.col("n") * F.col(c).cast("double")).alias(c) for c in ("lt", "lb")])
        none = lambda kind: F.lit(None).cast(kind)
        out = (parts.select("row", "doc_id", "n_tokens", "lt", "lb")
               .unionByName(late.withColumns({"doc_id": none("long"), "n_tokens": none("long")}))
               .groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("lt").alias("lt"), F.sum("lb").alias("lb")))
    mean = {c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(0.0) for c in ("lt", "lb")}
    return out.select("doc_id", "n_tokens", mean["lt"].alias("loss_target"), mean["lb"].alias("loss_background"),
                      (mean["lt"] - mean["lb"]).alias("score"))


def _add(symbols, entries, order: int, rare: bool = False):
    """The sums of the broadcast losses of each document; with ``rare`` also
    the other n-grams and their counts, for each chunk of a document."""
    def sums(runs):
        """(lt, lb, keys, ns) of each run."""
        key, lt, lb = entries.value
        distinct, place = np.unique(np.concatenate(runs), return_inverse=True)
        if len(key):
            found = np.minimum(np.searchsorted(key, distinct), len(key) - 1)
            hit = key[found] == distinct
            each = [np.where(hit, loss[found], 0.0)[place] for loss in (lt, lb)]
        else:
            hit, each = np.zeros(len(distinct), bool), [np.zeros(len(place))] * 2
        starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])[:-1]]).astype(np.int64)
        keys, ns = [None] * len(runs), [None] * len(runs)
        if rare:
            for k, (s, r) in enumerate(zip(starts, runs)):
                at = place[s:s + len(r)]
                keys[k], ns[k] = np.unique(distinct[at[~hit[at]]], return_counts=True)
        return np.add.reduceat(each[0], starts), np.add.reduceat(each[1], starts), keys, ns

    def parts(batches):
        for b in batches:
            row, ids, n = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("row", "doc_id", "n_tokens"))
            for at, texts in text_slices(b):
                runs, owner = [], []
                for k, t in enumerate(texts, at):
                    own = list(_runs(t, symbols.value, order)) or [np.zeros(0, np.int64)]
                    runs += own
                    owner += [k] * len(own)
                full = [i for i, r in enumerate(runs) if len(r)]
                none = np.zeros(0, np.int64)
                lt, lb, keys, ns = np.zeros(len(runs)), np.zeros(len(runs)), [none] * len(runs), [none] * len(runs)
                if full:
                    lt[full], lb[full], some, many = sums([runs[i] for i in full])
                    for i, x, y in zip(full, some, many):
                        keys[i], ns[i] = x, y
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for k in owner], pa.int64()) for x in (row, ids, n)] + [pa.array(lt), pa.array(lb),
                     pa.array(keys, pa.list_(pa.int64())), pa.array([x.astype(np.int32) for x in ns], pa.list_(pa.int32()))],
                    names=["row", "doc_id", "n_tokens", "lt", "lb", "keys", "ns"])

    def whole(batches):
        for b in batches:
            add = [np.zeros(b.num_rows), np.zeros(b.num_rows)]
            for at, texts in text_slices(b):
                runs, owner = [], []
                for k, t in enumerate(texts, at):
                    for r in _runs(t, symbols.value, order):
                        runs.append(r)
                        owner.append(k)
                if runs:
                    lt, lb, _, _ = sums(runs)
                    np.add.at(add[0], owner, lt)
                    np.add.at(add[1], owner, lb)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(add[0]), pa.array(add[1])], names=["doc_id", "n_tokens", "lt", "lb"])
    return parts if rare else whole


def is_good(labels: DataFrame) -> DataFrame:
    """Ids that the labels mark as good and not toxic in every row."""
    bad: Column = F.max(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).otherwise(1))
    return labels.groupBy("doc_id").agg(bad.alias("bad")).where("bad = 0").select("doc_id")
