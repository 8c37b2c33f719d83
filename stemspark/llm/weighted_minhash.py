"""MinHash near-dedup for weighted sets: improved consistent weighted sampling over TF-IDF word shingles, banded, verified
by weighted Jaccard similarity.

A text's set is its 5-word shingles; a shingle weighs its count times its inverse document frequency. Every document is
counted, with a share of one by the family of likely copies that it is in: else the shingles of a large group of near copies,
being frequent, would weigh less than the edits that tell the copies apart. A document's share is one over the number of
documents in the largest bucket of plain MinHash values that it is in. Frequencies are kept in a sketch of fixed size: DEPTH tables of
WIDTH counters, the smallest of a shingle's counters is its frequency. Its error is a fixed share of the documents
(about distinct shingles a document / WIDTH, 0.1 %), so weights mean the same at every size: frequencies below FLOOR of all
counted documents count as FLOOR.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemspark.operators.graph import components

from . import common
from .shingles import SIMILAR, mix, shingle_hashes, word_hashes

WIDTH, DEPTH, SLICE = 1 << 18, 2, 1 << 12
FLOOR = 1 / 256
#: Bands and rows that tell families for the count: a pair at the least similarity shares a band with probability 0.998.
FAMILY_BANDS, FAMILY_ROWS = 6, 2
#: A whole document in the count; shares are whole numbers of its parts, so that their sums don't depend on their order.
WHOLE = 1 << 20
#: A pair at the least similarity shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.9992.
BANDS, ROWS = 10, 3
#: The finer bands for documents whose buckets still hold several components: 0.988 at the least similarity, 0.1 at 0.6.
FINE_BANDS, FINE_ROWS = 24, 8
#: Members of a bucket that are compared with each other at a time, and the slots of the sums that bound a similarity.
BLOCK, SLOTS = 1024, 256
#: Shingles that are sampled at a time.
CHUNK = 1 << 15
_U = np.uint64


def _slots(x: np.ndarray) -> list[np.ndarray]:
    return [(x & _U(WIDTH - 1)).astype(np.int64), (x >> _U(44) & _U(WIDTH - 1)).astype(np.int64)]


def _family_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys of plain MinHash values; texts without words have none."""
    common.sole("near")
    for batch in batches:
        sets = [shingle_hashes(word_hashes(t)) for t in batch.column("text").to_pylist()]
        some = [i for i, x in enumerate(sets) if len(x)]
        group: list[int] = []
        size = 0
        for n, i in enumerate(some):
            group.append(i)
            size += len(sets[i])
            if size >= CHUNK or n + 1 == len(some):
                x = np.concatenate([sets[g] for g in group])
                starts = np.cumsum([0] + [len(sets[g]) for g in group[:-1]])
                keys = np.empty((len(group), FAMILY_BANDS), np.uint64)
                for band in range(FAMILY_BANDS):
                    key = np.full(len(group), band, np.uint64)
                    for row in range(FAMILY_ROWS):
                        factor = _U(int(mix(np.array([band * FAMILY_ROWS + row + 1], np.uint64))[0]) | 1)
                        key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * factor, starts))
                    keys[:, band] = key
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(np.repeat(group, FAMILY_BANDS))), "bucket": pa.array(keys.view(np.int64).ravel())})
                group, size = [], 0


def _families(texts: DataFrame) -> DataFrame:
    """doc_id, bucket of the family bands of texts(doc_id, text; doc_ids distinct)."""
    common.ship(texts.sparkSession)
    return common.stored(texts.mapInArrow(_family_rows, "doc_id long, bucket long"), "near-families")


def shares(texts: DataFrame) -> DataFrame:
    """doc_id, parts (of WHOLE, at least 1) of the texts(doc_id, text; doc_ids distinct) that share a family band with another:
    the others count whole."""
    rows = _families(texts)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = common.stored(sizes, "near-sizes")  # stored, so that the join splits buckets with many members
    most = rows.join(sizes, "bucket").groupBy("doc_id").agg(F.max("size").alias("size"))
    found = common.stored(most.select("doc_id", F.greatest(F.lit(1), F.floor(F.lit(WHOLE) / F.col("size"))).cast("long").alias("parts")), "near-shares")
    common.forget(rows, sizes)
    return found


def followers(texts: DataFrame) -> DataFrame:
    """doc_id of the texts(doc_id, text; doc_ids distinct) that share a family band with one of a smaller doc_id."""
    rows = _families(texts)
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("bucket", "first")
    firsts = common.stored(firsts, "near-firsts")  # stored, so that the join splits buckets with many members
    found = common.stored(rows.join(firsts, "bucket").where("doc_id > first").select("doc_id").distinct(), "near-followers")
    common.forget(rows, firsts)
    return found


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """The sketch over every document's distinct shingles, float64[DEPTH, WIDTH], in documents: each counts with its parts of
    WHOLE, or whole where docs has no column of that name or a null in it. Each task counts into one table of fixed size and
    hands on its slices; slices are added up by their number."""
    common.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, WIDTH), np.int64)
        waiting: list[tuple[np.ndarray, int]] = []

        def add_up() -> None:
            parts = np.repeat(np.array([p for _, p in waiting], np.float64), [len(x) for x, _ in waiting])
            for table, slots in zip(sketch, _slots(np.concatenate([x for x, _ in waiting])), strict=True):
                table += np.bincount(slots, parts, WIDTH).astype(np.int64)  # whole numbers far below 2 ** 53
            waiting.clear()

        size = 0
        for batch in batches:
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                waiting.append((np.unique(shingle_hashes(word_hashes(text))), parts))
                size += len(waiting[-1][0])
                if size > 1 << 20:
                    add_up()
                    size = 0
        if waiting:
            add_up()
        if sketch.any():
            parts = sketch.reshape(-1, SLICE)
            full = np.flatnonzero(parts.any(axis=1))
            for at in range(0, len(full), 32):
                ids = full[at : at + 32]
                yield pa.RecordBatch.from_pydict({"part": pa.array(ids, pa.int32()), "counts": pa.array([parts[i].tobytes() for i in ids], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                now = np.frombuffer(counts, np.int64)
                total[part] = total[part] + now if part in total else now
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "counts": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    schema = "part int, counts binary"
    parts = F.coalesce("parts", F.lit(WHOLE)) if "parts" in docs.columns else F.lit(WHOLE)
    counted = docs.select("text", parts.cast("long").alias("parts")).mapInArrow(count, schema)
    # There are DEPTH * WIDTH / SLICE = 128 parts, however many tasks there are.
    rows = counted.repartition("part").mapInArrow(add, schema).collect()
    out = np.zeros((DEPTH * WIDTH // SLICE, SLICE), np.int64)
    for r in rows:
        out[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return out.reshape(DEPTH, WIDTH) / WHOLE


def inverse(sketch: np.ndarray, n: float) -> np.ndarray:
    """ln(1 + n / frequency) for every counter, frequencies of at least FLOOR * n (n: the documents counted, by their shares)."""
    return np.log1p(max(n, 1) / np.maximum(sketch, max(1.0, FLOOR * n))).astype(np.float32)


def weighted_set(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes and their weights. A text without words is the set of one shingle, 0."""
    x = shingle_hashes(word_hashes(text))
    if not len(x):
        return np.zeros(1, np.uint64), np.ones(1, np.float32)
    x, tf = np.unique(x, return_counts=True)
    a, b = _slots(x)
    return x, tf * np.maximum(idf[0][a], idf[1][b])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights over the sum of the larger."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64)
    return float(low / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low))


_GAMMA: list[np.ndarray] = []


def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """65,536 quantiles of Gamma(2, 1), by inverting 1 - (1 + x) exp(-x); and their logarithms."""
    if not _GAMMA:
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros_like(p), np.full_like(p, 60.0)
        for _ in range(60):
            x = (low + high) / 2
            under = 1 - (1 + x) * np.exp(-x) < p
            low, high = np.where(under, x, low), np.where(under, high, x)
        _GAMMA.extend([((low + high) / 2).astype(np.float32), np.log((low + high) / 2).astype(np.float32)])
    return _GAMMA[0], _GAMMA[1]


def signatures(x: np.ndarray, w: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys uint64[sets, bands] of the sets that lie one after the other in x, w from `starts` on.

    For sample k a shingle draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; t = floor(ln w / r + b);
    ln a = ln c - r (t - b) - r; the shingle with the smallest a is the sample, together with its t.
    """
    r_of, lnc_of = _gamma()
    lnw = np.log(w)
    sizes = np.diff(np.append(starts, len(x)))
    owner = np.repeat(np.arange(len(starts)), sizes)
    keys = np.zeros((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band, np.uint64)
        for row in range(rows):
            u = mix(x + _U(0x9E3779B97F4A7C15 * (1000 * rows + band * rows + row + 1) & 0xFFFFFFFFFFFFFFFF))
            r, lnc = r_of[u & _U(0xFFFF)], lnc_of[u >> _U(16) & _U(0xFFFF)]
            b = (u >> _U(32) & _U(0xFFFFFF)).astype(np.float32) * np.float32(1 / (1 << 24))
            t = np.floor(lnw / r + b)
            lna = lnc - r * (t - b) - r
            least = np.minimum.reduceat(lna, starts)
            at = np.flatnonzero(lna == least[owner])
            first = at[np.searchsorted(owner[at], np.arange(len(starts)))]
            key = mix(key * _U(0x9E3779B97F4A7C15) + mix(x[first] ^ t[first].astype(np.int64).astype(np.uint64)))
        keys[:, band] = key
    return keys


def _band_rows(idf, bands: int = BANDS, rows: int = ROWS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("near")
        table = idf.value
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            waiting: list[tuple] = []
            size = 0
            for i, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                x, w = weighted_set(text, table)
                waiting.append((doc, x, w))
                size += len(x)
                if size >= CHUNK or i == len(ids) - 1:
                    starts = np.cumsum([0] + [len(v[1]) for v in waiting[:-1]])
                    keys = signatures(np.concatenate([v[1] for v in waiting]), np.concatenate([v[2] for v in waiting]), starts, bands, rows)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.repeat(np.array([v[0] for v in waiting], np.int64), bands)), "bucket": pa.array(keys.view(np.int64).ravel())})
                    waiting, size = [], 0

    return run


def _verified(pairs: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """pairs(a, b) with b the hub, and whether their whole texts are similar enough."""
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("near")
        table, hubs = idf.value, common.Bounded(64)
        for batch in batches:
            near = []
            for b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("b", "ta", "tb")), strict=True):
                if b not in hubs:
                    hubs[b] = weighted_set(tb, table)
                near.append(similarity(weighted_set(ta, table), hubs[b]) >= least)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "near": pa.array(near, pa.bool_())})

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, near boolean")


def _ranked(members: DataFrame) -> DataFrame:
    """members(bucket, doc_id) of buckets with several documents, and each document's rank: the sizes of its buckets together.
    The text that copies derive from shares every band with most of them, so the highest rank makes the best hub."""
    full = members.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("bucket", "size")
    full = common.stored(full, "near-full")
    several = common.stored(members.join(full, "bucket"), "near-buckets")
    rank = several.groupBy("doc_id").agg(F.sum("size").alias("rank"))
    out = common.stored(several.join(rank, "doc_id").select("bucket", "doc_id", "rank"), "near-ranked")
    common.forget(full, several)
    return out


def _hubs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's hub: the member with the highest rank. The join splits skewed buckets."""
    hub = members.groupBy("bucket").agg(F.max(F.struct("rank", F.col("doc_id").alias("b"))).alias("hub")).select("bucket", "hub.b")
    hub = common.stored(hub, "near-hubs")
    return members.join(hub, "bucket").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def _sums(idf):
    """Each text's weights summed by slots of its shingles: the sum of the smaller sums of two texts is at least their overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("near")
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                x, w = weighted_set(text, idf.value)
                out.append(np.bincount((x >> _U(20) & _U(SLOTS - 1)).astype(np.int64), w, SLOTS).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "sums": pa.array(out, pa.binary())})

    return run


def _cell(least: float):
    """The pairs of a cell's two blocks (or one block) that lie in different components and may be similar enough."""

    def run(cell: pa.Table) -> pa.Table:
        import numpy as np

        ids, component, block = (cell.column(c).to_numpy() for c in ("doc_id", "component", "block"))
        sums = np.frombuffer(b"".join(cell.column("sums").to_pylist()), np.float32).reshape(len(ids), -1)
        total = sums.sum(axis=1, dtype=np.float64)
        one = cell.column("i")[0].as_py() == cell.column("j")[0].as_py()
        pairs_a, pairs_b = [], []
        for k in range(len(ids)):
            other = np.arange(len(ids)) > k if one else block > block[k]
            other &= (component != component[k]) & (np.minimum(total, total[k]) >= (least - 1e-4) * np.maximum(total, total[k]))
            at = np.flatnonzero(other)
            if len(at):
                low = np.minimum(sums[at], sums[k]).sum(axis=1, dtype=np.float64)
                at = at[low >= (least - 1e-4) * (total[at] + total[k] - low)]  # 1e-4: more than 32-bit sums are off
                pairs_a.append(np.minimum(ids[at], ids[k]))
                pairs_b.append(np.maximum(ids[at], ids[k]))
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (pairs_a, pairs_b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(placed: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """The pairs(a, b) that share a bucket of placed(bucket, doc_id, component), lie in different components and may be similar
    enough: the bound of _sums() is the only thing that leaves a pair out. Buckets are split into blocks, and each two
    blocks of a bucket are a task's cell."""
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    left = common.stored(placed.join(mixed.select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket"), "near-rest")
    sums = texts.join(common.small(left.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(_sums(idf), "doc_id long, sums binary")
    left = left.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc_id", "component")
    return left.join(common.stored(sums, "near-sums"), "doc_id").groupBy("bucket", "i", "j").applyInArrow(_cell(least), "a long, b long").distinct()


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, exact_id (smallest doc_id with the same text), class_id (smallest doc_id of the near-duplicate class), kept
    (one row of a class: the one with its smallest doc_id) for every row of docs(doc_id, text).

    Null text is empty text; empty texts are copies of each other. Rows with a null doc_id can't be linked: each is kept,
    its class_id null. A doc_id that repeats is taken with its smallest text, and its rows are one class (one is kept).
    Other columns are ignored.

    Copies collapse first. In each bucket every member is compared with the bucket's hub. Members of buckets that still hold
    several components are banded again, on finer and independent samples, and compared with those buckets' hubs. So groups
    of near copies cost a few comparisons a member. Of the pairs that then still share a bucket but no component, each one
    that a bound allows to be similar enough is compared: no pair that shares a bucket is left out unless it is connected.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    hashed = known.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    hashed = hashed.groupBy("doc_id").agg(F.min(F.struct("h", "g")).alias("t")).select("doc_id", "t.h", "t.g")
    hashed = common.stored(hashed, "near-hashed")
    firsts = common.stored(hashed.groupBy("h", "g").agg(F.min("doc_id").alias("exact_id")), "near-firsts")
    exact = common.stored(hashed.join(firsts, ["h", "g"]).select("doc_id", "exact_id"), "near-exact")

    one = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").limit(1).count() == 0
    texts = known if one else known.withColumn("o", F.struct(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))).join(hashed.select("doc_id", F.struct("h", "g").alias("o")), ["doc_id", "o"]).dropDuplicates(["doc_id"]).drop("o")
    reps = exact.where("doc_id = exact_id").select("doc_id")
    parts = shares(texts)  # exact copies are among them
    shared = parts.agg(F.count(F.lit(1)).alias("n"), F.sum("parts").alias("parts")).first()
    n = hashed.count() - shared["n"] + (shared["parts"] or 0) / WHOLE
    idf = spark.sparkContext.broadcast(inverse(document_frequencies(texts.join(common.small(parts), "doc_id", "left")), n))  # DEPTH * WIDTH floats, whatever the input
    members = texts.mapInArrow(_band_rows(idf), "doc_id long, bucket long").join(reps, "doc_id", "left_semi")
    every = common.stored(members, "near-members")
    members = _ranked(every)
    common.forget(every)
    # Texts of the documents that share a bucket with another one.
    shared = common.small(members.select("doc_id").distinct())
    texts = common.stored(texts.join(shared, "doc_id", "left_semi"), "near-texts")

    links = common.stored(_verified(_hubs(members), texts, idf, least), "near-links")
    tried_links = [links]
    labels = components(links.where("near"), common.ONE_TASK_LINKS)

    def placed_by(labels: DataFrame) -> DataFrame:
        return members.join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))

    def untried(pairs: DataFrame) -> DataFrame:
        tried = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return pairs.join(tried, ["a", "b"], "left_anti")

    placed = placed_by(labels)
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    left = common.stored(placed.join(mixed, "bucket").select("doc_id").distinct(), "near-mixed")
    if not left.isEmpty():
        fine = texts.join(common.small(left), "doc_id", "left_semi").mapInArrow(_band_rows(idf, FINE_BANDS, FINE_ROWS), "doc_id long, bucket long")
        pairs = _hubs(_ranked(common.stored(fine, "near-fine")))
        tried_links.append(common.stored(_verified(untried(pairs), texts, idf, least), "near-links"))
        links = links.unionByName(tried_links[-1])
        pairs = common.stored(untried(_rest(placed_by(components(links.where("near"), common.ONE_TASK_LINKS)), texts, idf, least)), "near-pairs")
        tried_links.append(common.stored(_verified(pairs, texts, idf, least), "near-links"))
        links = links.unionByName(tried_links[-1])
        labels = components(links.where("near"), common.ONE_TASK_LINKS)
    common.forget(hashed, firsts, parts, members, texts, *tried_links)
    labels = labels.select(F.col("node").alias("exact_id"), "component")
    out = exact.join(labels, "exact_id", "left").select("doc_id", "exact_id", F.coalesce("component", "exact_id").alias("class_id"))
    if one:
        out = out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
    else:
        times = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
        out = out.join(times, "doc_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        out = out.select("doc_id", "exact_id", "class_id", ((F.col("doc_id") == F.col("class_id")) & (F.col("copy") == 1)).alias("kept"))
    missing = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("exact_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(missing)


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """docs without the rows of other documents of a class; of a repeated doc_id the row with the smallest text hash stays.
    All columns stay as they are; rows with a null doc_id stay."""
    gone = classes(docs, least).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("doc_id is not null")
    repeated = gone.where("kept and n > 1").select("doc_id")
    gone = common.stored(gone, "near-gone")
    out = docs.join(common.small(gone.where("not kept").select("doc_id")), "doc_id", "left_anti")
    if repeated.isEmpty():
        return out.select(*docs.columns)
    twice = out.join(repeated, "doc_id", "left_semi")
    h, n = common.free(docs, "_h", "_n")
    order = Window.partitionBy("doc_id").orderBy(h)  # WindowGroupLimit keeps one row a task of a doc_id that repeats often
    once = twice.withColumn(h, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return out.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
