"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

A rotation learned on a bounded sample (principal axes, then iterative quantisation; more bits than dimensions come from more
rotations) turns vectors into codes of BITS bits. Codes are cut into substrings, each with an inverted index: index rows are dealt out by (substring, value), and queries are sent to
the values that they probe. By the pigeonhole principle a code within Hamming distance r of a query agrees with it up to
floor(r / m) in some of the m substrings (and up to one less in all but r mod m + 1 of them), so probing those values finds
every code within r; those are ranked by their exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that the rotation and the radius are learned from at most (smallest hashes of vec_id).
SAMPLE = 8192
#: A code is WORDS numbers of WORD_BITS bits each; the bits of a substring divide these.
WORDS, WORD_BITS, SUBSTRING_BITS = 4, 60, 12
BITS = WORDS * WORD_BITS
#: Rows of a bucket that one task meets its queries with; a bucket with more is dealt to several, each with all its queries.
BUCKET_ROWS = 4096
#: Share of the sample's true neighbours that the first radius reaches; those of all rows are nearer.
REACH = 0.97


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)  # codes are not negative


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """int64[rows, WORDS]"""
        bits = ((x - self.mean) @ self.rotation > 0).reshape(len(x), WORDS, WORD_BITS)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(WORD_BITS - 1, -1, -1, dtype=np.int64))


def learn(sample: np.ndarray, k: int, n: int | None = None, iterations: int = 40, seed: int = 7) -> Codes:
    """Principal axes of the sample, then the rotation that brings it closest to the corners of the cube, from several starts until
    there are enough bits. The radius is the Hamming distance that REACH of the sample's nearest neighbours lie within: as
    many of them as the sample's share of the k nearest of all n rows."""
    rows, d = sample.shape
    mean = sample.mean(axis=0)
    x = sample - mean
    axes = np.linalg.eigh(x.T @ x + 1e-12 * np.eye(d))[1][:, ::-1]
    rng = np.random.default_rng(seed)
    turned: list[np.ndarray] = []
    while sum(t.shape[1] for t in turned) < BITS:
        own = axes[:, :BITS]
        v, size = x @ own, own.shape[1]
        turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        for _ in range(iterations):
            u, _, t = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
            turn = (u @ t).T
        turned.append(own @ turn)
    codes = Codes(mean, np.concatenate(turned, axis=1)[:, :BITS], BITS)
    if rows > 1:
        packed = codes.encode(sample)
        near_by = min(rows - 1, max(1, -(-k * rows // max(n or rows, rows))))
        reach = []
        for i in range(0, rows, max(1, rows // 512)):
            apart = ((sample - sample[i]) ** 2).sum(axis=1)
            apart[i] = np.inf
            near = np.argsort(apart, kind="stable")[:near_by]
            reach += _apart(packed[near], packed[i]).tolist()
        codes.radius = int(np.quantile(reach, REACH, method="higher"))
    return codes


SUBSTRINGS = BITS // SUBSTRING_BITS
CODE = [f"c{i}" for i in range(WORDS)]


def limits_of(radius: int) -> list[int]:
    """How far off each substring is probed; -1: not at all."""
    each, more = divmod(radius, SUBSTRINGS)
    return [each if s <= more else each - 1 for s in range(SUBSTRINGS)]


def _part(words: list[Column], s: int) -> Column:
    per = WORD_BITS // SUBSTRING_BITS
    return F.shiftrightunsigned(words[s // per], WORD_BITS - SUBSTRING_BITS * (s % per + 1)).bitwiseAND(F.lit((1 << SUBSTRING_BITS) - 1))


def _parts(words: list[Column]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _part(words, s).alias("value")) for s in range(SUBSTRINGS)]))


def _masks(limits: list[int]) -> list[tuple[int, int]]:
    """What a query's substring is changed by to give the values that it probes."""
    weight = np.bitwise_count(np.arange(1 << SUBSTRING_BITS))
    return [(s, int(mask)) for s, most in enumerate(limits) for mask in np.flatnonzero(weight <= most)]


def _first(x: list[Column], s: Column, limits: list[int]) -> Column:
    """Whether s is the first of the substrings that find a code which is x off: each pair counts once."""
    out = F.lit(True)
    for i, most in enumerate(limits[:-1]):
        out = out & ((s <= i) | (F.bit_count(_part(x, i)) > most))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the vectors that take part: of the most common length (the longer of two equally
    common), without null or non-finite components, not all zero, with a vec_id."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    fit = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    x = x.where(fit)
    lengths = x.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return x.where(F.size("embedding") == (lengths[0]["d"] if lengths else -1))


def _encoded(rows: DataFrame, codes: Codes, narrow: bool) -> DataFrame:
    """rows with vec (the embedding's bytes) and its code in place of embedding. narrow: the components are single precision numbers."""
    kind = np.float32 if narrow else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                columns = {n: batch.column(n) for n in batch.schema.names if n != "embedding"}
                yield pa.RecordBatch.from_pydict(columns | {"vec": pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())} | dict(zip(CODE, map(pa.array, codes.encode(x).T.copy()), strict=True)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "embedding")
    return rows.mapInArrow(run, f"{kinds}, vec binary, " + ", ".join(f"{c} long" for c in CODE))


def _distances(narrow: bool):
    kind = np.float32 if narrow else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1).astype(np.float64) for c in ("vec", "asked"))
                yield pa.RecordBatch.from_pydict({"query_id": part.column("query_id"), "ids": part.column("ids"), "score": pa.array(np.sqrt(((a - b) ** 2).sum(axis=1)))})

    return run


def _less(ids: Column, own: Column, query_id: Column) -> Column:
    """ids without one query_id where the row is the query's own vector."""
    at = F.array_position(ids, query_id).cast("int")
    rest = F.concat(F.slice(ids, F.lit(1), at - 1), F.slice(ids, at + 1, F.size(ids)))
    return F.when(own & (at > 0), rest).otherwise(ids)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision) of each query's k nearest found.

    vectors(vec_id, embedding) are all indexed; queries(vec_id, embedding) may be a subset of them: of the rows with the query's
    own vec_id and vector one is left out, the query's own. Vectors that usable() leaves out take no part; repeated rows are
    candidates each, a vec_id that is asked for repeatedly counts once (with its least vector); ties go to the smaller
    vec_id; other columns are ignored; empty tables give no rows.

    Equal vectors are one index row with their k + 1 smallest ids, which is all that any answer can hold. Index rows and
    probes meet in one equi-join on (substring, value), large buckets dealt to several tasks; a pair counts in the first
    substring that finds it and goes on if the whole codes are within the radius; vectors come to the pairs that are left.
    Queries that found fewer than k are asked again with a wider radius.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>" == queries.schema["embedding"].dataType.simpleString()
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    learned = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    codes = learn(np.array(learned.tolist(), float), k, n)

    hashes = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g")]
    least = Window.partitionBy("h", "g").orderBy("vec_id")
    ids = rows.select("vec_id", *hashes).withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    ids = ids.groupBy("h", "g").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    once = rows.select("embedding", *hashes).groupBy("h", "g").agg(F.first("embedding").alias("embedding"))
    index = common.stored(_encoded(once.join(ids, ["h", "g"]), codes, narrow), "ann-index")
    asked = usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = asked.where(F.size("embedding") == learned.map(len).iloc[0])
    asked = common.stored(_encoded(asked.select("query_id", *[c.alias(f"q{n}") for c, n in zip(hashes, "hg", strict=True)], "embedding"), codes, narrow), "ann-queries")

    words = [F.col(c) for c in CODE]
    entries = index.select("h", "g", *CODE, _parts(words).alias("p")).select("h", "g", *CODE, "p.s", "p.value")
    # At most SUBSTRINGS * 2 ** SUBSTRING_BITS rows, whatever the input.
    sizes = common.stored(entries.groupBy("s", "value").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).cast("int").alias("deals")), "ann-sizes")
    dealt = entries.join(F.broadcast(sizes), ["s", "value"]).withColumn("deal", F.pmod(F.xxhash64("h"), F.col("deals")).cast("int")).drop("deals")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    radius, left, out = min(codes.radius, BITS), asked, None
    while True:
        limits = limits_of(radius)
        masks = F.broadcast(spark.createDataFrame(_masks(limits), "s int, mask long"))  # at most as many as `sizes` has
        asks = [f"q{c}" for c in CODE]
        probes = left.select("query_id", *[w.alias(q) for w, q in zip(words, asks, strict=True)], _parts(words).alias("p")).select("query_id", *asks, "p.s", F.col("p.value").alias("v"))
        probes = probes.join(masks, "s").select("query_id", *asks, "s", F.col("v").bitwiseXOR(F.col("mask")).alias("value")).join(F.broadcast(sizes), ["s", "value"])
        probes = probes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
        x = [F.col(c).bitwiseXOR(F.col(q)) for c, q in zip(CODE, asks, strict=True)]
        within = sum((F.bit_count(w) for w in x[1:]), F.bit_count(x[0])) <= radius
        met = dealt.join(probes, ["s", "value", "deal"]).where(within & _first(x, F.col("s"), limits))
        pairs = common.stored(met.select("query_id", "h", "g"), "ann-pairs")
        wanted = left.select("query_id", "qh", "qg", F.col("vec").alias("asked"))
        full = pairs.join(index.select("h", "g", "ids", "vec"), ["h", "g"]).join(common.small(wanted, 20_000), "query_id")
        own = (F.col("h") == F.col("qh")) & (F.col("g") == F.col("qg"))
        full = full.select("query_id", _less(F.col("ids"), own, F.col("query_id")).alias("ids"), "vec", "asked")
        scored = full.mapInArrow(_distances(narrow), "query_id long, ids array<long>, score double").select("query_id", F.explode("ids").alias("vec_id"), "score")
        found = common.stored(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ann-found")
        common.forget(pairs)
        out = found if out is None else out.join(left, "query_id", "left_anti").unionByName(found)
        if radius >= BITS:
            break
        enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n - 1)).select("query_id")
        left = common.stored(left.join(enough, "query_id", "left_anti"), "ann-left")
        if left.isEmpty():
            break
        radius = min(BITS, radius + SUBSTRINGS)
    return out.select("query_id", "rank", "vec_id", "score")
