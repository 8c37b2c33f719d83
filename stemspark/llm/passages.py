"""Substring dedup by paragraph MinHash banding.

Texts here need not have paragraph marks, and a copied passage may start in the middle of a line. A "paragraph" is therefore
a run of WORDS words that starts at an anchor chosen by its content: a position whose 5-word shingle has the smallest hash of
some STEP consecutive positions. A passage of WORDS + STEP - 1 = 51 words or more holds at least one whole paragraph,
whatever stands around it, and copies of the passage hold the same ones.

  1. Coarse bands of one MinHash value each (a join on the band key) keep the paragraphs that collide with one of another
     document: an identical paragraph always does, one of Jaccard similarity 0.8 with probability 0.96.
  2. Equal paragraphs become one; the distinct ones are banded finely, and those that collide are verified by the exact
     Jaccard similarity of their shingle sets (array intersection and union) with their bucket's hub. What then still shares
     a bucket but no class is compared exactly, in cells of two blocks of the bucket; a cell gives the classes it joins, pairs
     are never listed. No similar pair that shares a bucket is lost.
  3. Components of the verified links are the classes; the first paragraph of a class (smallest doc_id, then position)
     stays, the others are removed where the class spans more than one document.
  4. Neighbouring paragraphs merge into runs. A run shorter than PASSAGE = 51 words counts only if it lies in a run of 51
     words that another document holds too, and then reaches as far as these do; or if 51 words around it and around the
     paragraph of its class that stays are similar enough themselves (a word changed between two paragraphs leaves both short).
  5. A text of fewer than 51 words holds no passage; it is one paragraph by itself and is repeated where another document's whole
     text has the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemspark.operators.graph import components, linked

from . import common
from .shingles import SHINGLE, SIMILAR, joined_hashes, mix, run_hashes, shingle_hashes

WORDS = STEP = 26
PASSAGE = WORDS + STEP - 1
COARSE = 2
FINE_ROWS = 4
#: Paragraphs of a block (on average), and pairs that are verified in one go.
BLOCK, PAIRS = 1000, 1 << 13
_U = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def _stored(df: DataFrame, name: str) -> DataFrame:
    return common.stored(df, name, dictionary=False)


def tuned_bands(similar: float = SIMILAR, rows: int = FINE_ROWS, recall: float = 0.99) -> int:
    """The fewest bands of `rows` values that bring a pair of this similarity together with at least this probability."""
    bands = 1
    while 1 - (1 - similar**rows) ** bands < recall:
        bands += 1
    return bands


def _sliding(x: np.ndarray, size: int, least) -> np.ndarray:
    """least over every `size` consecutive values, by doubling."""
    span = 1
    while 2 * span <= size:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def paragraphs(h: np.ndarray, first: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where paragraphs start in the word hashes `h` of several texts in a row, whose first words are at `first`; x are the
    shingle hashes of h. A text of fewer than WORDS words has none."""
    stop = np.append(first[1:], len(h))
    spans = stop - first - SHINGLE + 1  # shingles of a text
    found = []
    if len(x) >= STEP:
        # The windows that lie in one text: the others get the value that never is the greatest.
        low = _sliding(x, STEP, np.minimum)
        inside = np.zeros(len(low) + 1, np.int32)
        some = spans > STEP
        np.add.at(inside, first[some], 1)
        np.add.at(inside, (first + spans - STEP + 1)[some], -1)
        low[np.cumsum(inside[:-1]) == 0] = 0
        pad = np.zeros(STEP - 1, low.dtype)
        at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), STEP, np.maximum) == x)
        # Where one word repeats, neighbours are equal: of such a stretch every STEP-th position is enough.
        same = np.append(False, (np.diff(at) == 1) & (x[at[1:]] == x[at[:-1]])) if len(at) else np.zeros(0, bool)
        if same.any():
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - start) % STEP == 0]
        found.append(at)
    for i in np.flatnonzero((spans <= STEP) & (stop - first >= WORDS)):  # texts of a few words more than a paragraph
        found.append(first[i : i + 1] + x[first[i] : first[i] + spans[i]].argmin())
    at = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return at[at <= stop[np.searchsorted(first, at, "right") - 1] - WORDS] if len(first) else at


def _factor(i: int) -> np.uint64:
    return _U(int(mix(np.array([i + 1], np.uint64))[0]) | 1)


def _minhash(grams: np.ndarray, i: int) -> np.ndarray:
    """The smallest product with the i-th odd factor: shingle hashes are mixed already."""
    return (grams * _factor(i)).min(axis=1)


#: Bytes of texts that are hashed in one go, so that numpy's passes stay in cache; the last text of a group may be longer.
GROUP_BYTES = 100_000
_COARSE_KEYS = [f"k{i}" for i in range(COARSE)]


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Texts in groups (of a batch): the word hashes of a group, the first word of each of its texts, and the other columns as lists."""
    common.sole("passages")
    for batch in batches:
        texts = batch.column("text")
        rest = [batch.column(n).to_pylist() for n in names]
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            size += n
            if size >= GROUP_BYTES or i + 1 == len(texts):
                h, first = joined_hashes(texts.slice(start, i + 1 - start).to_pylist())
                yield h, first, *(c[start : i + 1] for c in rest)
                start, size = i + 1, 0


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every paragraph with its keys; and every text below PASSAGE words, with the hash of all of them and its negative size."""
    width = WORDS - SHINGLE + 1
    for h, first, docs in _groups(batches, "doc_id"):
        sizes = np.diff(np.append(first, len(h)))
        if len(brief := np.flatnonzero((sizes > 0) & (sizes < PASSAGE))):
            wholes = np.array([run_hashes(h[first[i] : first[i] + sizes[i]], int(sizes[i]))[0] for i in brief], np.uint64)
            none = pa.nulls(len(brief), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.array(docs, np.int64)[brief]), "at": pa.array(-sizes[brief].astype(np.int32)), "whole": pa.array(mix(wholes + sizes[brief].astype(np.uint64)).view(np.int64)), **dict.fromkeys(_COARSE_KEYS, none)})
        if len(h) < WORDS:
            continue
        x = shingle_hashes(h)
        at = paragraphs(h, first, x)
        of = np.searchsorted(first, at, "right") - 1
        # first may repeat where a text has no words: the last of equal ones is the text that holds the word.
        out = {"doc_id": pa.array(np.array(docs, np.int64)[of]), "at": pa.array((at - first[of]).astype(np.int32)), "whole": pa.array(run_hashes(h, WORDS)[at].view(np.int64))}
        for i, k in enumerate(_COARSE_KEYS):
            out[k] = pa.array(mix(_sliding(x * _factor(i), width, np.minimum)[at] + _U(i)).view(np.int64))
        yield pa.RecordBatch.from_pydict(out)


def _lists(values: np.ndarray) -> pa.Array:
    """A row of the matrix a list."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(values.view(np.int64).ravel()))


def _keys(grams: np.ndarray, bands: int, rows: int, first: int) -> np.ndarray:
    keys = np.zeros((len(grams), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(grams), b, np.uint64)
        for r in range(rows):
            key = mix(key * _U(_GOLD) + _minhash(grams, first + b * rows + r))
        keys[:, b] = key
    return keys


def _contents(bands: int):
    """The shingles and fine band keys of the paragraphs at `places` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = WORDS - SHINGLE + 1
        for h, first, places, wholes in _groups(batches, "places", "wholes"):
            at = np.concatenate([np.array(p, np.int64) + f for p, f in zip(places, first, strict=True)])
            grams = shingle_hashes(h)[at[:, None] + np.arange(width)]
            out = {"whole": pa.array(np.concatenate([np.array(w, np.int64) for w in wholes]))}
            out |= {n: _lists(v) for n, v in (("grams", grams), ("keys", _keys(grams, bands, FINE_ROWS, 100)))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _near(cell: np.ndarray, apart, grams: np.ndarray, similar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (p, q) of a cell that are apart and similar enough: exact, since of two sets so similar the first values in any one
    order, here the rarest first (all but the share that similarity forbids to miss), have one in common, and all that have one
    are verified."""
    values, of, times = np.unique(grams, return_inverse=True, return_counts=True)
    place = np.empty(len(values), np.int32)
    place[np.lexsort((values, times))] = np.arange(len(values))
    x = np.sort(place[of.reshape(grams.shape)], axis=1)
    again = np.zeros(x.shape, bool)
    again[:, 1:] = x[:, 1:] == x[:, :-1]
    size = x.shape[1] - again.sum(axis=1)
    first = size - np.ceil(similar * size - 1e-9) + 1
    row, column = np.nonzero(~again & (np.cumsum(~again, axis=1) <= first[:, None]))
    value = x[row, column]
    order = np.lexsort((row, value, cell[row]))
    row, value = row[order], value[order]
    group = np.cumsum(np.append(0, (value[1:] != value[:-1]) | (cell[row[1:]] != cell[row[:-1]])))
    at, step = np.arange(len(row)), 1
    while True:
        at = at[at + step < len(row)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            return
        p, q = row[at], row[at + step]
        some = apart(p, q)
        p, q = p[some], q[some]
        for i in range(0, len(p), PAIRS):
            a, b = p[i : i + PAIRS], q[i : i + PAIRS]
            shared = ((x[a][:, :, None] == x[b][:, None, :]).any(axis=2) & ~again[a]).sum(axis=1)
            near = shared >= similar * (size[a] + size[b] - shared)
            yield a[near], b[near]
        step += 1


def _joined(similar: float):
    """The classes that whole cells join (sorted by cell): each with the smallest one it is joined with."""

    def cells(rows: pa.Table) -> pa.RecordBatch:
        key, i, j, block, component = (rows.column(c).to_numpy() for c in ("key", "i", "j", "block", "component"))
        grams = pa.concat_arrays(rows.column("grams").chunks).flatten().to_numpy().reshape(len(key), -1)
        cell = np.cumsum(np.append(0, (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
        classes, of = np.unique(component, return_inverse=True)
        pairs = list(_near(cell, lambda p, q: (of[p] != of[q]) & ((i[p] == j[p]) | (block[p] != block[q])), grams, similar))
        a, b = (of[np.concatenate([v[k] for v in pairs])] if pairs else np.zeros(0, np.int64) for k in (0, 1))
        least = linked(len(classes), a, b)
        moved = least != np.arange(len(classes))
        return pa.RecordBatch.from_pydict({"a": pa.array(classes[least[moved]], pa.int64()), "b": pa.array(classes[moved], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.sole("passages")
        held: pa.Table | None = None  # the last cell, whose end may be in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*(held.to_batches() if held else []), batch])
            marks = [held.column(c).to_numpy() for c in ("key", "i", "j")]
            ends = np.flatnonzero(np.logical_or.reduce([np.diff(m) != 0 for m in marks]))
            if len(ends):
                yield cells(held.slice(0, ends[-1] + 1))
                held = held.slice(ends[-1] + 1)
        if held:
            yield cells(held)

    return run


def _rest(placed: DataFrame, grams: DataFrame, similar: float) -> DataFrame:
    """Classes (a, b) that similar paragraphs join which share a bucket of placed(key, whole, component) but no class. A bucket is
    split into blocks, and each two blocks are a cell of bounded size, wherever it goes."""
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    left = placed.join(mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key")
    left = left.withColumn("block", F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "whole", "component").join(grams, "whole").drop("whole")
    return left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_joined(similar), "a long, b long").distinct()


def _often(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def _texts(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id and text of the rows that take part, one a doc_id (of several the smallest text), and whether a doc_id repeats."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    # Counted without the texts first, which then need no reading where no doc_id repeats.
    again = _stored(_often(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")), "passages-again")
    if not again.isEmpty():
        again = _stored(_often(texts), "passages-again")
    if again.isEmpty():
        return texts, False
    again = common.small(again)
    least = texts.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(again, "doc_id", "left_anti").unionByName(least), True


def _of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """texts with the places that are asked of them: lists grow with the texts, so both sides are dealt by doc_id."""
    return texts.join(asked.hint("merge"), F.col("doc_id") == F.col("_id")).drop("_id")


def _scanned(texts: DataFrame) -> DataFrame:
    common.ship(texts.sparkSession)
    return _stored(texts.mapInArrow(_coarse, "doc_id long, at int, whole long, " + ", ".join(f"{k} long" for k in _COARSE_KEYS)), "passages-all")


def repeated(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, at (first word, from 0), class_id, removed, kept_doc_id, kept_at (the paragraph that stays): every paragraph
    whose class spans several documents.

    Null text is empty text; texts under 26 words have no paragraph; rows with a null doc_id take no part; of the
    rows of a repeated doc_id the smallest text counts; other columns are ignored; no repeats or an empty table give no rows.
    """
    texts, _ = _texts(docs)
    return _repeated(texts, _scanned(texts), similar, [])


def _repeated(texts: DataFrame, found: DataFrame, similar: float, made: list[DataFrame]) -> DataFrame:
    """made: gets the tables that can go once the result is stored."""
    found = found.where("at >= 0")

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(_stored(df, name))
        return made[-1]

    coarse = found.select("doc_id", "at", "whole", F.explode_outer(F.array(*_COARSE_KEYS)).alias("key"))
    # Pre-aggregated before the shuffle and stored; then the rows of common keys, whose skew the join can split.
    spread = coarse.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    spread = common.small(kept(spread, "passages-spread"))
    places = kept(coarse.join(spread, "key").select("doc_id", "at", "whole").distinct(), "passages-places")
    first = F.min(F.struct("doc_id", "at")).alias("first")
    kinds = kept(places.groupBy("whole").agg(first, F.max("doc_id").alias("hi")).select("whole", "first.doc_id", "first.at", F.col("first.doc_id").alias("lo"), "hi"), "passages-kinds")

    bands = tuned_bands(similar)
    # The paragraphs to read of a text, bounded by it.
    asked = kept(kinds.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("at", "whole"))).alias("p")).select("_id", "p.at", "p.whole").toDF("_id", "places", "wholes"), "passages-asked")
    contents = _of(texts, asked).mapInArrow(_contents(bands), "whole long, grams array<long>, keys array<long>")
    contents = kept(contents, "passages-contents")
    grams = contents.select("whole", "grams")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(grams.select(F.col("whole").alias("a"), F.col("grams").alias("ga")), "a").join(grams.select(F.col("whole").alias("b"), F.col("grams").alias("gb")), "b")
        shared = F.size(F.array_intersect("ga", "gb"))
        near = shared >= similar * (F.size(F.array_distinct("ga")) + F.size(F.array_distinct("gb")) - shared)
        return kept(both.select("a", "b", near.alias("near")), "passages-links")

    def members(keys: DataFrame) -> DataFrame:
        spread = keys.groupBy("key").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo < hi").select("key", F.col("lo").alias("b"))
        spread = common.small(kept(spread, "passages-hubs"))
        return kept(keys.join(spread, "key"), "passages-buckets")

    buckets = members(contents.select("whole", F.explode_outer("keys").alias("key")))
    links = verified(buckets.where("whole <> b").select(F.col("whole").alias("a"), "b").distinct())
    labels = components(links.where("near"), common.ONE_TASK_LINKS)
    placed = buckets.select("key", "whole").join(labels.select(F.col("node").alias("whole"), "component"), "whole", "left")
    rest = kept(_rest(placed.withColumn("component", F.coalesce("component", "whole")), grams, similar), "passages-rest")
    kinds = kinds.join(labels.select(F.col("node").alias("whole"), "component"), "whole", "left").withColumn("class_id", F.coalesce("component", "whole")).drop("component")
    joined = components(rest, common.ONE_TASK_LINKS).select(F.col("node").alias("class_id"), F.col("component").alias("joined"))
    kinds = kinds.join(joined, "class_id", "left").withColumn("class_id", F.coalesce("joined", "class_id")).drop("joined")
    spans = kinds.groupBy("class_id").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("hi").alias("hi")).where("first.doc_id < hi")
    classed = kinds.select("whole", "class_id").join(spans.select("class_id", "first"), "class_id")
    out = places.join(classed, "whole")
    # Paragraphs that begin a word or two apart may be alike: what overlaps the one that stays is no copy of it.
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("at") < F.col("first.at") + WORDS)
    return out.select("doc_id", "at", "class_id", (~stays).alias("removed"), F.col("first.doc_id").alias("kept_doc_id"), F.col("first.at").alias("kept_at"))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the PASSAGE-word runs that hold the paragraphs at `places` of each text, with their first word."""
    for h, first, docs, places in _groups(batches, "doc_id", "places"):
        x = run_hashes(h, PASSAGE)
        asked = np.zeros(len(h) + 1, np.int32)  # starts of runs that hold an asked paragraph and end in its text
        stop = np.append(first[1:], len(h))
        for f, s, p in zip(first, stop, places, strict=True):
            at = np.array(p, np.int64) + f
            low, high = np.maximum(at - (PASSAGE - WORDS), f), np.minimum(at, s - PASSAGE)
            some = low <= high
            np.add.at(asked, low[some], 1)
            np.add.at(asked, high[some] + 1, -1)
        starts = np.flatnonzero(np.cumsum(asked) > 0)
        of = np.searchsorted(first, starts, "right") - 1
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.array(docs, np.int64)[of]), "start": pa.array((starts - first[of]).astype(np.int32)), "passage": pa.array(x[starts].view(np.int64))})


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles within reach of each asked paragraph (PASSAGE words around it at most), and where the first of them stands."""
    for h, first, docs, places in _groups(batches, "doc_id", "places"):
        rows: list[tuple] = []
        for doc, f, s, p in zip(docs, first, np.append(first[1:], len(h)), places, strict=True):
            words = h[f:s]
            for at in p:
                low = max(0, at - (PASSAGE - WORDS))
                rows.append((doc, at, low, shingle_hashes(words[low : at + PASSAGE]).view(np.int64)))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "at": pa.array([r[1] for r in rows], pa.int32()), "low": pa.array([r[2] for r in rows], pa.int32()), "x": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})


def _before(x: np.ndarray) -> np.ndarray:
    """For each value of each row the last earlier place with the same value, else -1."""
    n = x.shape[1]
    same = (x[:, :, None] == x[:, None, :]) & np.tri(n, k=-1, dtype=bool)
    return np.where(same.any(axis=2), n - 1 - same[:, :, ::-1].argmax(axis=2), -1)


def _alike(similar: float):
    """Of two paragraphs with their surroundings: where 51 words begin, the same way off both, whose shingles are similar enough."""
    width = PASSAGE - SHINGLE + 1
    reach = PASSAGE - WORDS + 1  # windows of a pair at most
    within, starts = np.arange(reach - 1 + width), np.arange(reach)
    inside = (within[:, None] >= starts) & (within[:, None] < starts + width)

    def aligned(column: pa.Array, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles from the first common offset on (what follows a list's end counts for nothing), and how many there are."""
        ends, values = column.offsets.to_numpy(), column.values.to_numpy()
        at = ends[:-1] + skip
        return values[np.minimum(at[:, None] + within, len(values) - 1)], ends[1:] - at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                doc, at, low, kept_doc, kept_at, kept_low = (rows.column(n).to_numpy() for n in ("doc_id", "at", "low", "kept_doc_id", "kept_at", "kept_low"))
                back = np.minimum(at - low, kept_at - kept_low)
                x, x_size = aligned(rows.column("x"), at - low - back)
                y, y_size = aligned(rows.column("y"), kept_at - kept_low - back)
                windows = np.minimum(back + 1, np.minimum(x_size, y_size) - width + 1)
                # How often a value of x stands in y before each place, so that a window's share is a difference.
                seen = np.zeros((*x.shape, len(within) + 1), np.uint8)
                np.cumsum(x[:, :, None] == y[:, None, :], axis=2, dtype=np.uint8, out=seen[:, :, 1:])
                first_x, first_y = ((_before(v)[:, :, None] < starts) & inside for v in (x, y))
                both = (first_x & (seen[:, :, width:] > seen[:, :, :reach])).sum(axis=1)
                near = both >= similar * (first_x.sum(axis=1) + first_y.sum(axis=1) - both)
                row, off = np.nonzero(near & (starts < windows[:, None]))
                off = off - back[row]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.concatenate([doc[row], kept_doc[row]]), pa.int64()), "p": pa.array(np.concatenate([at[row] + off, kept_at[row] + off]), pa.int32())})

    return run


def _like_kept(texts: DataFrame, short: DataFrame, similar: float) -> DataFrame:
    """doc_id, p: where 51 words begin that resemble 51 words of the document whose copy of the paragraph stays."""
    pairs = _stored(short.where("doc_id <> kept_doc_id").select("doc_id", "at", "kept_doc_id", "kept_at"), "passages-pairs")  # a row a paragraph
    places = pairs.select("doc_id", "at").union(pairs.select("kept_doc_id", "kept_at"))
    asked = _stored(places.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("at").alias("places")), "passages-asked")
    around = _stored(_of(texts, asked).mapInArrow(_around, "doc_id long, at int, low int, x array<long>"), "passages-around")
    kept = around.select(F.col("doc_id").alias("kept_doc_id"), F.col("at").alias("kept_at"), F.col("low").alias("kept_low"), F.col("x").alias("y"))
    met = pairs.join(around, ["doc_id", "at"]).join(kept, ["kept_doc_id", "kept_at"])
    return met.mapInArrow(_alike(similar), "doc_id long, p int").distinct()


def spans(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, start, stop (words, from 0, stop excluded), n_words, class_id (of the run's first paragraph), kept_doc_id (the
    document whose copy stays), removed: the passages that repeat across documents. Runs that stay and runs that are removed
    are rows of their own; a document's runs are bounded by its text. Odd input: as repeated() has it."""
    texts, _ = _texts(docs)
    scanned = _scanned(texts)
    made: list[DataFrame] = []
    found = _stored(_repeated(texts, scanned, similar, made), "passages-classes")
    common.forget(*made)
    brief = scanned.where("at < 0").select("doc_id", (-F.col("at")).cast("long").alias("n_words"), "whole")
    brief = _stored(brief, "passages-brief")
    common.forget(scanned)
    same = brief.groupBy("whole").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last")).where("kept_doc_id < last").drop("last")
    same = common.small(_stored(same, "passages-same"))
    brief = brief.join(same, "whole").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"), "n_words", F.col("whole").alias("class_id"), "kept_doc_id", (F.col("doc_id") != F.col("kept_doc_id")).alias("removed"))
    w = Window.partitionBy("doc_id", "removed").orderBy("at", "class_id")
    runs = found.withColumn("far", F.lag("at").over(w)).withColumn("run", F.sum(F.when(F.col("at") <= F.col("far") + WORDS, 0).otherwise(1)).over(w))
    whole = Window.partitionBy("doc_id", "removed", "run")
    runs = _stored(runs.withColumn("start", F.min("at").over(whole)).withColumn("stop", F.max("at").over(whole) + WORDS).drop("far"), "passages-runs")
    short = runs.where(F.col("stop") - F.col("start") < PASSAGE)

    # The short runs' classes, wherever they are, with the passages around them.
    unsure = runs.join(common.small(short.select("class_id").distinct()), "class_id", "left_semi")
    asked = _stored(unsure.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("at").alias("places")), "passages-asked")
    around = _of(texts, asked).mapInArrow(_passages, "doc_id long, start int, passage long")
    around = _stored(around, "passages-around")
    shared = around.groupBy("passage").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("passage")
    shared = common.small(_stored(shared, "passages-shared"))
    # A place may be in it twice, which least and greatest values don't mind.
    sure = around.join(shared, "passage").select("doc_id", F.col("start").alias("p"))
    sure = _stored(sure.union(_like_kept(texts, short, similar)), "passages-sure")
    common.forget(around)
    keys = short.select("doc_id", "at", "removed", "run")
    sure = keys.select("doc_id", "removed", "run", F.explode(F.sequence(F.col("at") - (PASSAGE - WORDS), F.col("at"))).alias("p")).join(sure, ["doc_id", "p"])
    sure = sure.groupBy("doc_id", "removed", "run").agg(F.min("p").alias("lo"), (F.max("p") + PASSAGE).alias("hi"))

    merged = runs.groupBy("doc_id", "removed", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("at", "class_id", "kept_doc_id")).alias("f"))
    long_ = merged.where(F.col("stop") - F.col("start") >= PASSAGE)
    confirmed = merged.join(sure, ["doc_id", "removed", "run"]).withColumn("start", F.least("start", "lo")).withColumn("stop", F.greatest("stop", "hi"))
    out = long_.unionByName(confirmed.select(*long_.columns))
    out = out.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), (F.col("stop") - F.col("start")).cast("long").alias("n_words"), "f.class_id", "f.kept_doc_id", "removed")
    return out.unionByName(brief)


def cut(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with the removed runs of words cut out of text (each with the white space after it); n_chars, where there is
    such a column, is set to the new length. Documents that lose all their words go. Other columns and documents stay, and so
    do rows of a repeated doc_id whose text isn't the one that counts."""
    id_, cuts_, h_ = common.free(docs, "_id", "_cuts", "_h")
    removed = spans(docs, similar).where("removed").groupBy(F.col("doc_id").alias(id_)).agg(F.array_sort(F.collect_list(F.array("start", "stop"))).alias(cuts_))
    removed = _stored(removed, "passages-cuts")  # a row a document, bounded by its text
    texts, again = _texts(docs)
    named = F.col("doc_id").cast("long") == F.col(id_)
    if again:
        counts = texts.select(F.col("doc_id").alias(id_), F.xxhash64("text").alias(h_))
        removed = removed.join(counts, id_)
        named = named & (F.xxhash64(F.col("text").cast("string")) == F.col(h_))
    touched = docs.join(common.small(removed, 50_000), named, "left").drop(h_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile("[^\t-\r ]+[\t-\r ]*")
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column(cuts_).to_pylist(), strict=True):
                if cuts:
                    ends = [m.span() for m in word.finditer(text)]
                    kept, at = [], 0
                    for start, stop in cuts:  # by start; they may overlap
                        if ends[start][0] > at:
                            kept.append(text[at : ends[start][0]])
                        at = max(at, ends[stop - 1][1])
                    text = "".join(kept) + text[at:]
                    if not text.strip():
                        text = None
                texts.append(text)
            columns = {n: batch.column(n) for n in batch.schema.names if n not in (id_, cuts_)} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns, schema=pa.schema([batch.schema.field(n) for n in columns]))

    changed = touched.where(F.col(cuts_).isNotNull()).mapInArrow(run, docs.schema).where("text is not null")
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return touched.where(F.col(cuts_).isNull()).select(*docs.columns).unionByName(changed.select(*docs.columns))
