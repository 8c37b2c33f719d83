"""Merkle fixity audit of archived web records.

An archive is a set of files; a file's records lie at ordered offsets. Leaves are the records' digests; a file's tree
groups them by ordered offset ranges (RANGE bytes, then FANOUT ranges a node) up to its root, and the files' roots are
grouped FANOUT at a time up to the archive's root. Two replicas are compared from the root down, and only children of
nodes that differ are read on: levels are stored in ranges of files, and a scan skips the ranges without a differing one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

RANGE, FANOUT = 64 << 10, 16
#: Records that a file holds on average.
FILE_RECORDS = 4096
#: Differing files (or groups of files) up to which a level's scan is told their numbers.
MOST_FILES = 1000
KEY = ["file_no", "offset", "seq"]


def record(url: str = "url", html: str = "html"):
    """A response record as it stands in the file."""
    body = F.coalesce(html, F.lit(""))
    length = F.octet_length(body).cast("string")
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), length, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def file_digits(n: int) -> int:
    """Hexadecimal digits that number the files of n records."""
    digits = 0
    while n > FILE_RECORDS * 16**digits:
        digits += 1
    return digits


def hashed(pages: DataFrame) -> DataFrame:
    """digest, page_id, length, copies of the records of pages(page_id, url, html), hashed as they are."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\n"), record()).cast("binary"), 256))
    rows = rows.withColumn("length", F.octet_length(record()).cast("long"))
    return rows.groupBy("digest", "page_id", "length").agg(F.count(F.lit(1)).cast("long").alias("copies"))


def _number(digits: int):
    return F.conv(F.substring("digest", 1, digits), 16, 10).cast("long") if digits else F.lit(0).cast("long")


def _sorted(rows: DataFrame) -> DataFrame:
    """rows in ranges of files, so that readers of a few files skip the rest by the ranges' least and greatest file."""
    return rows.repartitionByRange("file_no").sortWithinPartitions(*KEY)


def archived(pages: DataFrame) -> DataFrame:
    """The layout of pages(page_id, url, html) as an archive: file_no, offset, seq, length, copies, page_id, digest.

    A record's file is given by its digest's first digits and its place by the digest, so no page or host fills a file.
    Equal rows are one record with a count; null url and html are empty; a null page_id is a page like any other.
    """
    placed = hashed(pages).withColumn("file_no", _number(file_digits(pages.count())))
    w = Window.partitionBy("file_no").orderBy("digest", "page_id")  # FILE_RECORDS narrow rows on average
    placed = placed.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return common.stored(_sorted(placed.select(*KEY, "length", "copies", "page_id", "digest")), "archive")


def replica(pages: DataFrame, index: DataFrame) -> DataFrame:
    """file_no, offset, seq, digest of a replica's own records, hashed from its pages(page_id, url, html) and put at the places
    of the index, which is the primary's archived(). A record with a digest that the index has stands there; the others
    of a page take, in order, the places of the page's records that the replica lacks; what then is left stands after the
    end of the file that its digest names."""
    index = index.select(*KEY, "length", "copies", "page_id", "digest")
    found = common.stored(hashed(pages).select("page_id", "digest"), "replica-hashed")
    intact = index.join(found.select("digest"), "digest", "left_semi").select(*KEY, "digest")
    of_page = Window.partitionBy("page_id").orderBy("digest")
    lacks = index.join(found, "digest", "left_anti").withColumn("n", F.row_number().over(of_page)).select(*KEY, F.col("page_id").alias("_page"), F.col("n").alias("_n"))
    others = found.join(index, "digest", "left_anti").withColumn("n", F.row_number().over(of_page))
    others = common.stored(others.join(lacks, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("n") == F.col("_n")), "left").select(*KEY, "digest"), "replica-others")
    digits = file_digits(index.agg(F.sum("copies").alias("n")).first()["n"] or 0)
    ends = index.groupBy("file_no").agg(F.max(F.col("offset") + F.col("length")).alias("end"), F.max("seq").alias("last"))
    extra = others.where("seq is null").select("digest", _number(digits).alias("file_no")).join(ends, "file_no", "left")
    after = F.row_number().over(Window.partitionBy("file_no").orderBy("digest"))
    extra = extra.select("file_no", F.coalesce("end", F.lit(0)).cast("long").alias("offset"), (F.coalesce("last", F.lit(0)) + after).cast("long").alias("seq"), "digest")
    return common.stored(_sorted(intact.unionByName(others.where("seq is not null")).unionByName(extra)), "replica")


@dataclass(frozen=True)
class Height:
    """Levels of ranges inside a file, and of files above them."""

    ranges: int
    files: int


def height(*replicas: DataFrame) -> Height:
    """Of the trees of replicas: as many levels as the largest offset and file number need."""
    ranges = files = 1
    for r in replicas:
        most = r.agg(F.max("offset").alias("offset"), F.max("file_no").alias("file_no")).first()
        while (most["offset"] or 0) // RANGE >= FANOUT ** (ranges - 1):
            ranges += 1
        while (most["file_no"] or 0) >= FANOUT ** (files - 1):
            files += 1
    return Height(ranges, files)


def tree(leaves: DataFrame, tall: Height) -> list[DataFrame]:
    """The levels of the tree of leaves(file_no, offset, seq, digest), records first, each with a, b, seq (the node), digest, pa, pb
    (its parent). A node's digest is that of its children's places and digests in order; it has the records of a range, or
    FANOUT nodes."""
    level = leaves.select(F.col("file_no").alias("a"), F.col("offset").alias("b"), "seq", "digest", F.col("file_no").alias("pa"), F.floor(F.col("offset") / RANGE).cast("long").alias("pb"))
    levels = [common.stored(level, "merkle-0")]
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "seq", "digest"))), lambda r: F.concat_ws(":", r["a"], r["b"], r["seq"], r["digest"])), ",")
    for i in range(1, tall.ranges + tall.files):
        up = levels[-1].groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sha2(ordered.cast("binary"), 256).alias("digest")).withColumn("seq", F.lit(0).cast("long"))
        if i < tall.ranges:
            parent = F.col("a"), F.floor(F.col("b") / FANOUT).cast("long")
        else:  # roots of files, then groups of files
            parent = F.floor(F.col("a") / FANOUT).cast("long"), F.lit(-1).cast("long")
        up = up.select("a", "b", "seq", "digest", parent[0].alias("pa"), parent[1].alias("pb"))
        levels.append(common.stored(up.repartitionByRange("pa").sortWithinPartitions("pa", "pb") if i < tall.ranges else up, f"merkle-{i}"))
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file_no, offset, seq, status ('changed', 'missing', 'extra') of every record that two replicas(file_no, offset, seq, digest)
    don't agree on. Equal replicas (empty ones too) differ nowhere from the root on and give no rows. A replica's records
    stand at the offsets of the common index, so a lost record doesn't move the others."""
    tall = height(primary, replica)
    a, b = tree(primary, tall), tree(replica, tall)
    ask = wanted = None
    for i in range(len(a) - 1, -1, -1):
        left = a[i].select("a", "b", "seq", F.col("pa").alias("la"), F.col("pb").alias("lb"), F.col("digest").alias("one"))
        right = b[i].select("a", "b", "seq", F.col("pa").alias("la"), F.col("pb").alias("lb"), F.col("digest").alias("two"))
        if wanted:
            left, right = left.where(F.col("la").isin(wanted)), right.where(F.col("la").isin(wanted))
        if ask is not None:
            left, right = left.join(ask, ["la", "lb"], "left_semi"), right.join(ask, ["la", "lb"], "left_semi")
        both = left.join(right, ["a", "b", "seq"], "full").where(~F.col("one").eqNullSafe(F.col("two")))
        differ = common.stored(both.select("a", "b", "seq", "one", "two"), f"merkle-differ-{i}")
        ask = common.small(differ.select(F.col("a").alias("la"), F.col("b").alias("lb")))
        # Few files: their numbers go to the scan, which skips the others' ranges; many: the join alone picks the nodes.
        files = [r["a"] for r in differ.select("a").distinct().limit(MOST_FILES + 1).collect()]
        wanted = files if len(files) <= MOST_FILES else None
    status = F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").otherwise("changed")
    return differ.select(F.col("a").alias("file_no"), F.col("b").alias("offset"), "seq", status.alias("status"))
