"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fixity, hamming_index, licences, mixing, passages, quality, sstable, weighted_minhash, zclassifier
from .common import table

END_ID = 2
MIX = mixing.Mix(
    share=0.75,
    epochs=3,
    weights={"domain": {"a": 3.0, "b": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0}, "source": {"src0": 2.0}},
)
#: The damage of the audited replica by a page's number: its record is altered, or lost, or has a second one beside it.
ALTERED, LOST, ADDED = (97, 5), (101, 7), (103, 11)


def op1_sorted_string_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op2_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.spans(table(spark, sf_dir, "documents"))


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op4_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), MIX).drop("row")


def op5_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return zclassifier.score(docs, zclassifier.fit(docs, table(spark, sf_dir, "labels")))


def op6_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def damaged(pages: DataFrame) -> DataFrame:
    """The replica's pages: bytes of some altered, some others lost, some records that the primary lacks."""
    hit = lambda rule: F.coalesce(F.pmod("page_id", F.lit(rule[0])) == rule[1], F.lit(False))
    added = pages.where(hit(ADDED)).withColumn("page_id", -F.col("page_id") - 1)
    return pages.where(~hit(LOST)).withColumn("html", F.when(hit(ALTERED), F.concat(F.lit("x"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))).unionByName(added)


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = fixity.archived(pages)
    found = fixity.audit(archive, fixity.replica(damaged(pages), archive))
    return found.join(archive, fixity.KEY, "left").select("page_id", "file_no", "offset", "seq", "length", "copies", "status")


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.classes(table(spark, sf_dir, "documents"))


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming_index.search(vectors, vectors.where("vec_id % 100 = 0"))


def op10_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_sorted_string_shards, op2_paragraph_minhash, op3_robust_outliers, op4_hierarchical_budget, op5_compression_classifier, op6_diagonal_voting, op7_merkle_audit, op8_weighted_minhash, op9_multi_index_hashing, op10_two_tier_bpe)}

_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""
_DIGEST = "sha256(coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || rec)"


def _levels_sql(side: str) -> str:
    """Ranges and files of one replica's tree, from its records; the levels above only group files."""
    text = "string_agg(concat_ws(':', {}), ',' ORDER BY {})".format
    return f"""{side}_range AS (SELECT file_no, "offset" // {fixity.RANGE} AS r, sha256({text('file_no, "offset", seq, digest', 'file_no, "offset", seq')}) AS digest FROM {side} GROUP BY ALL),
    {side}_file AS (SELECT file_no, sha256({text('file_no, r, 0, digest', 'r')}) AS digest FROM {side}_range GROUP BY ALL)"""


_DIFFER = "SELECT {0} FROM one_{1} FULL JOIN two_{1} USING ({0}) WHERE one_{1}.digest IS DISTINCT FROM two_{1}.digest".format
_AUDIT = f"""
WITH r AS (SELECT page_id, {_RECORD} AS rec FROM pages),
    d AS (SELECT page_id, {_DIGEST} AS digest, CAST(strlen(rec) AS BIGINT) AS length FROM r),
    n AS (SELECT greatest(0, CAST(ceil(log2(greatest(count(*), 1) / {fixity.FILE_RECORDS}.0) / 4) AS INT)) AS digits FROM pages),
    c AS (SELECT digest, page_id, length, count(*) AS copies FROM d GROUP BY ALL),
    f AS (SELECT c.*, CASE WHEN digits = 0 THEN 0 ELSE CAST('0x' || substring(digest, 1, digits) AS BIGINT) END AS file_no FROM c, n),
    one AS MATERIALIZED (SELECT *, row_number() OVER w AS seq, CAST(coalesce(sum(length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM f WINDOW w AS (PARTITION BY file_no ORDER BY digest, page_id)),
    harmed AS (SELECT page_id, url, CASE WHEN page_id % {ALTERED[0]} = {ALTERED[1]} THEN 'x' || coalesce(html, '') ELSE html END AS html FROM pages WHERE coalesce(page_id % {LOST[0]} <> {LOST[1]}, true)
        UNION ALL SELECT -page_id - 1, url, html FROM pages WHERE page_id % {ADDED[0]} = {ADDED[1]}),
    hr AS (SELECT page_id, {_RECORD} AS rec FROM harmed), h AS (SELECT DISTINCT page_id, {_DIGEST} AS digest FROM hr),
    ends AS (SELECT file_no, max("offset" + length) AS e, max(seq) AS s FROM one GROUP BY 1),
    new AS (SELECT h.digest, CASE WHEN digits = 0 THEN 0 ELSE CAST('0x' || substring(h.digest, 1, digits) AS BIGINT) END AS file_no FROM h, n WHERE page_id < 0),
    two AS MATERIALIZED (SELECT file_no, "offset", seq, h.digest FROM one JOIN h USING (page_id)
        UNION ALL SELECT file_no, coalesce(e, 0), coalesce(s, 0) + row_number() OVER (PARTITION BY file_no ORDER BY digest), digest FROM new LEFT JOIN ends USING (file_no)),
    {_levels_sql("one")}, {_levels_sql("two")},
    files AS ({_DIFFER('file_no', 'file')}), ranges AS ({_DIFFER('file_no, r', 'range')}),
    a AS (SELECT * FROM one WHERE file_no IN (FROM files) AND (file_no, "offset" // {fixity.RANGE}) IN (FROM ranges)),
    b AS (SELECT * FROM two WHERE file_no IN (FROM files) AND (file_no, "offset" // {fixity.RANGE}) IN (FROM ranges))
SELECT page_id, file_no, "offset", seq, length, copies, CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (file_no, "offset", seq) WHERE a.digest IS DISTINCT FROM b.digest"""

ORACLES = {"op4_hierarchical_budget": mixing.oracle_sql(MIX), "op7_merkle_audit": _AUDIT}
