"""Quality rules by robust multivariate outliers: per language and source the minimum covariance determinant of transformed
text statistics; a document whose Mahalanobis distance from it is too large is rejected. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .native import SPACES, rolling_hashes, split_words

MIN_WORDS, MAX_REPEATED = 20, 30
SYMBOLS = "[#*$%&|<>]"
REPEAT = 8
#: Share of a group's documents that the estimate covers, and concentration steps from each start.
COVER, STEPS = 0.75, 4
#: Groups with fewer documents to estimate from take the estimate of their language, then of all.
LEAST = 50
#: Variance that every statistic has at least (most texts have no symbol and no repeat at all): that of the square root of a
#: share counted in the shortest text that the base rules pass, 1 / 4n.
FLOOR = 1 / (4 * MIN_WORDS)
#: A document is an outlier beyond this quantile of the chi-squared distribution.
REJECT = 0.999
STATS = ("x1", "x2", "x3", "x4", "x5")
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang, source, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("words", split_words(F.col("text"), SPACES)).withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")))
    base = base.select(
        "doc_id", "lang", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = rolling_hashes(base, "words", REPEAT, "windows").drop("words")
    keep = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    # Only texts in which a window occurs twice go on: windows sorted by hash, those equal to a neighbour, in text order.
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    ordered = rows.select(*keep, F.when(twice, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("s"))
    marked = ordered.select(*keep, "s", F.zip_with("s", F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))).alias("e"))
    marked = marked.select(*keep, F.zip_with(F.zip_with("s", "e", lambda a, b: F.struct(a["i"].alias("i"), b.alias("e"))), F.concat(F.array(F.lit(False)), F.col("e")), lambda a, b: F.when(a["e"] | b, a["i"])).alias("at"))
    marked = marked.select(*keep, F.sort_array(F.filter("at", lambda i: i.isNotNull())).alias("at"))
    covered = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(REPEAT)), F.lit(REPEAT)))
    return marked.select(*keep, F.aggregate(covered, F.lit(0), lambda x, y: x + y).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def transformed() -> list[Column]:
    """Length and word length on a log scale; shares on a square-root scale, which evens out the variance of counts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c: F.sqrt(F.least(F.col(c) / n, F.lit(1.0)))
    return [F.log(n) / 2, F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), share("n_symbols"), share("n_dup_lines"), share("n_repeat_words")]


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


def _cholesky(rows: DataFrame) -> DataFrame:
    """Columns l{i}{j} from the covariances c{i}{j}, a column a projection, so that each is worked out once."""
    for i in range(P):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
            rows = rows.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return rows


def _distance(rows: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(STATS[i]) - F.col(f"m{i}"))
        rows = rows.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))).drop(*[f"y{i}" for i in range(P)])


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(STATS)] + [F.avg(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i, j in PAIRS]
    out = rows.groupBy(*by).agg(*sums)
    return out.select(*by, *[f"m{i}" for i in range(P)], *[(F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOOR if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS])


def _halves(rows: DataFrame, by: list[str], value: Column, share: float, out: str) -> DataFrame:
    """The smallest of value's bins that holds this share of a group: an exact rank over a histogram whose size is bounded, so
    that a hot group is summed map-side."""
    bins = rows.groupBy(*by, value.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    bins = bins.withColumn("_up", F.sum("_n").over(w.orderBy("_bin"))).withColumn("_all", F.sum("_n").over(w))
    return bins.where(F.col("_up") >= share * F.col("_all")).groupBy(*by).agg(F.min("_bin").alias(out))


def _bin(d2: Column) -> Column:
    return F.floor(F.log1p(d2) * 256).cast("int")


def estimates(rows: DataFrame) -> DataFrame:
    """unit, m{i}, l{i}{j}: centre and Cholesky factor of each unit's reweighted minimum covariance determinant.

    rows(unit, x1..x5). Two starts, the mean with the covariance and the medians with median deviations; from each, STEPS
    concentration steps (the COVER nearest documents give the next estimate); the smaller determinant wins.
    """
    rows = common.stored(rows.select("unit", *STATS), "mcd-rows")
    long = rows.select("unit", F.posexplode(F.array(*STATS)).alias("k", "v"))
    centre = _halves(long, ["unit", "k"], F.floor(F.col("v") * 256), 0.5, "mid").withColumn("mid", (F.col("mid") + 0.5) / 256)
    off = long.join(common.small(common.stored(centre, "mcd-centre"), 100_000), ["unit", "k"])
    spread = _halves(off, ["unit", "k", "mid"], F.floor(F.abs(F.col("v") - F.col("mid")) * 256), 0.5, "dev").withColumn("var", F.pow(1.4826 * (F.col("dev") + 0.5) / 256, 2) + FLOOR)
    wide = [F.max(F.when(F.col("k") == i, F.col("mid"))).alias(f"m{i}") for i in range(P)] + [F.max(F.when(F.col("k") == i, F.col("var") if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i, j in PAIRS]
    medians = spread.groupBy("unit").agg(*wide).withColumn("start", F.lit(1))
    now = _moments(rows, ["unit"]).withColumn("start", F.lit(0)).unionByName(medians)
    for _ in range(STEPS):
        now = common.stored(_cholesky(now), "mcd-step")
        placed = _distance(rows.join(common.small(now, 20_000), "unit")).select("unit", "start", *STATS, _bin(F.col("d2")).alias("bin"))
        within = common.stored(_halves(placed, ["unit", "start"], F.col("bin"), COVER, "most"), "mcd-cover")
        now = _moments(placed.join(common.small(within, 100_000), ["unit", "start"]).where("bin <= most"), ["unit", "start"])
    now = _cholesky(now).withColumn("det", sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log(F.col("l00"))))
    best = now.groupBy("unit").agg(F.min(F.struct("det", "start")).alias("b")).select("unit", "b.start")
    now = now.join(best, ["unit", "start"])
    # The covariance of the nearest COVER of a normal sample is too small by this factor; then one reweighting.
    scale = COVER / chi2_cdf(chi2_quantile(COVER, P), P + 2)
    near = _distance(rows.join(common.small(common.stored(now, "mcd-best"), 20_000), "unit")).where(F.col("d2") <= scale * chi2_quantile(0.975, P)).select("unit", *STATS)
    return _cholesky(_moments(near, ["unit"])).drop(*[f"c{i}{j}" for i, j in PAIRS])


def rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (null if base_failed).

    Null text has no words and fails; null lang and source are values of their own; repeated and null doc_ids are rows like
    any other; other columns are ignored; an empty table gives no rows. Groups too small to estimate from share the estimate
    of their language, then of all documents; with fewer than LEAST documents in all, only the base rules decide.
    """
    rows = common.stored(_with_stats(statistics(docs)), "quality-rows")
    return _judged(rows)


def _with_stats(stats: DataFrame) -> DataFrame:
    return stats.withColumn("base_failed", base_failed()).withColumns(dict(zip(STATS, transformed(), strict=True)))


def _judged(rows: DataFrame) -> DataFrame:
    lang, source = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = rows.withColumn("_l", lang).withColumn("_g", F.concat_ws("\u0001", lang, source))
    sizes = rows.where("not base_failed").groupBy("_l", "_g").agg(F.count(F.lit(1)).alias("n"))
    by_lang = sizes.groupBy("_l").agg(F.sum("n").alias("n_l"))
    units = sizes.join(by_lang, "_l").select("_g", F.when(F.col("n") >= LEAST, F.col("_g")).when(F.col("n_l") >= LEAST, F.col("_l")).otherwise("").alias("unit"))
    units = common.small(common.stored(units, "quality-units"), 100_000)
    rows = rows.join(units, "_g", "left").withColumn("unit", F.coalesce("unit", F.lit("")))
    # Those that share an estimate are estimated from all of the language, or all documents, that pass the base rules.
    fit = rows.where("not base_failed").select("_g", "_l", "unit", *STATS)
    shared = fit.select("unit").distinct().where((F.col("unit") == "") | ~F.contains(F.col("unit"), F.lit("\u0001")))
    wider = [r["unit"] for r in shared.orderBy("unit").limit(1001).collect()]
    use = fit.select("unit", *STATS).where(F.contains(F.col("unit"), F.lit("\u0001")))
    langs = fit.select(F.col("_l").alias("unit"), *STATS).join(shared.where("unit <> ''"), "unit", "left_semi")
    use = use.unionByName(langs) if any(wider) else use
    use = use.unionByName(fit.select(F.lit("").alias("unit"), *STATS)) if "" in wider else use
    enough = use.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("unit")
    known = common.stored(estimates(use.join(common.small(enough, 100_000), "unit", "left_semi")), "quality-estimates")
    scored = _distance(rows.join(common.small(known, 20_000), "unit", "left"))
    distance = F.when(~F.col("base_failed"), F.sqrt("d2"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(REJECT, P), F.lit(True))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance"))


def passing(docs: DataFrame) -> DataFrame:
    """docs without the rows that the rules reject; columns stay as they are."""
    h = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    # The verdict depends on these columns alone, so rejected rows are named by their hash.
    with_key = docs.select("doc_id", "text", "lang", "source").withColumn("lang", F.col("lang").cast("string"))
    stats = statistics(with_key.withColumn("doc_id", h))
    rows = common.stored(_with_stats(stats), "quality-rows")
    (name,) = common.free(docs, "_h")
    gone = common.stored(_judged(rows).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "quality-gone")
    return docs.withColumn(name, h).join(common.small(gone), name, "left_anti").select(*docs.columns)
