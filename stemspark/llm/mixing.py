"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree. DataFrame functions only.

A node shares its token budget among its children by their weights; a child that can't use its share (capacity: its tokens
times `epochs`) leaves the rest to its siblings, and only what all of them together can't use goes up to the parent's
siblings. A leaf with a budget of k times its tokens and some more takes every document k times and the longest prefix of
epoch k + 1 that fits; each epoch has its own seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .native import SPACES

LEVELS = ("domain", "lang", "source")
#: A leaf's order is cut into 256 hash ranges, and the one in which the budget ends into 256 again: ranges are summed, and only
#: the last one in which the budget ends is put in order.
CUTS = 2
NONE = "(none)"


@dataclass(frozen=True)
class Mix:
    """weights: by level, by the child's name; a child without one weighs 1. share: the budget as a share of all tokens."""

    share: float = 0.75
    epochs: int = 3
    seed: int = 17
    weights: dict[str, dict[str, float]] = field(default_factory=dict)


def domain_of(source: Column) -> Column:
    """The domain of a table that has no such column: three groups of sources by their name's last digit."""
    return F.translate(F.right(source, F.lit(1)), "0123456789", "aaaabbbccc")


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1.0)
    for name, weight in sorted(mix.weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
    return out


def _shared(children: DataFrame, parent: list[str], mix: Mix) -> DataFrame:
    """children(*parent, level, capacity, given = the parent's budget) with their own budgets: the level to which shares fill is
    found over the children in the order in which they are full; the reach of the first that isn't filled, the largest."""
    level = LEVELS[len(parent)]
    rows = children.withColumn("weight", _weight(level, mix)).withColumn("full_at", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(float("inf")))
    w = Window.partitionBy(*parent).orderBy("full_at", level)
    rest = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("before", F.coalesce(F.sum("capacity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("weights", F.sum("weight").over(rest))
    rows = rows.withColumn("reach", F.when(F.col("weights") > 0, (F.col("given") - F.col("before")) / F.col("weights")).otherwise(0.0))
    everyone = Window.partitionBy(*parent)
    rows = rows.withColumn("line", F.max(F.when(F.col("full_at") > F.col("reach"), F.col("reach"))).over(everyone))
    budget = F.when(F.col("line").isNull() | (F.col("full_at") <= F.col("line")), F.col("capacity")).otherwise(F.col("weight") * F.col("line"))
    return rows.select(*parent, level, "capacity", budget.cast("double").alias("given"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, budget (whole tokens) from leaves(domain, lang, source, tokens)."""
    leaves = leaves.withColumn("capacity", (F.col("tokens") * mix.epochs).cast("double"))
    total = leaves.agg(F.floor(F.sum("tokens") * F.lit(mix.share)).cast("double").alias("given"))
    given: DataFrame = total
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = leaves.groupBy(*LEVELS[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(given.select(*parent, "given"), parent) if parent else nodes.crossJoin(F.broadcast(given))  # one row
        given = _shared(nodes, parent, mix)
    return given.select(*LEVELS, F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def epochs_of(rows: DataFrame, mix: Mix) -> DataFrame:
    """rows(doc_id, domain, lang, source, tokens, ...) with budget, epochs (copies of the document to take) and of_last (whether the
    prefix of the last epoch holds it). Documents without tokens cost nothing and go with the range they lie in."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = common.stored(leaves, "mix-leaves")
    plan = budgets(leaves, mix).join(leaves.withColumnRenamed("tokens", "leaf_tokens"), list(LEVELS))
    full = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("budget") / F.col("leaf_tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("leaf_tokens"))
    plan = common.small(common.stored(plan, "mix-plan"), 100_000)
    # A null doc_id is written as nothing; the text's digest keeps rows with one id, or none, from falling into one range.
    keyed = rows.join(plan, list(LEVELS)).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("full") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("order"))))
    keyed = keyed.withColumn("spent", F.lit(0).cast("long"))
    decided = []
    for cut in range(CUTS):
        keyed = keyed.withColumn("range", F.substring("key", 1 + 2 * cut, 2))
        sums = keyed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("of_range"))
        w = Window.partitionBy(*LEVELS).orderBy("range")  # 256 rows a leaf
        sums = sums.withColumn("upto", F.sum("of_range").over(w)).withColumn("before", F.col("upto") - F.col("of_range"))
        spent = common.stored(keyed.groupBy(*LEVELS).agg(F.first("spent").alias("spent"), F.first("rest").alias("rest")), "mix-spent")
        ends = sums.join(spent, list(LEVELS)).where("spent + before <= rest and spent + upto > rest")
        ends = ends.groupBy(*LEVELS).agg(F.min("range").alias("end_range"), F.min(F.col("spent") + F.col("before")).alias("end_spent"))
        ends = common.small(common.stored(ends, "mix-ends"), 100_000)
        keyed = keyed.join(ends, list(LEVELS), "left")
        outside = keyed.where("end_range is null or range <> end_range")
        decided.append(outside.withColumn("of_last", F.col("end_range").isNull() | (F.col("range") < F.col("end_range"))).drop("range", "end_range", "end_spent", "spent"))
        keyed = keyed.where("range = end_range").withColumn("spent", F.col("end_spent")).drop("range", "end_range", "end_spent")
    order = Window.partitionBy(*LEVELS).orderBy("key", "tokens", "row")
    inside = keyed.withColumn("of_last", F.col("spent") + F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= F.col("rest")).drop("spent")
    both = inside
    for d in decided:
        both = both.unionByName(d)
    # A leaf whose budget is a whole number of epochs has no prefix left to take, unless it has no tokens at all.
    both = both.withColumn("of_last", F.col("of_last") & ((F.col("rest") > 0) | (F.col("leaf_tokens") == 0)))
    return both.withColumn("epochs", F.col("full") + F.col("of_last").cast("long"))


def mixed(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, leaf_tokens, budget, epochs for every row of docs(doc_id, text, lang, source).

    Null text has no tokens; null domain, lang and source are the child "(none)"; null and repeated doc_ids are rows like any
    other (only rows with the same doc_id and text are neighbours in a leaf's order); other columns are ignored; an empty table
    gives no rows. A leaf's order is never sorted as a whole.
    """
    domain = domain_of(F.col("source").cast("string")) if domain is None else domain
    names = {"domain": domain, "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(c, F.lit(NONE)).alias(n) for n, c in names.items()], tokens_of(F.col("text").cast("string")).alias("tokens"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("order"))
    rows = common.stored(rows, "mix-rows")
    out = epochs_of(rows, mix)
    return out.select("doc_id", *LEVELS, F.col("tokens").alias("n_tokens"), "leaf_tokens", "budget", "epochs", "row")


def taken(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """docs' rows as often as the mix takes them; columns stay as they are."""
    domain_ = domain_of(F.col("source").cast("string")) if domain is None else domain
    key = F.struct(F.col("doc_id").cast("long").alias("i"), F.coalesce(domain_, F.lit(NONE)).alias("d"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("l"), F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("s"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    # Rows that agree in all of this are alike for the mix: the verdict is a list of epochs, dealt to them by their number.
    verdict = mixed(docs, mix, domain).select(F.xxhash64("doc_id", "domain", "lang", "source", "row").alias("_k"), "epochs")
    alike = verdict.groupBy("_k").agg(F.min("epochs").alias("_least"), F.sum("epochs").alias("_all"), F.count(F.lit(1)).alias("_n"))
    alike = common.stored(alike, "mix-verdict")
    k = F.xxhash64(key["i"], key["d"], key["l"], key["s"], key["h"])
    name, verdict_, times, i = common.free(docs, "_k", "_verdict", "_times", "_i")
    alike = alike.select(F.col("_k").alias(name), F.struct(F.col("_least").alias("least"), F.col("_all").alias("all"), F.col("_n").alias("n")).alias(verdict_))
    joined = docs.withColumn(name, k).join(common.small(alike), name)
    v = F.col(verdict_)
    uneven = (v["n"] > 1) & (v["all"] != v["least"] * v["n"])
    plain = joined.where(~uneven).withColumn(times, v["least"])
    mixed_ = joined.where(uneven).withColumn(i, F.row_number().over(Window.partitionBy(name).orderBy(verdict_)))
    mixed_ = mixed_.withColumn(times, v["least"] + F.when(F.col(i) <= v["all"] - v["least"] * v["n"], 1).otherwise(0)).drop(i)
    both = plain.unionByName(mixed_).where(F.col(times) > 0)
    both = both.withColumn(i, F.explode_outer(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return both.select(*docs.columns)


def oracle_sql(mix: Mix) -> str:
    """The same by SQL, for tables whose leaves can be sorted."""

    def weight(level: str) -> str:
        arms = " ".join(f"WHEN {level} = '{n}' THEN {float(w)}" for n, w in sorted(mix.weights.get(level, {}).items()))
        return f"CAST(CASE {arms} ELSE 1.0 END AS DOUBLE)" if arms else "CAST(1.0 AS DOUBLE)"

    def share(name: str, source: str, depth: int) -> str:
        level, parent = LEVELS[depth], ", ".join(LEVELS[:depth])
        part = f"PARTITION BY {parent}" if parent else ""
        cols = ", ".join(LEVELS[: depth + 1])
        return f"""
    {name}_a AS (SELECT *, {weight(level)} AS w FROM ({source})),
    {name}_b AS (SELECT *, capacity / w AS full_at FROM {name}_a),
    {name}_c AS (SELECT *,
        (given - coalesce(sum(capacity) OVER ({part} ORDER BY full_at, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER ({part} ORDER BY full_at, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM {name}_b),
    {name}_d AS (SELECT *, max(CASE WHEN full_at > reach THEN reach END) OVER ({part}) AS line FROM {name}_c),
    {name} AS (SELECT {cols}, capacity, CASE WHEN line IS NULL OR full_at <= line THEN capacity ELSE w * line END AS given FROM {name}_d)"""

    capacity = f"CAST(sum(tokens) * {mix.epochs} AS DOUBLE) AS capacity"
    return f"""
WITH rows AS (SELECT doc_id, coalesce(translate(right(source, 1), '0123456789', 'aaaabbbccc'), '{NONE}') AS domain,
        coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS digest FROM documents),
    leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows GROUP BY ALL),
    total AS (SELECT CAST(floor(sum(tokens) * CAST({mix.share} AS DOUBLE)) AS DOUBLE) AS given FROM leaves),
    {share("n1", f"SELECT domain, {capacity}, any_value(given) AS given FROM leaves, total GROUP BY domain", 0)},
    {share("n2", f"SELECT l.domain, l.lang, {capacity}, any_value(n1.given) AS given FROM leaves l JOIN n1 ON l.domain = n1.domain GROUP BY l.domain, l.lang", 1)},
    {share("n3", f"SELECT l.domain, l.lang, l.source, {capacity}, any_value(n2.given) AS given FROM leaves l JOIN n2 ON l.domain = n2.domain AND l.lang = n2.lang GROUP BY l.domain, l.lang, l.source", 2)},
    plan AS (SELECT n3.domain, n3.lang, n3.source, CAST(floor(n3.given + 1e-6) AS BIGINT) AS budget, l.tokens AS leaf_tokens
        FROM n3 JOIN leaves l ON n3.domain = l.domain AND n3.lang = l.lang AND n3.source = l.source),
    plan2 AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN budget // leaf_tokens ELSE 0 END AS f FROM plan),
    ordered AS (SELECT r.*, p.budget, p.leaf_tokens, p.f, p.budget - p.f * p.leaf_tokens AS rest,
        sum(r.tokens) OVER (PARTITION BY r.domain, r.lang, r.source
            ORDER BY md5('{mix.seed}:' || (p.f + 1) || ':' || coalesce(CAST(r.doc_id AS VARCHAR), '') || ':' || r.digest), r.tokens ROWS UNBOUNDED PRECEDING) AS upto
        FROM rows r JOIN plan2 p ON r.domain = p.domain AND r.lang = p.lang AND r.source = p.source)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, leaf_tokens, budget,
    CAST(f + CASE WHEN upto <= rest AND (rest > 0 OR leaf_tokens = 0) THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM ordered"""
