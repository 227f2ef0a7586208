"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weight's share of all words, at most ``cap`` times its own words; the excess goes to the
other sources by weight. A source whose target is r times its words takes every document floor(r) whole times. The rest
is a sample without replacement whose size in words is fixed: each document gets an inclusion probability around
f = r - floor(r), tilted towards longer documents (from f * f to 2 * f - f * f, f on the average of all words), and a
random number U that depends on its id; documents are taken in ascending order of U's odds divided by the inclusion
odds, up to the place nearest to the target.

No source is gathered anywhere: a histogram of the order's keys finds the bucket in which the sample ends, and only that
bucket's documents are sorted. The result is a plan of one short row a source, which decides each document by itself.

Edge cases. Null text has size 0; documents of size 0 take nothing. Null sources are one source, last in order. Rows with
the same id and size share U, and stand or fall together. Empty table: empty result. A kept column named like a result
column is replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TOKEN_RE, materialize, uniform

WEIGHTS, CAP, SEED, BUCKETS = (5, 2, 1), 3, "mix-1", 4096
#: Words at which the tilt towards longer documents is half its range.
TILT_WORDS = 400
#: Most sources of a plan that is broadcast (about 200 bytes each); a larger plan is joined by shuffle.
BROADCAST_SOURCES = 100_000

RESULT = ("size", "source_size", "target", "copies", "taken")


def size_of(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(TOKEN_RE)).cast("bigint")


def _tilt(size: Column) -> Column:
    """0 to 1000, whole so that sums are the same in any order."""
    return F.floor(1000 * size / (size + TILT_WORDS)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size and more: adds target. One row a source, so one task sorts them."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    every = Window.partitionBy()
    filled = sources.withColumn("weight", weight).withColumns({"all_size": F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    by_ratio = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all_size") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    filled = filled.withColumns({"place": F.row_number().over(by_ratio), "scale": left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))})
    free = F.when(cap * F.col("source_size") >= F.col("weight") * F.col("scale"), F.struct("place", "scale"))
    filled = filled.withColumn("first_free", F.min(free).over(every))
    capped = F.col("place") < F.col("first_free.place")
    return filled.withColumns({"capped": capped, "target": F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("first_free.scale"))}).drop("weight", "all_size", "all_weight", "place", "scale", "first_free")


def _with_key(df: DataFrame, seed: str, buckets: int) -> DataFrame:
    """Adds q (the order's key) and its bucket; df has __id, size, f and mean_tilt."""
    u = uniform(seed, "__id", "size")
    p = F.col("f") + F.col("f") * (1 - F.col("f")) * (_tilt(F.col("size")) - F.col("mean_tilt")) / 1000
    q = (u / (1 - u)) / (p / (1 - p))
    return df.withColumn("q", F.when(F.col("f") > 0, q)).withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * buckets).cast("int"))


def _on_source(df: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    right = plan.withColumnRenamed("source", "__source")
    return df.join(F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """The plan for documents of __id, source and size (read three times), and its number of sources."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _tilt(F.col("size"))).alias("tilt"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    certain = F.when(F.col("capped"), F.lit(cap)).otherwise(F.floor(ratio)).cast("int")
    shares = targets(sources, weights, cap).withColumn("certain", certain)
    shares = shares.withColumns({"f": F.when(F.col("capped") | (F.col("source_size") == 0), 0.0).otherwise(ratio - F.col("certain")), "mean_tilt": F.when(F.col("source_size") > 0, F.col("tilt") / F.col("source_size")).otherwise(0.0)})
    shares = materialize(shares.select("source", "source_size", "target", "certain", "f", "mean_tilt", (F.col("target") - F.col("certain") * F.col("source_size")).alias("rest")), "mix-targets")
    n = shares.count()
    keyed = _with_key(_on_source(sized, shares.where("f > 0"), n), seed, buckets)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    histogram = keyed.groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    ends = histogram.groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("bucket"))).alias("last_full"),
        F.min(F.when((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("edge"),
    )
    ends = materialize(ends.select("source", F.coalesce("last_full", F.lit(-1)).alias("last_full"), F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before")), "mix-ends")
    inside = _on_source(keyed, ends, n).where(F.col("bucket") == F.col("edge"))
    groups = inside.groupBy("source", "rest", "before", "q", "__id", "size").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("q", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0))
    cut = groups.withColumn("start", start).where(2 * F.col("start") + F.col("words") <= 2 * F.col("rest")).groupBy("source").agg(F.max(F.struct("q", "__id", "size")).alias("cut"))
    plan = shares.join(ends.select(F.col("source").alias("s1"), "last_full", "edge"), F.col("source").eqNullSafe(F.col("s1")), "left")
    plan = plan.join(cut.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return materialize(plan.drop("s1", "s2", "rest"), "mix-plan"), n


def apply_plan(sized: DataFrame, plan: DataFrame, n_sources: int, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Adds source_size, target, copies and taken to rows that have __id, source and size."""
    keyed = _with_key(_on_source(sized, plan, n_sources), seed, buckets)
    at_edge = (F.col("bucket") == F.col("edge")) & (F.struct("q", "__id", "size") <= F.col("cut"))
    drawn = F.coalesce((F.col("f") > 0) & ((F.col("bucket") <= F.col("last_full")) | at_edge), F.lit(False))
    copies = F.col("certain") + drawn.cast("int")
    return keyed.withColumns({"copies": copies.cast("bigint"), "taken": copies * F.col("size")}).drop("certain", "f", "mean_tilt", "q", "bucket", "last_full", "edge", "cut")


def mix(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``keep``, size, source_size, target, copies (how often the mix takes the document) and taken, in words."""
    keep = tuple(c for c in keep if c not in RESULT)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id")
    own_id = [F.col(id_col).alias("__own")] if keep == (id_col,) else []
    sized = materialize(docs.select(key, F.col(source_col).alias("source"), size_of(text_col).alias("size"), *own_id), "mix-sizes")
    plan, n = mixing_plan(sized, weights, cap, seed)
    if own_id:
        return apply_plan(sized, plan, n, seed).select(F.col("__own").alias(id_col), *RESULT)
    rows = docs.select(F.struct(*keep).alias("__row"), key, F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    return apply_plan(rows, plan, n, seed).select("__row.*", *RESULT)


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy")
