"""Mixing sources to target weights by entropy balancing.

Method: rates r between 0 and the cap minimise sum(size * (r ln r - r)) under one token constraint
a source, sum(size * r) = target. The dual is convex; its optimum tilts every document's rate
exponentially, r = min(cap, exp(lambda of its source)). Each Newton step sums gradient and curvature
over the documents, held as classes of equal size, by an aggregation on the executors, and moves all
sources' lambdas at once. Rates are then rounded into whole copies: floor(r) for all documents of the
source, and one more for documents in hash order until their words fill the remaining fraction. Hash
order is dealt in 4,096 buckets whose sums are accumulated, so only the bucket in which the threshold
falls is sorted, never a whole source. At last one more document is taken, one given back, or one
exchanged for another, by the sizes that come closest to the gap that is left.

Null text: size 0, taken 0. A null source is a source of its own, last in order. Sources without
words have target 0. Repeated rows are separate documents. Reruns agree: order depends on a hash
of the id and size only; of equally good exchanges the one of the smallest sizes is made, of equal
documents the first in hash order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, measured, repeats_ids

BUCKETS = 4096


def word_count(text):
    """Words of a text column as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size): weights repeat over sources in code-point order, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w)
    # Filling by weight with caps: the sources that reach their cap are those of least size for their weight.
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(every)).withColumn("share", (F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest))
    per = per.withColumn("open", F.col("share") * F.col("w") <= cap * F.col("source_size"))
    # The first source in that order that stays under its cap sets the level for itself and the rest.
    per = per.withColumn("at", F.row_number().over(by_ratio)).withColumn("level", F.min(F.when(F.col("open"), F.struct("at", "share"))).over(every)["share"])
    target = F.least(cap * F.col("source_size"), F.coalesce(F.col("level") * F.col("w"), cap * F.col("source_size")))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def newton_rates(classes: DataFrame, targets: DataFrame, cap: float = 3.0, steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """``targets`` (source, target, ...) with ``tilt`` (lambda) and ``rate``: Newton's iteration on the dual.

    ``classes``: (source, size, n), documents of equal size. Sources without words or target have rate 0.
    """
    now = materialise(targets.withColumn("tilt", F.lit(0.0)).withColumn("move", F.lit(1.0)), "tilts")
    c = classes.alias("c")
    for _ in range(steps):
        t = now.alias("t")
        words = (F.col("c.n") * F.col("c.size")).cast("double")
        rate = F.exp("t.tilt")
        mass = F.sum(words * F.least(rate, F.lit(cap)))
        curve = F.sum(F.when(rate < cap, words * rate).otherwise(0.0))
        sums = c.join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).groupBy("c.source").agg(mass.alias("mass"), curve.alias("curve")).select(F.col("source").alias("s"), "mass", "curve", F.lit(1).alias("met"))
        gradient = F.col("mass") - F.col("target")
        # Above the bound the dual is flat: a step down leads back, unless the bound is where the target lies.
        newton = F.when(F.col("curve") > 0, gradient / F.col("curve")).when(gradient > tolerance * F.col("target"), F.lit(0.5)).otherwise(0.0)
        move = F.when(F.col("met").isNull() | (F.col("target") <= 0) | (F.abs(gradient) <= tolerance * F.col("target")), 0.0).otherwise(F.greatest(F.lit(-2.0), F.least(F.lit(1.0), newton)))
        stepped = now.drop("move").join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("move", move).withColumn("tilt", F.col("tilt") - F.col("move")).select(*now.columns)
        last, now = now, materialise(stepped, "tilts")
        discard(last)
        if not now.where("move <> 0").limit(1).count():
            break
    has = now.join(classes.select(F.col("source").alias("s")).distinct(), F.col("source").eqNullSafe(F.col("s")), "left_semi").select(F.col("source").alias("s"), F.lit(1).alias("met"))
    rated = now.drop("move").join(has, F.col("source").eqNullSafe(F.col("s")), "left")
    return rated.withColumn("rate", F.when(F.col("met").isNotNull() & (F.col("target") > 0), F.least(F.exp("tilt"), F.lit(cap))).otherwise(0.0)).drop("s", "met")


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(id, source, size, order, source_size, target, rate, copies): whole copies of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = materialise(rows.select("*", F.xxhash64("id", "size").alias("order"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    classes = materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-classes")
    targets = source_targets(classes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, cap)
    rated = materialise(newton_rates(classes.where("size > 0"), targets, cap).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int")), "mix-rates")
    bucket = F.pmod("order", F.lit(BUCKETS))
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    a, b = sums.alias("a"), rated.alias("b")
    plan = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "bucket", "before", "n", "source_size", "target", "rate", "whole")
    extra = F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    # Words that this bucket may add beyond whole copies: all, none, or part of them.
    plan = plan.withColumn("room", F.least(F.col("n").cast("double"), extra - F.col("before"))).withColumn("state", F.when(F.col("n") == 0, 0).when(F.col("room") >= F.col("n"), 1).when(F.col("room") <= 0, 0).otherwise(2))
    d, p = rows.withColumn("bucket", bucket).alias("d"), plan.alias("p")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))).select("d.id", "d.source", "d.size", "d.order", "d.row", "d.bucket", "source_size", "target", "rate", "whole", "room", "state")
    joined = materialise(joined, "mix-dealt")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # In the bucket of the threshold a document is taken while at least half of it fits.
    part = joined.where("state = 2").withColumn("more", (F.sum("size").over(inside) - F.col("size") / 2 <= F.col("room")).cast("int"))
    out = part.unionByName(joined.where("state <> 2").withColumn("more", F.col("state"))).drop("room", "state", "bucket")
    out = _exchange(materialise(out, "mix-copies"), cap)
    return out.withColumn("copies", (F.col("whole") + F.col("more")).cast("long")).select("id", "source", "size", "order", "source_size", "target", "rate", "copies")


def _exchange(plan: DataFrame, cap: float) -> DataFrame:
    """``more`` changed for at most two documents of a source: one taken, one given back, or both, as comes nearest to the target."""
    gaps = plan.groupBy("source").agg((F.first("target") - F.sum((F.col("whole") + F.col("more")) * F.col("size"))).alias("gap")).select(F.col("source").alias("s"), "gap")
    sizes = plan.where((F.col("size") > 0) & ((F.col("more") == 1) | (F.col("whole") + 1 <= cap))).select("source", "size", "more").distinct()
    sizes = sizes.unionByName(gaps.select(F.col("s").alias("source"), F.lit(0).cast("long").alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("more")))
    placed = sizes.join(gaps, F.col("source").eqNullSafe(F.col("s"))).select("source", "gap", "size", "more", (F.col("size") + F.when(F.col("more") == 1, F.col("gap")).otherwise(0.0)).alias("at"))
    # A size given back lies where the size taken for it would close the gap: its neighbours in that order are the best.
    along = Window.partitionBy("source").orderBy("at", "more")
    free = F.when(F.col("more") == 0, F.col("size"))
    sided = placed.withColumn("low", F.last(free, True).over(along)).withColumn("high", F.first(free, True).over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))).where("more = 1")
    tried = sided.select("source", "gap", F.col("size").alias("out"), "at", F.explode(F.array("low", "high")).alias("into")).where("into is not null")
    best = tried.withColumn("left", F.abs(F.col("at") - F.col("into"))).where(F.col("left") < F.abs(F.col("gap")))
    best = best.groupBy("source").agg(F.min(F.struct("left", "into", "out")).alias("best")).select(F.col("source").alias("s"), "best.into", "best.out")
    hit = F.when(F.col("more") == 0, F.col("into")).otherwise(F.col("out")) == F.col("size")
    chosen = plan.join(measured(best, 100_000), F.col("source").eqNullSafe(F.col("s"))).where((F.col("size") > 0) & hit & ((F.col("more") == 1) | (F.col("whole") + 1 <= cap)))
    flips = chosen.groupBy("source", "more").agg(F.min(F.struct("order", "id", "row")).alias("one")).select(F.col("one.row").alias("row"), F.lit(1).alias("flip"))
    return plan.join(flips, "row", "left").withColumn("more", F.when(F.col("flip") == 1, 1 - F.col("more")).otherwise(F.col("more"))).drop("flip")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0 to ``cap`` times). Wordless rows are kept once: they cost nothing.

    Rows that repeat an id and size share the mean of their copies, rounded by rank.
    """
    copies = mix_copies(docs, id_col, text_col, source_col, weights, cap)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("__copies")
    if repeats_ids(docs, id_col):
        key = Window.partitionBy("id", "source", "size").orderBy("copies")
        plan = copies.withColumn("nth", F.row_number().over(key)).select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("nth").alias("__nth"), times)
        here = docs.withColumn("__s", word_count(F.col(text_col)))
        here = here.withColumn("__n", F.row_number().over(Window.partitionBy(id_col, F.col(source_col).cast("string"), "__s").orderBy(F.xxhash64(text_col))))
        on = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source")) & (F.col("__s") == F.col("__size")) & (F.col("__n") == F.col("__nth"))
    else:
        here, plan = docs, measured(materialise(copies.select(F.col("id").alias("__id"), times), "mix-plan"))
        on = F.col(id_col).eqNullSafe(F.col("__id"))
    joined = here.join(plan, on).where("__copies > 0")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))).select(*docs.columns)
