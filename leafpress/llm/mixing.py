"""Mixing sources to target weights: whole epochs, then Efraimidis-Spirakis sampling to the rest of the token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafpress.llm.common import small, tagged, word_count, written

#: Steps of the sampling keys for each doubling; only the step that holds the budget's end is sorted row by row.
STEPS = 1024
#: Weights are taken within these bounds; none or bad ones (null, NaN, not above 0) as the least.
LEAST, MOST = 1e-300, 1e300


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """sizes (source, source_size) with target and weight.

    Sources by code point (binary order, null last) weigh 1, 2, 3, repeating, and share the sum of all sizes; a target
    stops at cap times its source's size, and the excess is reshared by weight until none is above. That ends where all
    open targets are weight times one level: with the sources sorted by cap over weight, the first k are full, where k
    is the first for which the level of the others lies below the next cap. The window runs over one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    t = sizes.select("source", "source_size", ((F.row_number().over(order) - 1) % 3 + 1).cast("long").alias("weight"))
    t = t.withColumn("most", F.col("source_size") * cap).withColumn("total", F.sum("source_size").over(W.partitionBy()))
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
    t = t.withColumn("open", F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products that a long can't hold
    full = wide("most") * wide("open") <= wide("weight") * wide("left")
    t = t.withColumn("full", F.min(full.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) == 1)
    first = F.min(F.when(~F.col("full"), F.struct(-F.col("open"), F.col("left"), F.col("open").alias("of")))).over(W.partitionBy())
    level = F.col("weight").cast("double") * first["left"].cast("double") / first["of"].cast("double")
    return t.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level).alias("target"))


def sampling_key(id_col: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u in (0, 1) from SHA-256 of seed and id: the same in every run. No or bad weights sort last."""
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    weight = F.when((weight > 0) & ~F.isnan(weight), F.greatest(F.least(weight, F.lit(MOST)), F.lit(LEAST))).otherwise(F.lit(LEAST))
    return -F.log(u) / weight


def text_weight(text: Column, words: Column) -> Column:
    """A plain quality weight in (0, 1] for the query: texts whose words have about six characters (with their separator) weigh 1, others less."""
    return F.when(words > 0, 1.0 / (1.0 + F.abs(F.length(text) / words - 6.0))).otherwise(F.lit(1.0))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, seed: str) -> DataFrame:
    """docs with a tag for each row (the same in every scan), its id, source, size, sampling key and the key's step."""
    text = F.col(text_col)
    rows = tagged(docs).withColumns({"__id": F.col(id_col), "__source": F.col(source_col).cast("string"), "__size": word_count(text)})
    rows = rows.withColumn("__weight", (text_weight(text, F.col("__size")) if weight is None else weight).cast("double"))
    rows = rows.withColumn("__key", sampling_key(F.col("__id"), F.col("__weight"), seed))
    return rows.withColumn("__step", F.floor(F.log2("__key") * STEPS).cast("int")).drop("__weight")


def _plan(base: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """For each source its target, epochs and the step in which its budget ends; and for the rows of those steps, whether they are taken once more.

    A source may hold a third of all rows: its keys are cut into steps, whose sums (map-side combined) say in which step
    the budget ends; only that step's rows are sorted. Steps before it are taken, steps after it are not. The steps are even
    in the key's logarithm, where the density of -ln(u) is at most 1/e whatever the weight: a step expects at most
    1/e * ln(2) / STEPS, one in 3900, of a source's rows, for any mixture of weights.
    """
    sums = written(base.groupBy("__source", "__step").agg(F.sum("__size").alias("words")), "mix-steps")
    aims = targets(sums.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size")), cap)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aims = written(aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    run = F.sum("words").over(W.partitionBy("__source").orderBy("__step").rowsBetween(W.unboundedPreceding, 0))
    ends = sums.withColumn("upto", run).join(aims.select("source", "rest"), F.col("__source").eqNullSafe(F.col("source"))).filter((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
    ends = ends.select(F.col("__source").alias("s"), F.col("__step").alias("end_step"), (F.col("upto") - F.col("words")).alias("before"))
    aims = written(aims.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnsRenamed({c: f"__aim_{c}" for c in ("source", "source_size", "target", "epochs", "rest", "end_step", "before")}), "mix-ends")
    order = W.partitionBy("__source").orderBy("__key", F.col("__id").isNull(), "__id", "__size", "__row").rowsBetween(W.unboundedPreceding, -1)
    last = base.join(small(aims), F.col("__source").eqNullSafe(F.col("__aim_source"))).filter(F.col("__step") == F.col("__aim_end_step"))
    cum = F.col("__aim_before") + F.coalesce(F.sum("__size").over(order), F.lit(0))
    last = last.select(F.col("__row").alias("__last"), (cum + F.col("__size") / 2 <= F.col("__aim_rest")).cast("long").alias("__more"))
    return aims, written(last, "mix-last")


def _decided(rows: DataFrame, aims: DataFrame, last: DataFrame) -> DataFrame:
    """rows with their source's aims and __copies. The aims (a row for each source) and the rows in end steps are broadcast if few."""
    rows = rows.join(small(aims), F.col("__source").eqNullSafe(F.col("__aim_source"))).join(small(last), F.col("__row") == F.col("__last"), "left")
    # a source without an end step has a rest of 0, or no words at all
    more = F.when(F.col("__step") == F.col("__aim_end_step"), F.coalesce("__more", F.lit(0))).when(F.col("__step") < F.col("__aim_end_step"), F.lit(1)).otherwise(F.lit(0))
    return rows.withColumn("__copies", F.col("__aim_epochs") + F.when(F.col("__size") > 0, more).otherwise(F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, taken (words the mix takes), copies.

    Every source's target is made of as many whole epochs as fit; the rest is filled in the order of the sampling keys
    (ties by id, nulls last, then size) by whole documents, up to the one whose middle lies beyond it: the error is at
    most half a document. Documents without words have size 0 and are never taken more often than the epochs.
    Null texts have no words; null sources are a source. Empty input gives an empty result. weight: a column of docs'
    quality weights (default: text_weight).
    """
    keyed = _keyed(docs, id_col, text_col, source_col, weight, seed)
    base = written(keyed.select("__row", "__id", "__source", "__size", "__key", "__step"), "mix-sizes")
    out = _decided(base, *_plan(base, cap))
    return out.select(F.col("__id").alias("id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__aim_source_size").alias("source_size"), F.col("__aim_target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: each row of docs as often as mix() says, with all its columns. No texts are shuffled unless the
    rows in end steps are too many to broadcast their tags."""
    keyed = _keyed(docs, id_col, text_col, source_col, weight, seed)
    base = written(keyed.select("__row", "__id", "__source", "__size", "__key", "__step"), "mix-sizes")
    out = _decided(keyed, *_plan(base, cap))
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
