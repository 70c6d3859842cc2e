"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws u in (0, 1) from its id and has the key u ** (1 / weight),
weight being its quality; the largest keys come first. A source's budget first
takes complete epochs (every document once), then documents in order of their
keys until the rest of the budget is used; the last of them is taken in part.

Prefix sums need no task that holds a source: keys are dealt into 256 slices and
each into 256 parts by their leading bits, sums of slices and parts are summed in
front, and only the documents of one part are ordered together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldmill.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of labelled quality 0, quality 1 and of documents without a label.
LOW, HIGH, UNKNOWN = 0.5, 1.0, 0.75
WEIGHTS = (5.0, 2.0, 1.0)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw): words of each text, a null text has none; and what the draw is made from, the id or else the text."""
    draw = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5("text")), F.lit("null")).alias("draw")
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), draw)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): share of all words dealt by weight; none above most times its source's size.

    Sources stand in order of code points, null last, and take the weights in turn.
    The excess of full sources goes to the others by weight, again and again; the
    outcome is one level that all others reach, found by a prefix sum over the
    sources in order of their limit to weight ratio. This table has one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", F.lit(most) * F.col("source_size"))
    per = per.withColumn("ratio", F.col("full") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("budget", F.lit(share) * F.sum("source_size").over(Window.partitionBy(F.lit(1))))
        .withColumn("filled", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    )
    per = per.withColumn("level", (F.col("budget") - F.col("filled")) / F.col("left"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("final", level)
    return per.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("full")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def quality(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """docs with a weight from the labelled quality; of several labels the least counts."""
    if labels is None:
        return docs.withColumn("weight", F.lit(UNKNOWN))
    least = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("least"))
    weight = F.when(F.col("least") >= 1, HIGH).when(F.col("least") < 1, LOW).otherwise(UNKNOWN)
    return docs.join(least, "doc_id", "left").withColumn("weight", weight).drop("least")


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) for each row of docs.

    taken counts words with their repeats: epochs times the size, and the words
    taken from the fractional epoch. The taken words of a source come within one
    word of its target. A null id draws by its text; a null source is a source;
    repeated rows draw alike and stand one behind the other; a very long text is one
    size like any other; other columns are not read, whatever their names; no rows, no result.
    """
    sized = quality(written(sizes(docs)), labels)
    goal = targets(sized.select("source", "size"), weights, share, most)
    goal = goal.withColumn("whole", F.round("target").cast("long"))
    goal = goal.withColumn("epochs", F.expr("if(source_size = 0, 0L, whole div source_size)"))
    goal = goal.withColumn("rest", F.col("whole") - F.col("epochs") * F.col("source_size"))
    drawn = F.conv(F.substring(F.md5("draw"), 1, 13), 16, 10).cast("double")
    keyed = sized.withColumn("key", F.pow((drawn + 0.5) / float(1 << 52), 1.0 / F.col("weight")))
    part = F.least(F.floor((1.0 - F.col("key")) * 65536), F.lit(65535)).cast("int")
    keyed = keyed.withColumn("part", part).withColumn("slice", F.expr("part div 256"))
    sums = keyed.groupBy("source", "slice", "part").agg(F.sum("size").alias("words"))
    slices = sums.groupBy("source", "slice").agg(F.sum("words").alias("words"))
    front = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("s1"), F.col("slice").alias("c1"), F.coalesce(F.sum("words").over(front), F.lit(0)).alias("ahead"))
    front = Window.partitionBy("source", "slice").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s2"), "slice", F.col("part").alias("p2"), F.coalesce(F.sum("words").over(front), F.lit(0)).alias("within"))
    sums = sums.join(slices, F.col("s2").eqNullSafe(F.col("s1")) & (F.col("slice") == F.col("c1")))
    sums = sums.join(goal.withColumnRenamed("source", "s3"), F.col("s2").eqNullSafe(F.col("s3")))
    sums = sums.select("s2", "p2", (F.col("ahead") + F.col("within")).alias("front"), "source_size", "target", "epochs", "rest")
    own = Window.partitionBy("source", "part").orderBy(F.col("key").desc(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    out = keyed.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    some = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("front") - F.col("own")))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + some).cast("long").alias("taken"))
