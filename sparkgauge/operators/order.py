"""Numbering rows, and counting runs of them, in a global order without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

#: Bits of a row's place in its partition in the numbers that Spark gives.
_PLACE = 33


def settled(rows: DataFrame) -> DataFrame:
    """The same rows however often they are read: a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names, which a lost executor
    does not touch.  Where none is set, a single machine's session keeps them; on a cluster that is an error, as rows made again may differ."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir():
        return rows.checkpoint()
    if own := sc.getConf().get("spark.checkpoint.dir"):
        sc.setCheckpointDir(own)
        return rows.checkpoint()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _sorted(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """The rows sorted over the cluster by range and settled, with ``_id`` in that order and ``_part``, the range; several passes see the same ranges."""
    placed = settled(rows.orderBy(*by, *order).withColumn("_id", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_id", _PLACE))


def runs(rows: DataFrame, by: list[str], order: list[str | Column], hit: Column, name: str) -> DataFrame:
    """Adds ``name``: how many rows in a row, up to this one, are hits, within each group of ``by`` in the order of ``order``.

    A segmented scan: runs are counted within the ranges of a sort; a range's summary (its groups at both ends, whether a run goes through all of it,
    the run at its end) is combined with those before it, and what comes out is added to the run that a range begins with.  No task holds
    more than a range, however many rows a group has.
    """
    here = Window.partitionBy("_part").orderBy("_id")
    group = F.struct(*by) if by else F.struct(F.lit(0))
    placed = _sorted(rows.withColumn("_hit", F.coalesce(hit, F.lit(False))), by, order).withColumn("_group", group)
    fresh = ~F.coalesce(F.lag("_group").over(here).eqNullSafe(F.col("_group")) | (F.row_number().over(here) == 1), F.lit(True))
    cut = placed.withColumn("_cut", F.sum((fresh | ~F.col("_hit")).cast("int")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("_part", "_cut").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("_run", F.sum(F.col("_hit").cast("long")).over(inner))
    # a row a range
    ends = local.groupBy("_part").agg(F.min_by("_group", "_id").alias("_first"), F.max_by("_group", "_id").alias("_last"), F.max_by("_run", "_id").alias("_tail"), (F.max("_cut") > 0).alias("_ends"))
    along = Window.orderBy("_part")
    joined = F.coalesce(F.lag("_last").over(along).eqNullSafe(F.col("_first")), F.lit(False)) & (F.row_number().over(along) > 1)
    ends = ends.withColumn("_joined", joined).withColumn("_island", F.sum((F.col("_ends") | ~F.col("_joined")).cast("int")).over(along))
    ends = ends.withColumn("_out", F.sum("_tail").over(Window.partitionBy("_island").orderBy("_part")))
    ends = ends.select("_part", F.when(F.col("_joined"), F.lag("_out").over(along)).otherwise(F.lit(0)).alias("_in"))
    out = local.join(F.broadcast(ends), "_part")
    count = F.when(F.col("_cut") == 0, F.col("_run") + F.col("_in")).otherwise(F.col("_run"))
    return out.withColumn(name, count).drop("_part", "_id", "_hit", "_group", "_cut", "_run", "_in")


def numbered_rows(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """Adds ``r`` (from 0, by ``order``) and ``n`` within each group of ``by``, and ``before``: the rows of all smaller groups.

    Rows are sorted over the cluster by range, then numbered inside their partitions; counts of partitions and of groups turn that into
    places.  No task holds more than a range, however many rows a group or a value has.  The sorted rows are settled first, as
    two passes over them must see the same ranges.
    """
    placed = _sorted(rows, by, order)
    # a row a partition
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _PLACE) - 1))
    out = placed.join(F.broadcast(parts), "_part").withColumn("_place", place).drop("_part", "_before", "_id")
    if not by:
        n = placed.agg(F.count(F.lit(1)).alias("n"))  # one row
        return out.crossJoin(n).withColumn("r", F.col("_place")).withColumn("before", F.lit(0).cast("long")).drop("_place")
    groups = out.groupBy(*by).agg(F.min("_place").alias("before"), F.count(F.lit(1)).alias("n"))
    named = groups.select(*[F.col(c).alias(f"_by_{c}") for c in by], "before", "n")
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return out.join(named, on).withColumn("r", F.col("_place") - F.col("before")).drop("_place", *[f"_by_{c}" for c in by])
