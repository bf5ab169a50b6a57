"""Statistics of stage timings. Groups are few and large, so none is sorted or summed in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import bandwidth_gbs

#: Equal parts of a group's range of values, by which a percentile's place is found; rows of a block of a running sum.
PARTS, BLOCK = 4096, 4096
PERCENTILES = (50, 90, 99)


def _percentiles(rows: DataFrame, by: str, value: str, ends: DataFrame) -> DataFrame:
    """(by, p50, p90, p99), interpolated and exact: the parts' counts tell which part a rank falls in, and only those parts are put in order.

    ends: by, _n, _low, _high. Equal values are counted before they are moved.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k")).join(ends, by)
    share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))
    counted = counted.withColumn("_part", F.coalesce(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)), F.lit(0)).cast("int"))
    parts = counted.groupBy(by, "_part").agg(F.sum("_k").alias("_size"))
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_size", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_ahead"))
    place = lambda p: (F.col("_n") - 1) * (p / 100)
    ranks = [(p, k) for p in PERCENTILES for k in (0, 1)]
    rank = lambda p, k: F.least(F.floor(place(p)) + k, F.col("_n") - 1)
    wanted = parts.join(ends, parts["_by"] == ends[by]).where(
        F.exists(F.array(*(rank(p, k) for p, k in ranks)), lambda r: (r >= F.col("_ahead")) & (r < F.col("_ahead") + F.col("_size")))
    ).select("_by", "_p", "_ahead")  # six parts a group at most
    near = counted.join(F.broadcast(wanted), (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_p")))
    upto = F.sum("_k").over(Window.partitionBy(by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_ahead")
    near = near.withColumn("_upto", upto)
    at = lambda p, k: F.max(F.when((rank(p, k) < F.col("_upto")) & (rank(p, k) >= F.col("_upto") - F.col("_k")), F.col("_v")))
    picked = near.groupBy(by).agg(F.first("_n").alias("_n"), *(at(p, k).alias(f"_{p}_{k}") for p, k in ranks))
    mixed = lambda p: F.col(f"_{p}_0") + (F.col(f"_{p}_1") - F.col(f"_{p}_0")) * (place(p) - F.floor(place(p)))
    return picked.select(F.col(by).alias("_by"), *(mixed(p).alias(f"p{p}") for p in PERCENTILES))


def summary(timings: DataFrame, by: str = "provider", value: str = "total_ms", stages: tuple[str, ...] = ()) -> DataFrame:
    """Per group n, the averages of the stages (avg_<stage>), and of the value avg, interpolated p50, p90 and p99, min, max.

    Null values count in n alone; a group without any value has null percentiles. A null group has none.
    """
    x = F.col(value)
    totals = timings.groupBy(by).agg(F.count("*").alias("n"), F.count(x).alias("_n"), *(F.avg(s).alias(f"avg_{s}") for s in stages), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"))
    found = _percentiles(timings, by, value, totals.select(by, "_n", F.col("min").alias("_low"), F.col("max").alias("_high")))
    return totals.join(found, F.col(by) == F.col("_by"), "left").select(by, "n", *(f"avg_{s}" for s in stages), "avg", *(f"p{p}" for p in PERCENTILES), "min", "max")


def cumulative(timings: DataFrame, every: int = 30, by: str = "provider", order: str = "run_id", value: str = "total_ms", stages: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Per group, at every `every`-th run, of all runs so far: n, avg, min and max of the value, and the averages of the stages.

    `order` is a whole number. Runs are taken in blocks of it: the blocks' totals are summed up first, then each block goes on from them.
    """
    exact = lambda c: F.col(c).cast("decimal(18,6)")
    columns = [value, *stages]
    rows = timings.withColumn("_block", F.floor(F.col(order) / block))
    totals = rows.groupBy(by, "_block").agg(F.count("*").alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"), *(f(exact(c)).alias(f"_{k}_{c}") for c in columns for k, f in (("s", F.sum), ("c", F.count))))
    ahead = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = ["_n", *(f"_{k}_{c}" for c in columns for k in "sc")]
    totals = totals.select(F.col(by).alias("_by"), F.col("_block").alias("_b"), *(F.sum(c).over(ahead).alias(c) for c in sums), F.min("_min").over(ahead).alias("_min"), F.max("_max").over(ahead).alias("_max"))
    own = Window.partitionBy(by, "_block").orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    here = rows.select(
        by, order, "_block", F.row_number().over(own).alias("_row"), F.min(value).over(upto).alias("_low"), F.max(value).over(upto).alias("_high"),
        *(f(exact(c)).over(upto).alias(f"_{k}h_{c}") for c in columns for k, f in (("s", F.sum), ("c", F.count))),
    )
    met = here.join(totals, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_block") == F.col("_b")))
    with_ = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    mean = lambda c: F.try_divide(with_(f"_s_{c}", f"_sh_{c}").cast("decimal(26,6)"), with_(f"_c_{c}", f"_ch_{c}").cast("decimal(12,0)")).cast("double")
    out = met.select(
        by, order, with_("_n", "_row").cast("int").alias("n"), mean(value).alias("avg"), F.least("_min", "_low").alias("min"), F.greatest("_max", "_high").alias("max"), *(mean(s).alias(f"avg_{s}") for s in stages)
    )
    return out.where(F.col("n") % every == 0)


def _frames_a_second(mean: Column) -> Column:
    return F.when(mean > 1e-6, 1000.0 / mean).otherwise(0.0)


def export_report(timings: DataFrame, stages: tuple[str, ...], frame_bytes: int, every: int = 60, by: str = "provider", order: str = "run_id", value: str = "total_ms") -> DataFrame:
    """cumulative for an export: the averages of its stages, frames a second of the time spent so far, and the estimated memory traffic."""
    rows = cumulative(timings, every, by, order, value, stages)
    return rows.withColumn("fps", _frames_a_second(F.col("avg"))).withColumn("bandwidth_gbs", bandwidth_gbs(F.lit(frame_bytes), F.col("avg"))).drop("min", "max")
