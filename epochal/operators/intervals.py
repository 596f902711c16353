"""Interval sets: rows (epoch_id, start_ns, end_ns, metadata) that are sorted and do not overlap.

Set operations sweep over the borders of all sets at once with running counts. A frame without keys is swept in one order,
which suits epochs of one recording; ``by`` names key columns, and each key's intervals are then swept apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Touching intervals are kept apart by this much.
GAP_NS = 1000
EDGES = ["start_ns", "end_ns"]


def _over(by: list[str], *order) -> Window:
    return Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)


def numbered(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``epoch_id`` counts the intervals of each key from 0 in order of time."""
    by = by or []
    return df.withColumn("epoch_id", (F.row_number().over(_over(by, "start_ns", "end_ns")) - 1).cast("int"))


def normalize(df: DataFrame, by: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Valid intervals from any: empty and reversed ones drop, overlapping ones merge, touching ones are kept apart.

    With ``strict`` off, starts and ends are first sorted each for itself, as is done for input whose order is unknown.
    """
    by = by or []
    rows = df.select(*by, *EDGES)
    if not strict:
        s = rows.select(*by, "start_ns", F.row_number().over(_over(by, "start_ns")).alias("_r"))
        e = rows.select(*by, "end_ns", F.row_number().over(_over(by, "end_ns")).alias("_r"))
        rows = s.join(e, [*by, "_r"]).drop("_r")
    rows = rows.where("end_ns > start_ns")
    w = _over(by, "start_ns", "end_ns")
    reach = F.max("end_ns").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("start_ns") < reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*by, "_island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    return numbered(_apart(rows, by), by).select(*by, "epoch_id", *EDGES)


def _apart(rows: DataFrame, by: list[str]) -> DataFrame:
    after = F.lead("start_ns").over(_over(by, "start_ns"))
    return rows.withColumn("end_ns", F.when(F.col("end_ns") == after, F.col("end_ns") - GAP_NS).otherwise(F.col("end_ns")))


def _sweep(sets: list[DataFrame], by: list[str], inside: str, touch_merges: bool = False) -> DataFrame:
    """Maximal stretches where ``inside`` holds, an expression over c0, c1, …, the number of intervals of each set that are open."""
    n = len(sets)
    borders = []
    for k, df in enumerate(sets):
        for edge, step in (("start_ns", 1), ("end_ns", -1)):
            borders.append(df.select(*by, F.col(edge).alias("t"), *[F.lit(step if j == k else 0).alias(f"d{j}") for j in range(n)]))
    at = reduce(DataFrame.unionByName, borders).groupBy(*by, "t").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(n)])
    w = _over(by, "t").rowsBetween(Window.unboundedPreceding, 0)
    at = at.select(*by, "t", F.lead("t").over(_over(by, "t")).alias("next"), *[F.sum(f"d{j}").over(w).alias(f"c{j}") for j in range(n)])
    pieces = at.where(f"next is not null and ({inside})").select(*by, F.col("t").alias("start_ns"), F.col("next").alias("end_ns"), *[f"c{j}" for j in range(n)])
    before = F.lag("end_ns").over(_over(by, "start_ns"))
    return pieces.withColumn("_joined", F.coalesce(before == F.col("start_ns"), F.lit(False)))


def _islands(pieces: DataFrame, by: list[str], joined) -> DataFrame:
    w = _over(by, "start_ns").rowsBetween(Window.unboundedPreceding, 0)
    rows = pieces.withColumn("_island", F.sum(F.when(joined, 0).otherwise(1)).over(w))
    return rows.groupBy(*by, "_island").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")).drop("_island")


def union(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Union of two sets; intervals that only touch stay apart. Metadata drops."""
    return normalize(a.select(*(by or []), *EDGES).unionByName(b.select(*(by or []), *EDGES)), by)


def union_all(sets: list[DataFrame], by: list[str] | None = None) -> DataFrame:
    """Union of any number of sets; intervals that touch merge."""
    by = by or []
    pieces = _sweep([s.where("end_ns > start_ns") for s in sets], by, " + ".join(f"c{j}" for j in range(len(sets))) + " > 0")
    return numbered(_islands(pieces, by, F.col("_joined")), by).select(*by, "epoch_id", *EDGES)


def set_diff(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What ``a`` covers and ``b`` does not, with the metadata of ``a``."""
    by = by or []
    pieces = _sweep([a, b], by, "c0 > 0 and c1 = 0").drop("c0", "c1", "_joined")
    meta = [c for c in a.columns if c not in [*by, *EDGES, "epoch_id"]]
    if meta:
        # a piece lies in one interval of a; they meet in the bucket where the piece starts
        width = bucket_width(a)
        own = in_buckets(a.select(*by, F.col("start_ns").alias("_s"), F.col("end_ns").alias("_e"), *meta), "_s", "_e", width)
        found = pieces.withColumn("_bucket", F.floor(F.col("start_ns") / F.lit(float(width)))).join(own, [*by, "_bucket"])
        pieces = found.where("start_ns >= _s and end_ns <= _e").select(*by, *EDGES, *meta)
    return numbered(_apart(pieces, by), by).select(*by, "epoch_id", *EDGES, *meta)


def intersect(a: DataFrame, b: DataFrame, by: list[str] | None = None, bucket_ns: int | None = None) -> DataFrame:
    """Overlaps of two sets with the metadata of both; names that both have drop.

    Pairs meet in buckets of time, so the join is by equality whatever the size of the sets.
    """
    by = by or []
    meta_a = [c for c in a.columns if c not in [*by, *EDGES, "epoch_id"]]
    meta_b = [c for c in b.columns if c not in [*by, *EDGES, "epoch_id"]]
    both = set(meta_a) & set(meta_b)
    width = bucket_ns or max(bucket_width(a), bucket_width(b))
    x = in_buckets(a.select(*by, F.col("start_ns").alias("_s1"), F.col("end_ns").alias("_e1"), *[c for c in meta_a if c not in both]), "_s1", "_e1", width)
    y = in_buckets(b.select(*by, F.col("start_ns").alias("_s2"), F.col("end_ns").alias("_e2"), *[c for c in meta_b if c not in both]), "_s2", "_e2", width)
    rows = x.join(y, [*by, "_bucket"]).where("_s2 < _e1 and _e2 > _s1")
    # a pair may meet in several buckets; it counts in the one where the overlap starts
    rows = rows.where(F.expr(f"_bucket = floor(greatest(_s1, _s2) / {width}D)")).withColumns({"start_ns": F.greatest("_s1", "_s2"), "end_ns": F.least("_e1", "_e2")})
    rows = rows.drop("_bucket", "_s1", "_e1", "_s2", "_e2")
    return numbered(_apart(rows, by), by).select(*by, "epoch_id", *EDGES, *[c for c in [*meta_a, *meta_b] if c not in both])


def bucket_width(epochs: DataFrame, start: str = "start_ns", end: str = "end_ns") -> int:
    """A bucket as wide as the mean interval: all intervals together then lie in about three times as many buckets."""
    mean = epochs.agg(F.avg(F.col(end) - F.col(start))).first()[0]
    return max(1, int(mean or 1))


def in_buckets(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Each interval once per bucket of time that it meets, as ``_bucket``."""
    return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / F.lit(float(width))), F.floor(F.col(end) / F.lit(float(width))))))


def split(df: DataFrame, size_ns: int, by: list[str] | None = None) -> DataFrame:
    """Consecutive pieces of exactly ``size_ns``, each end earlier by the gap; rests drop, and intervals no longer than that.

    Metadata is repeated.
    """
    by = by or []
    rest = [c for c in df.columns if c not in [*by, *EDGES, "epoch_id"]]
    rows = df.where(F.col("end_ns") - F.col("start_ns") > size_ns)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(end_ns - start_ns) div {size_ns} - 1"))))
    rows = rows.select(*by, (F.col("start_ns") + F.col("_k") * size_ns).alias("start_ns"), (F.col("start_ns") + (F.col("_k") + 1) * size_ns - GAP_NS).alias("end_ns"), *rest)
    return numbered(rows, by).select(*by, "epoch_id", *EDGES, *rest)


def merge_close(df: DataFrame, threshold_ns: int, by: list[str] | None = None) -> DataFrame:
    """Intervals whose gap is at most the threshold become one. Metadata drops."""
    by = by or []
    gap = F.col("start_ns") - F.lag("end_ns").over(_over(by, "start_ns"))
    rows = df.select(*by, *EDGES).withColumn("_close", F.coalesce(gap <= threshold_ns, F.lit(False)))
    return numbered(_islands(rows, by, F.col("_close")), by).select(*by, "epoch_id", *EDGES)


def drop_short(df: DataFrame, threshold_ns: int, by: list[str] | None = None) -> DataFrame:
    """Intervals longer than the threshold."""
    return numbered(df.where(F.col("end_ns") - F.col("start_ns") > threshold_ns), by or [])


def drop_long(df: DataFrame, threshold_ns: int, by: list[str] | None = None) -> DataFrame:
    """Intervals shorter than the threshold."""
    return numbered(df.where(F.col("end_ns") - F.col("start_ns") < threshold_ns), by or [])


def time_span(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """From the first start to the last end."""
    return df.groupBy(*(by or [])).agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))


def tot_length(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The length of all intervals together, a BIGINT; a DECIMAL where that is too small for it (292 years of all keys together)."""
    rows = df.groupBy(*(by or [])).agg(F.sum((F.col("end_ns") - F.col("start_ns")).cast("decimal(20,0)")).alias("tot_ns"))
    if not by:
        total = rows.first()[0]
        return df.sparkSession.range(1).select(F.lit(total).cast("bigint" if abs(total or 0) < 1 << 63 else "decimal(30,0)").alias("tot_ns"))
    most = rows.agg(F.max(F.abs("tot_ns"))).first()[0]
    return rows.withColumn("tot_ns", F.col("tot_ns").cast("bigint")) if (most or 0) < 1 << 63 else rows


def centers(df: DataFrame, alpha: float = 0.5) -> DataFrame:
    """A time inside each interval: its start plus the share ``alpha``, held within 0 and 1, of its length."""
    if not isinstance(alpha, float):
        raise RuntimeError("alpha must be a float")
    share = min(max(alpha, 0.0), 1.0)
    return df.withColumn("t_ns", F.col("start_ns") + F.bround((F.col("end_ns") - F.col("start_ns")) * F.lit(share), 0).cast("bigint"))


def starts(df: DataFrame) -> DataFrame:
    """Where the intervals start, as samples with their metadata."""
    return df.drop("end_ns").withColumnRenamed("start_ns", "t_ns")


def ends(df: DataFrame) -> DataFrame:
    """Where the intervals end, as samples with their metadata."""
    return df.drop("start_ns").withColumnRenamed("end_ns", "t_ns")


def apply_edges(df: DataFrame, function, by: list[str] | None = None) -> DataFrame:
    """An elementwise function (Column to Column) on both borders; what comes out is made valid again. Metadata drops."""
    by = by or []
    return normalize(df.select(*by, function(F.col("start_ns")).cast("bigint").alias("start_ns"), function(F.col("end_ns")).cast("bigint").alias("end_ns")), by)


def find_support(samples: DataFrame, min_gap_ns: int, by: list[str] | None = None) -> DataFrame:
    """Epochs of samples that follow each other by at most ``min_gap_ns``; each end is later by the gap constant."""
    by = by or []
    step = F.col("t_ns") - F.lag("t_ns").over(_over(by, "t_ns"))
    rows = samples.select(*by, "t_ns").withColumn("_new", F.when(step <= min_gap_ns, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(_over(by, "t_ns").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*by, "_island").agg(F.min("t_ns").alias("start_ns"), (F.max("t_ns") + GAP_NS).alias("end_ns"))
    return numbered(rows, by).select(*by, "epoch_id", *EDGES)
