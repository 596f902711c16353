"""Output folders of sorting and imaging programs: NumPy matrices that are read by ranges of rows."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.time import SECOND
from .arrays import file_system


class _Rows(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__(first)
        self.first, self.end = first, end


class NpyMatrix(DataSource):
    """A matrix (or vector) of one .npy file as rows r, c and v; partitions are ranges of rows."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "r long, c int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("values_per_partition", 1 << 22)))


def _header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and place of the data of a .npy file."""
    head = io.BytesIO(f.read(4096))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(head)
    if fortran and len(shape) > 1 or dtype.hasobject:
        raise ValueError("the matrix is not stored row by row")
    return shape, dtype, head.tell()


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, per: int):
        self.path, self.per = path, per

    def _open(self):
        fs, own = file_system(self.path)
        return fs.open_input_file(own)

    def partitions(self):
        with self._open() as f:
            shape, _, _ = _header(f)
        step = max(1, self.per // max(1, int(np.prod(shape[1:]))))
        return [_Rows(a, min(a + step, shape[0])) for a in range(0, shape[0], step)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        with self._open() as f:
            shape, dtype, start = _header(f)
            width = int(np.prod(shape[1:]))
            step = max(1, (1 << 18) // max(1, width))
            for a in range(partition.first, partition.end, step):
                b = min(a + step, partition.end)
                f.seek(start + a * width * dtype.itemsize)
                v = np.frombuffer(f.read((b - a) * width * dtype.itemsize), dtype=dtype).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(a, b), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), b - a)), pa.array(v, from_pandas=True)], names=["r", "c", "v"])


def read_npy(spark: SparkSession, path: str, values_per_partition: int = 1 << 22) -> DataFrame:
    spark.dataSource.register(NpyMatrix)
    return spark.read.format("npy").option("values_per_partition", values_per_partition).load(path)


def _text(path: str) -> str | None:
    fs, own = file_system(path)
    if fs.get_file_info(own).type != pafs.FileType.File:
        return None
    with fs.open_input_file(own) as f:
        return f.read().decode()


def load_phy(spark: SparkSession, path: str, fs: float | None = None, keep: tuple[str, ...] = ("good", "mua")) -> dict[str, DataFrame]:
    """``spikes`` (unit, t_ns) and ``units`` (unit and the columns of the cluster tables) of a folder that phy writes.

    The rate is that of ``params.py`` unless given. Clusters whose group is not in ``keep`` drop, if there is a table of groups.
    """
    if fs is None:
        found = re.search(r"^\s*sample_rate\s*=\s*([0-9.eE+]+)", _text(f"{path}/params.py") or "", re.M)
        if not found:
            raise ValueError("no sample_rate in params.py; give the rate")
        fs = float(found[1])
    info: dict[int, dict[str, str]] = {}
    for name in ("cluster_info.tsv", "cluster_group.tsv"):  # a row per cluster
        for row in csv.DictReader(io.StringIO(_text(f"{path}/{name}") or ""), delimiter="\t"):
            info.setdefault(int(row.get("cluster_id") or row["id"]), {}).update({k: v for k, v in row.items() if k not in ("cluster_id", "id")})
    t = read_npy(spark, f"{path}/spike_times.npy").select("r", F.col("v").alias("s"))
    spikes = t.join(read_npy(spark, f"{path}/spike_clusters.npy").select("r", F.col("v").cast("int").alias("unit")), "r")
    spikes = spikes.select("unit", F.bround(F.col("s") * F.lit(SECOND / fs), 0).cast("bigint").alias("t_ns"))
    if not info:
        return {"spikes": spikes, "units": spikes.select("unit").distinct()}
    columns = sorted({c for row in info.values() for c in row})
    kept = {k: row for k, row in info.items() if "group" not in row or row["group"] in keep}
    units = spark.createDataFrame([(k, *[row.get(c) for c in columns]) for k, row in kept.items()], "unit int" + "".join(f", `{c}` string" for c in columns))
    return {"spikes": spikes.join(units.select("unit"), "unit", "left_semi"), "units": units}


def load_suite2p(spark: SparkSession, path: str, fs: float = 30.0, kinds: tuple[str, ...] = ("F", "Fneu", "spks")) -> dict[str, DataFrame]:
    """For each kind of trace rows (plane, roi, t_ns, v) of the regions that are cells, numbered anew within all planes; and
    ``cells`` (plane, place, roi, chance)."""
    root_fs, own = file_system(path)
    found = root_fs.get_file_info(pafs.FileSelector(own, recursive=True))
    planes = sorted({x.path.rsplit("/", 1)[0] for x in found if x.path.endswith("/iscell.npy")})
    if not planes:
        raise FileNotFoundError(f"no iscell.npy below {path}")
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    rows = None
    for k, plane in enumerate(planes):
        m = read_npy(spark, f"{scheme}{plane}/iscell.npy")
        own_cells = m.groupBy(F.col("r").alias("place")).agg(F.max(F.when(F.col("c") == 0, F.col("v"))).alias("_is"), F.max(F.when(F.col("c") == 1, F.col("v"))).alias("chance")).where("_is > 0").select(F.lit(k).alias("plane"), "place", "chance")
        rows = own_cells if rows is None else rows.unionByName(own_cells)
    cells = rows.withColumn("roi", (F.row_number().over(Window.orderBy("plane", "place")) - 1).cast("int"))  # a row per region
    out = {"cells": cells}
    for kind in kinds:
        traces = None
        for k, plane in enumerate(planes):
            part = read_npy(spark, f"{scheme}{plane}/{kind}.npy").select(F.lit(k).alias("plane"), F.col("r").alias("place"), F.bround(F.col("c") * F.lit(SECOND / fs), 0).cast("bigint").alias("t_ns"), "v")
            traces = part if traces is None else traces.unionByName(part)
        out[kind] = traces.join(cells.select("plane", "place", "roi"), ["plane", "place"]).select("plane", "roi", "t_ns", "v")
    return out
