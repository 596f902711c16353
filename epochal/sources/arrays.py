"""Reading and writing: array archives (npz), headerless binary recordings, and Parquet bundles.

``register`` makes the readers formats of the session: ``spark.read.format("npz")``, ``spark.read.format("binary_recording")``.
"""

from __future__ import annotations

import io
import json
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.time import SECOND


#: Kinds by the names in an archive, the most particular first. Fixed by the format.
_ENTRIES = {
    "TsGroup": {"t", "start", "end", "index"},
    "TsdFrame": {"t", "d", "start", "end", "columns"},
    "Tsd": {"t", "d", "start", "end"},
    "Ts": {"t", "start", "end"},
    "IntervalSet": {"start", "end"},
}
#: Entries that hold neither data nor metadata of units, columns or epochs.
_PLAIN = {"t", "d", "start", "end", "index", "keys", "type", "columns", "_metadata", "metadata_json"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def open_archive(path: str, trusted: bool = False):
    """An npz archive of any file system. Pickled entries are opened only where the archive is ``trusted``."""
    fs, own = file_system(path)
    with fs.open_input_file(own) as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=trusted)


def _ndim(archive) -> int:
    """The number of axes of ``d``."""
    return archive["d"].ndim


def archive_kind(archive) -> str:
    if "type" in archive:
        return str(np.asarray(archive["type"]).ravel()[0])
    names = set(archive.files)
    found = next((kind for kind, needed in _ENTRIES.items() if needed <= names), "Tsd" if {"t", "d"} <= names else "Ts")
    return found if found != "Tsd" else {1: "Tsd", 2: "TsdFrame"}.get(_ndim(archive), "TsdTensor")


def _ns(t: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(t, dtype=float) * SECOND).astype(np.int64)


def archive_metadata(archive, trusted: bool = False) -> dict[str, list]:
    """Metadata of units, columns or epochs, by name: from JSON, from entries of their own, or pickled in a trusted archive."""
    if "metadata_json" in archive:
        return json.loads(str(archive["metadata_json"]))
    found = {n: archive[n].tolist() for n in archive.files if n not in _PLAIN}
    if trusted and "_metadata" in archive:
        found |= {k: np.asarray(v).tolist() for k, v in archive["_metadata"].item().items()}
    return found


class NpzSource(DataSource):
    """One archive as rows, by ``part``.

    ``data`` (the default): intervals (epoch_id, start_ns, end_ns), samples (unit, t_ns, col, v), or cells of a tensor (t_ns, i, j,
    …, v). ``epochs``: the support stored with samples. ``metadata``: key, name and value (JSON) for each unit, column or epoch.
    """

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _what(self) -> tuple[str, str, int]:
        with open_archive(self.options["path"], self._trusted()) as a:
            return self.options.get("part", "data"), archive_kind(a), _ndim(a) if "d" in a else 0

    def _trusted(self) -> bool:
        return self.options.get("trusted", "false") == "true"

    def schema(self) -> str:
        part, kind, ndim = self._what()
        if part == "metadata":
            return "key string, name string, value string"
        if part == "epochs" or kind == "IntervalSet":
            return "epoch_id int, start_ns long, end_ns long"
        if kind == "TsdTensor":
            return "t_ns long, " + ", ".join(f"{d} int" for d in axis_names(ndim - 1)) + ", v double"
        return "unit int, t_ns long, col string, v double"

    def reader(self, schema) -> DataSourceReader:
        return _NpzReader(self.options["path"], self._trusted(), *self._what())


def axis_names(n: int) -> list[str]:
    return [chr(ord("i") + k) for k in range(n)]


class _NpzReader(DataSourceReader):
    def __init__(self, path: str, trusted: bool, part: str, kind: str, ndim: int):
        self.path, self.trusted, self.part, self.kind, self.ndim = path, trusted, part, kind, ndim

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        with open_archive(self.path, self.trusted) as a:
            if self.part == "metadata":
                keys = a["keys"] if self.kind == "TsGroup" and "keys" in a else np.unique(a["index"]) if self.kind == "TsGroup" else a["columns"] if "columns" in a else None
                meta = archive_metadata(a, self.trusted)
                keys = [str(k) for k in keys] if keys is not None else [str(k) for k in range(len(next(iter(meta.values()), [])))]
                rows = [(k, name, json.dumps(v)) for name, values in meta.items() for k, v in zip(keys, values)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["key", "name", "value"])
            elif self.part == "epochs" or self.kind == "IntervalSet":
                yield pa.RecordBatch.from_pydict({"epoch_id": np.arange(len(a["start"]), dtype=np.int32), "start_ns": _ns(a["start"]), "end_ns": _ns(a["end"])})
            elif self.kind == "TsdTensor":
                t, d = _ns(a["t"]), np.asarray(a["d"], dtype=float)
                cells = d.reshape(len(t), -1)
                places = np.indices(d.shape[1:]).reshape(d.ndim - 1, -1).astype(np.int32)
                step = max(1, (1 << 18) // max(1, cells.shape[1]))
                for at in range(0, len(t), step):
                    n = len(t[at : at + step])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(t[at : at + step], cells.shape[1])), *[pa.array(np.tile(p, n)) for p in places], pa.array(cells[at : at + step].ravel(), from_pandas=True)],
                        names=["t_ns", *axis_names(d.ndim - 1), "v"],
                    )
            else:
                t = _ns(a["t"])
                unit = np.asarray(a["index"], dtype=np.int32) if "index" in a else np.zeros(len(t), dtype=np.int32)
                d = np.asarray(a["d"], dtype=float).reshape(len(t), -1) if "d" in a else np.full((len(t), 1), np.nan)
                names = [str(c) for c in a["columns"]] if "columns" in a else [str(i) for i in range(d.shape[1])]
                for k, label in enumerate(names):
                    yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(t), pa.array([label] * len(t)), pa.array(d[:, k], from_pandas=True)], names=["unit", "t_ns", "col", "v"])


class _Bytes(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__(first)
        self.first, self.count = first, count


class BinaryRecording(DataSource):
    """Headerless interleaved samples: ``n_channels``, ``frequency``, ``dtype`` (int16), optional ``channel``; rows t_ns, channel, v.

    Partitions are ranges of bytes, so a long recording is read by many tasks, from any file system.
    """

    @classmethod
    def name(cls) -> str:
        return "binary_recording"

    def schema(self) -> str:
        return "t_ns long, channel int, v double"

    def reader(self, schema) -> DataSourceReader:
        return _BinaryReader(self.options)


class _BinaryReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.n, self.fs = int(options["n_channels"]), float(options["frequency"])
        self.dtype = np.dtype(options.get("dtype", "int16"))
        self.channel = int(options["channel"]) if "channel" in options else None
        self.per = int(options.get("samples_per_partition", 1 << 22))

    def partitions(self):
        fs, own = file_system(self.path)
        total = fs.get_file_info(own).size // (self.n * self.dtype.itemsize)
        return [_Bytes(i, min(self.per, total - i)) for i in range(0, total, self.per)] or [_Bytes(0, 0)]

    def read(self, partition: _Bytes) -> Iterator[pa.RecordBatch]:
        fs, own = file_system(self.path)
        width = self.n * self.dtype.itemsize
        with fs.open_input_file(own) as f:
            f.seek(partition.first * width)
            for at in range(partition.first, partition.first + partition.count, 1 << 16):
                to = min(at + (1 << 16), partition.first + partition.count)
                block = np.frombuffer(f.read((to - at) * width), dtype=self.dtype).reshape(-1, self.n)
                t = np.rint(np.arange(at, to) * (SECOND / self.fs)).astype(np.int64)
                for c in range(self.n) if self.channel is None else [self.channel]:
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), c, dtype=np.int32)), pa.array(block[:, c].astype(float))], names=["t_ns", "channel", "v"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(BinaryRecording)


def load_file(spark: SparkSession, path: str, part: str = "data", trusted: bool = False) -> DataFrame:
    """An npz archive, a Parquet bundle or an NWB container, by its ending; other endings are refused."""
    if path.endswith(".npz"):
        register(spark)
        return spark.read.format("npz").option("part", part).option("trusted", str(trusted).lower()).load(path)
    if path.rstrip("/").endswith(".bundle"):
        return load_bundle(spark, path)[part]
    if path.endswith(".nwb"):
        from .containers import load_container

        return load_container(spark, path)[part]
    raise RuntimeError(f"{path} is none of .npz, .bundle and .nwb")


def load_binary_file(spark: SparkSession, path: str, channel: int | list[int] | None = None, n_channels: int = 1, frequency: float = 20_000.0, precision: str = "int16") -> DataFrame:
    """Samples of one channel, some, or all of a headerless recording."""
    register(spark)
    reader = spark.read.format("binary_recording").option("n_channels", n_channels).option("frequency", frequency).option("dtype", precision)
    if isinstance(channel, int):
        return reader.option("channel", channel).load(path)
    rows = reader.load(path)
    return rows if channel is None else rows.where(F.col("channel").isin(channel))


def load_eeg(spark: SparkSession, path: str, channel: int | list[int] | None = None, n_channels: int = 1, frequency: float = 1250.0, precision: str = "int16") -> DataFrame:
    """The former name of ``load_binary_file``."""
    warnings.warn("load_eeg is deprecated; use load_binary_file", DeprecationWarning, stacklevel=2)
    return load_binary_file(spark, path, channel, n_channels, frequency, precision)


def append_signal(spark: SparkSession, path: str, name: str, signal: DataFrame) -> None:
    """Add samples to the part ``name`` of a bundle, which is made if it is new: where a container would take an electrical series."""
    about = json.loads(spark.read.text(f"{path}/_about").first().value)
    if name in about["parts"] and set(spark.read.parquet(f"{path}/{name}").columns) != set(signal.columns):
        raise ValueError(f"{name} has other columns")
    signal.write.mode("append").parquet(f"{path}/{name}")
    if name not in about["parts"]:
        about["parts"] = sorted([*about["parts"], name])
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_about")


def save_npz(df: DataFrame, epochs: DataFrame | None, path: str, metadata: DataFrame | None = None, dims: list[str] | None = None) -> None:
    """Write one series, frame, tensor, group or interval set, small enough for the driver, as an npz archive with times in seconds.

    An archive is one file of one writer; ``save_bundle`` is for data of any size. A frame has a column ``col`` and a tensor the
    axes ``dims``. ``metadata`` has a row for each unit, column or epoch, keyed by ``unit``, ``col`` or ``epoch_id``; an interval set
    brings its own.
    """
    out: dict = {}
    e = epochs if epochs is not None else df if "start_ns" in df.columns else None
    if e is not None:
        e = e.orderBy("start_ns").toPandas()
        out = {"start": e.start_ns.to_numpy() / SECOND, "end": e.end_ns.to_numpy() / SECOND}
    meta = None
    if "start_ns" in df.columns:
        out["type"] = np.array(["IntervalSet"])
        meta = e.drop(columns=[c for c in ("epoch_id", "start_ns", "end_ns") if c in e])
    else:
        rows = df.orderBy("t_ns").toPandas()
        key = "unit" if "unit" in rows and not dims else "col"
        if dims:
            out["type"] = np.array(["TsdTensor"])
            wide = rows.pivot(index="t_ns", columns=dims, values="v").sort_index(axis=1)
            out["t"], out["d"] = wide.index.to_numpy() / SECOND, wide.to_numpy(dtype=float).reshape(len(wide), *[rows[d].max() + 1 for d in dims])
        elif "col" in rows and key == "col":
            out["type"] = np.array(["TsdFrame"])
            wide = rows.pivot(index="t_ns", columns="col", values="v")
            out["t"], out["d"], out["columns"] = wide.index.to_numpy() / SECOND, wide.to_numpy(dtype=float), np.array([str(c) for c in wide.columns])
        else:
            out["t"] = rows.t_ns.to_numpy() / SECOND
            if "v" in rows:
                out["d"] = rows.v.to_numpy(dtype=float)
            if "unit" in rows:
                out["index"] = rows.unit.to_numpy(dtype=np.int64)
                out["keys"] = np.unique(out["index"])
            out["type"] = np.array(["TsGroup" if "unit" in rows else "Tsd" if "v" in rows else "Ts"])
        if metadata is not None:
            meta = metadata.toPandas().set_index(key)
            meta = meta.reindex(out["keys"] if key == "unit" else out["columns"])
    if meta is not None and len(meta.columns):
        out["metadata_json"] = np.array(json.dumps({c: meta[c].tolist() for c in meta.columns}))
    buffer = io.BytesIO()
    np.savez(buffer, **out)
    fs, own = file_system(path)
    with fs.open_output_stream(own) as f:
        f.write(buffer.getvalue())


def save_bundle(spark: SparkSession, path: str, parts: dict[str, DataFrame], info: dict | None = None) -> None:
    """Several frames that belong together (data, epochs, units) as Parquet below one folder, sorted by time within files."""
    for name, df in parts.items():
        order = [c for c in ("unit", "start_ns", "t_ns") if c in df.columns]
        (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"parts": sorted(parts), "info": info or {}}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_about")


def load_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    about = json.loads(spark.read.text(f"{path}/_about").first().value)
    return {name: spark.read.parquet(f"{path}/{name}") for name in about["parts"]}


def bundle_info(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/_about").first().value)["info"]


def catalog(spark: SparkSession, root: str, prefix: str = "") -> list[str]:
    """Register every bundle below ``root`` as temporary views ``<prefix><bundle>_<part>``; returns their names. Nothing is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    made = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if status.isDirectory() and name.endswith(".bundle"):
            for part, df in load_bundle(spark, f"{root}/{name}").items():
                view = f"{prefix}{name.removesuffix('.bundle')}_{part}"
                df.createOrReplaceTempView(view)
                made.append(view)
    return sorted(made)


def as_units(df: DataFrame, unit: str = "s") -> DataFrame:
    """Times in another unit for export: columns t, start and end."""
    from ..functions.time import in_unit

    for ns, name in (("t_ns", "t"), ("start_ns", "start"), ("end_ns", "end")):
        if ns in df.columns:
            df = df.withColumn(ns, in_unit(ns, unit)).withColumnRenamed(ns, name)
    return df


def from_seconds(df: DataFrame, columns: dict[str, str], unit: str = "s") -> DataFrame:
    """Columns of seconds (or ``unit``) as nanosecond columns under new names: {"t": "t_ns"}."""
    from ..functions.time import ns_of

    return df.withColumns({new: ns_of(F.col(old), unit) for old, new in columns.items()}).drop(*[o for o, n in columns.items() if o != n])
