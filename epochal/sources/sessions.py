"""Folders of recordings: what is in them, by kind, as DataFrames that are read when used."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import SECOND
from . import neuroscope, recordings
from .arrays import file_system, load_bundle, load_file, save_npz
from .containers import load_container

#: Kinds whose processed data lie in an NWB container, with the time series that hold them.
CONTAINERS = {"phy": "Units", "suite2p": "RoiResponseSeries", "inscopix-cnmfe": "RoiResponseSeries", "cnmfe-matlab": "RoiResponseSeries", "minian": "RoiResponseSeries"}


def load_folder(spark: SparkSession, path: str) -> dict:
    """Archives and bundles below a folder, as a tree of names; each leaf is a function that reads it."""
    tree: dict = {}
    for p in sorted(Path(path).iterdir()):
        if p.suffix == ".npz":
            tree[p.stem] = lambda p=p: load_file(spark, str(p))
        elif p.suffix == ".bundle":
            tree[p.stem] = lambda p=p: load_bundle(spark, str(p))
        elif p.is_dir():
            tree[p.name] = load_folder(spark, str(p))
    return tree


class Folder:
    """A folder of archives and bundles as a dictionary; what is asked for is opened then and kept. Notes lie beside the data as JSON."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self._own = file_system(self.path)
        self._open: dict = {}

    def _entries(self) -> list:
        found = self.fs.get_file_info(pafs.FileSelector(self._own))
        kept = [x for x in found if x.base_name.endswith((".npz", ".bundle")) or x.type == pafs.FileType.Directory]
        return sorted(kept, key=lambda x: (x.type != pafs.FileType.Directory or x.base_name.endswith(".bundle"), x.base_name))

    def keys(self) -> list[str]:
        return [x.base_name.removesuffix(".npz").removesuffix(".bundle") for x in self._entries()]

    def __getitem__(self, name: str):
        if name not in self._open:
            for x in self._entries():
                if x.base_name == f"{name}.npz":
                    self._open[name] = load_file(self.spark, f"{self.path}/{x.base_name}")
                elif x.base_name == f"{name}.bundle":
                    self._open[name] = load_bundle(self.spark, f"{self.path}/{x.base_name}")
                elif x.base_name == name and x.type == pafs.FileType.Directory:
                    self._open[name] = Folder(self.spark, f"{self.path}/{name}")
        if name not in self._open:
            raise KeyError(name)
        return self._open[name]

    def load(self) -> dict:
        """Everything of this folder, opened."""
        return {name: self[name] for name in self.keys()}

    def view(self) -> str:
        """The tree of names below this folder."""
        return "\n".join([self.path.rsplit("/", 1)[-1], *self._lines("")])

    expand = view

    def _lines(self, indent: str) -> list[str]:
        out, entries = [], self._entries()
        for k, x in enumerate(entries):
            last = k + 1 == len(entries)
            out.append(f"{indent}{'└──' if last else '├──'} {x.base_name}")
            if x.type == pafs.FileType.Directory and not x.base_name.endswith(".bundle"):
                out += Folder(self.spark, f"{self.path}/{x.base_name}")._lines(indent + ("    " if last else "│   "))
        return out

    def save(self, name: str, data: DataFrame, epochs: DataFrame | None = None, description: str = "") -> None:
        """Data small enough for the driver as an archive, with a note of the time and what it is."""
        save_npz(data, epochs, f"{self.path}/{name}.npz")
        with self.fs.open_output_stream(f"{self._own}/{name}.json") as f:
            f.write(json.dumps({"time": str(datetime.now()), "info": description}, indent=2).encode())
        self._open.pop(name, None)

    def metadata(self, name: str) -> dict:
        """The note of an archive; empty where there is none."""
        if self.fs.get_file_info(f"{self._own}/{name}.json").type != pafs.FileType.File:
            return {}
        with self.fs.open_input_file(f"{self._own}/{name}.json") as f:
            return json.loads(f.read())

    def info(self, name: str) -> str:
        return self.metadata(name).get("info", "")

    doc = info


def load_session(spark: SparkSession, path: str, kind: str | None = None) -> dict[str, DataFrame | dict]:
    """A session folder. ``neurosuite``: header, spikes of all shanks (shank, unit, t_ns) and hand-made epochs by name. ``phy`` and
    ``suite2p``: what these programs write themselves, where it is there. ``base``: position, epochs and their common support.
    Other kinds are kept in NWB containers and need that library; without a kind, what ``load_folder`` finds."""
    if kind is None:
        return load_folder(spark, path)
    if kind == "base":
        return load_base(spark, path)
    if kind == "phy" and (Path(path) / "spike_times.npy").exists():
        return recordings.load_phy(spark, path)
    if kind == "suite2p" and any(Path(path).rglob("F.npy")):
        return recordings.load_suite2p(spark, path)
    if kind in CONTAINERS:
        return load_container(spark, path, CONTAINERS[kind])
    if kind != "neurosuite":
        raise ValueError(f"session {kind!r} is none of base, neurosuite, {', '.join(CONTAINERS)}")
    root = Path(path)
    headers = sorted(root.glob("*.xml"))
    if not headers:
        raise FileNotFoundError(f"no XML header in {path}")
    header = neuroscope.read_header(str(headers[0]))
    base = str(headers[0].with_suffix(""))
    out: dict = {"header": header}
    spikes, units = None, 0
    for f in sorted(root.glob(f"{headers[0].stem}.clu.*"), key=lambda f: int(f.suffix[1:])):
        shank = int(f.suffix[1:])
        rows = neuroscope.read_spikes(spark, base, shank, header["fs_dat"])
        n = len({x for x in f.read_text().split()[1:] if int(x) > 1})
        rows = rows.select(F.lit(shank).alias("shank"), (F.col("unit") + units).alias("unit"), "t_ns")
        spikes, units = rows if spikes is None else spikes.unionByName(rows), units + n
    if spikes is not None:
        out["spikes"] = spikes
    out["epochs"] = {f.name.split(".")[-2]: neuroscope.read_intervals(spark, str(f)) for f in sorted(root.glob("*.evt"))}
    return out


def regular_series(spark: SparkSession, values: list[float], rate_hz: float, start_s: float = 0.0) -> DataFrame:
    """t_ns and v of values sampled at a rate from a starting time, as containers store them."""
    rows = [(round(start_s * SECOND + i * SECOND / rate_hz), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("t_ns", T.LongType()), T.StructField("v", T.DoubleType())]))


def session_support(epochs: DataFrame) -> DataFrame:
    """One epoch for all of a session's epochs that follow each other by no more than the gap constant."""
    from ..operators.intervals import GAP_NS, merge_close, normalize

    return merge_close(normalize(epochs), GAP_NS)


def load_base(spark: SparkSession, path: str) -> dict[str, DataFrame | dict]:
    """``position`` (t_ns and its columns) and ``epochs`` by label, from the bundle ``session.bundle`` of a folder, with the support
    of the session."""
    parts = load_bundle(spark, f"{path}/session.bundle")
    out: dict = dict(parts)
    if "epochs" in parts:
        labels = [r.label for r in parts["epochs"].select("label").distinct().orderBy("label").collect()]  # names given by hand
        out["epochs"] = {label: parts["epochs"].where(F.col("label") == label) for label in labels}
        out["time_support"] = session_support(parts["epochs"])
    return out


def save_base(spark: SparkSession, path: str, epochs: DataFrame, position: DataFrame | None = None, **more: DataFrame) -> None:
    """A session as ``load_base`` reads it; ``epochs`` have a column ``label``."""
    from .arrays import save_bundle

    save_bundle(spark, f"{path}/session.bundle", {"epochs": epochs, **({"position": position} if position is not None else {}), **more})
