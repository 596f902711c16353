"""Containers that need a library of their own (NWB files, recordings that neo opens), read by tasks and not by the driver.

The driver only lists what is inside; each partition opens the file itself and reads a range of rows, or a segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.time import SECOND
from . import optional

_SCHEMAS = {"epochs": "epoch_id int, start_ns long, end_ns long", "units": "unit int, t_ns long", "signal": "t_ns long, col string, v double"}


class _Part(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__(first)
        self.first, self.end = first, end


def _ns(t) -> np.ndarray:
    return np.rint(np.asarray(t, dtype=float) * SECOND).astype(np.int64)


def _signal_batches(t: np.ndarray, data: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    data = np.asarray(data, dtype=float).reshape(len(t), -1)
    for k in range(data.shape[1]):
        yield pa.RecordBatch.from_arrays([pa.array(_ns(t)), pa.array([names[k] if k < len(names) else str(k)] * len(t)), pa.array(data[:, k], from_pandas=True)], names=["t_ns", "col", "v"])


def nwb_objects(path: str, wanted: str | None = None) -> dict[str, tuple[str, str, int, int]]:
    """Name to (identifier, kind, rows, columns) of what can be read; names that occur twice get their parent's before them.
    ``wanted`` is the type to which objects are confined, intervals aside."""
    pynwb = optional("pynwb")
    listed = []
    with pynwb.NWBHDF5IO(path, "r", load_namespaces=True) as io:
        for key, item in io.read().objects.items():
            kind = type(item).__name__
            if wanted not in (None, kind) and kind != "TimeIntervals":
                continue
            if kind == "TimeIntervals":
                listed.append((item, key, "epochs", len(item["start_time"]), 1))
            elif kind == "Units":
                listed.append((item, key, "units", len(item), 1))
            elif hasattr(item, "data") and hasattr(item, "rate"):
                listed.append((item, key, "signal", len(item.data), int(np.prod(np.shape(item.data)[1:]) or 1)))
        names = [x[0].name for x in listed]
        return {(x[0].name if names.count(x[0].name) == 1 else f"{getattr(x[0].parent, 'name', '')}/{x[0].name}"): x[1:] for x in listed}


class NwbObject(DataSource):
    """One object of an NWB file: ``object`` is its identifier, ``kind`` epochs, units or signal, ``rows`` how many it has."""

    @classmethod
    def name(cls) -> str:
        return "nwb_object"

    def schema(self) -> str:
        return _SCHEMAS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return _NwbReader(dict(self.options))


class _NwbReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.object, self.kind = options["path"], options["object"], options["kind"]
        self.rows, self.per = int(options["rows"]), int(options["rows_per_partition"])

    def partitions(self):
        return [_Part(a, min(a + self.per, self.rows)) for a in range(0, self.rows, self.per)] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        a, b = partition.first, partition.end
        with optional("pynwb").NWBHDF5IO(self.path, "r", load_namespaces=True) as io:
            item = io.read().objects[self.object]
            if self.kind == "epochs":
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int32)), pa.array(_ns(item["start_time"][a:b])), pa.array(_ns(item["stop_time"][a:b]))], names=["epoch_id", "start_ns", "end_ns"])
            elif self.kind == "units":
                for u in range(a, b):
                    t = _ns(item["spike_times"][u])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), u, dtype=np.int32)), pa.array(t)], names=["unit", "t_ns"])
            else:
                # timestamps as stored, or made from the starting time and the rate
                t = np.asarray(item.timestamps[a:b]) if item.timestamps is not None else item.starting_time + np.arange(a, b) / item.rate
                yield from _signal_batches(t, item.data[a:b], [])


def load_container(spark: SparkSession, path: str, wanted: str | None = None, values_per_partition: int = 1 << 22) -> dict[str, DataFrame]:
    """Time series (t_ns, col, v), intervals and units of an NWB file by name, where the library is installed."""
    spark.dataSource.register(NwbObject)
    out = {}
    for name, (key, kind, rows, columns) in nwb_objects(path, wanted).items():
        per = max(1, values_per_partition // columns) if kind == "signal" else max(1, min(rows, 1000))
        out[name] = spark.read.format("nwb_object").option("object", key).option("kind", kind).option("rows", rows).option("rows_per_partition", per).load(path)
    return out


class NeoSignals(DataSource):
    """What neo reads of a recording: ``part`` is ``signal`` (t_ns, col, v), ``units`` (unit, t_ns) or ``epochs``; a partition is a segment."""

    @classmethod
    def name(cls) -> str:
        return "neo_recording"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("part", "signal")]

    def reader(self, schema) -> DataSourceReader:
        return _NeoReader(dict(self.options))


def _seconds(x) -> np.ndarray:
    return np.asarray(x.rescale("s").magnitude if hasattr(x, "rescale") else x, dtype=float)


class _NeoReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part, self.signal = options["path"], options.get("part", "signal"), int(options.get("signal", 0))

    def _block(self):
        return optional("neo").io.get_io(self.path).read_block(lazy=True)

    def partitions(self):
        return [_Part(k, k + 1) for k in range(len(self._block().segments))] or [_Part(0, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.end == partition.first:
            return
        segment = self._block().segments[partition.first]
        loaded = lambda x: x.load() if hasattr(x, "load") else x
        if self.part == "signal" and segment.analogsignals:
            signal = loaded(segment.analogsignals[self.signal])
            names = [str(n) for n in signal.array_annotations.get("channel_names", [])] if hasattr(signal, "array_annotations") else []
            yield from _signal_batches(_seconds(signal.times), np.asarray(getattr(signal, "magnitude", signal)), names)
        elif self.part == "units":
            for u, train in enumerate(segment.spiketrains):
                t = _ns(_seconds(loaded(train).times))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), u, dtype=np.int32)), pa.array(t)], names=["unit", "t_ns"])
        elif self.part == "epochs":
            start, end = _seconds(segment.t_start), _seconds(segment.t_stop)
            yield pa.RecordBatch.from_arrays([pa.array([partition.first], pa.int32()), pa.array(_ns(start).reshape(1)), pa.array(_ns(end).reshape(1))], names=["epoch_id", "start_ns", "end_ns"])


def read_ephys(spark: SparkSession, path: str, signal: int = 0) -> dict[str, DataFrame]:
    """signal, units and epochs (one per segment) of a recording that neo opens, one task per segment."""
    spark.dataSource.register(NeoSignals)
    return {part: spark.read.format("neo_recording").option("part", part).option("signal", signal).load(path) for part in ("signal", "units", "epochs")}
