"""Archives, matrices, sorting and imaging folders, and containers behind libraries that are absent here."""

import sys
import types

import numpy as np
import pytest

from epochal.sources import arrays, containers, recordings, sessions

from .helpers import S, frame, iset, pairs, samples


def test_archive_of_each_kind(spark, tmp_path):
    e = iset(spark, [(0, 9)])
    path = lambda n: str(tmp_path / f"{n}.npz")
    ts = samples(spark, [1, 2, 3]).select("t_ns")
    arrays.save_npz(ts, e, path("ts"))
    tsd = samples(spark, [1, 2, 3], [1.0, None, 3.0]).select("t_ns", "v")
    arrays.save_npz(tsd, e, path("tsd"))
    cells = spark.createDataFrame([(t * S, c, float(t * k)) for t in range(3) for k, c in enumerate("ab")], "t_ns long, col string, v double")
    arrays.save_npz(cells, e, path("frame"), spark.createDataFrame([("b", "y", 2), ("a", "x", 1)], "col string, name string, depth int"))
    tensor = spark.createDataFrame([(t * S, i, j, float(t + 10 * i + 100 * j)) for t in range(3) for i in range(2) for j in range(3)], "t_ns long, i int, j int, v double")
    arrays.save_npz(tensor, e, path("tensor"), dims=["i", "j"])
    group = samples(spark, [1, 2], unit=4).unionByName(samples(spark, [3], unit=2)).select("unit", "t_ns")
    arrays.save_npz(group, e, path("group"), spark.createDataFrame([(2, "deep"), (4, "flat")], "unit int, area string"))
    arrays.save_npz(iset(spark, [(0, 1), (2, 3)], label=["p", "q"]), None, path("epochs"))
    kinds = {}
    for n in ("ts", "tsd", "frame", "tensor", "group", "epochs"):
        with arrays.open_archive(path(n)) as a:
            kinds[n] = arrays.archive_kind(a)
    assert kinds == {"ts": "Ts", "tsd": "Tsd", "frame": "TsdFrame", "tensor": "TsdTensor", "group": "TsGroup", "epochs": "IntervalSet"}

    def load(n, part="data"):
        return arrays.load_file(spark, path(n), part)

    assert [r.t_ns for r in load("ts").orderBy("t_ns").collect()] == [S, 2 * S, 3 * S] and pairs(load("ts", "epochs")) == [(0, 9)]
    assert [r.v for r in load("tsd").orderBy("t_ns").collect()] == [1.0, None, 3.0]
    assert sorted(map(tuple, load("frame").select("t_ns", "col", "v").collect())) == sorted(map(tuple, cells.collect()))
    assert sorted(map(tuple, load("tensor").collect())) == sorted(map(tuple, tensor.collect()))
    assert sorted(map(tuple, load("group").select("unit", "t_ns").collect())) == sorted(map(tuple, group.collect()))
    meta = lambda n: {(r.key, r.name): r.value for r in load(n, "metadata").collect()}
    assert meta("frame") == {("a", "name"): '"x"', ("b", "name"): '"y"', ("a", "depth"): "1", ("b", "depth"): "2"}
    assert meta("group") == {("2", "area"): '"deep"', ("4", "area"): '"flat"'} and meta("epochs") == {("0", "label"): '"p"', ("1", "label"): '"q"'} and meta("ts") == {}


def test_archives_of_others(spark, tmp_path):
    """Without a stored type, and with pickled metadata, which only a trusted archive gives."""
    path = str(tmp_path / "o.npz")
    np.savez(path, t=[0.0, 1.0], d=np.ones((2, 2)), start=[0.0], end=[1.0], columns=np.array(["a", "b"]), _metadata={"k": np.array([5, 6])})
    assert arrays.load_file(spark, path).count() == 4 and arrays.load_file(spark, path, "metadata").count() == 0
    assert sorted((r.key, r.value) for r in arrays.load_file(spark, path, "metadata", trusted=True).collect()) == [("a", "5"), ("b", "6")]
    np.savez(path, t=[0.0, 1.0], d=np.ones((2, 2, 2)), start=[0.0], end=[1.0])
    assert arrays.load_file(spark, path).columns == ["t_ns", "i", "j", "v"]


def test_binary_files_and_signals(spark, tmp_path):
    x = np.arange(24, dtype="<i2").reshape(8, 3)
    x.tofile(tmp_path / "r.dat")
    one = frame(arrays.load_binary_file(spark, str(tmp_path / "r.dat"), 1, 3, 10.0), "t_ns")
    assert one.v.tolist() == x[:, 1].tolist() and one.t_ns.tolist() == [k * S // 10 for k in range(8)]
    assert arrays.load_binary_file(spark, (tmp_path / "r.dat").as_uri(), [0, 2], 3, 10.0).count() == 16
    with pytest.warns(DeprecationWarning):
        assert arrays.load_eeg(spark, str(tmp_path / "r.dat"), 0, 3).count() == 8
    bundle = str(tmp_path / "b.bundle")
    arrays.save_bundle(spark, bundle, {"epochs": iset(spark, [(0, 1)])})
    for _ in range(2):
        arrays.append_signal(spark, bundle, "lfp", samples(spark, [1, 2], [3.0, 4.0]))
    assert arrays.load_bundle(spark, bundle)["lfp"].count() == 4
    with pytest.raises(ValueError):
        arrays.append_signal(spark, bundle, "lfp", iset(spark, [(0, 1)]))


def test_matrix(spark, tmp_path):
    x = np.arange(30.0).reshape(10, 3)
    np.save(tmp_path / "m.npy", x)
    m = recordings.read_npy(spark, str(tmp_path / "m.npy"), 7)
    assert m.rdd.getNumPartitions() == 5 and np.array_equal(frame(m, "r", "c").v.to_numpy().reshape(10, 3), x)
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(Exception, match="row by row"):
        recordings.read_npy(spark, str(tmp_path / "f.npy")).count()


def test_phy(spark, tmp_path):
    np.save(tmp_path / "spike_times.npy", np.array([100, 200, 300, 400]))
    np.save(tmp_path / "spike_clusters.npy", np.array([5, 7, 5, 9], dtype=np.int32))
    (tmp_path / "params.py").write_text("dat_path = 'x'\nsample_rate = 1000.0\n")
    (tmp_path / "cluster_group.tsv").write_text("cluster_id\tgroup\n5\tgood\n7\tnoise\n9\tmua\n")
    got = sessions.load_session(spark, str(tmp_path), "phy")
    assert sorted((r.unit, r.t_ns) for r in got["spikes"].collect()) == [(5, S // 10), (5, 3 * S // 10), (9, 4 * S // 10)]
    assert sorted((r.unit, r.group) for r in got["units"].collect()) == [(5, "good"), (9, "mua")]


def test_suite2p(spark, tmp_path):
    for k in range(2):
        plane = tmp_path / f"plane{k}"
        plane.mkdir()
        np.save(plane / "iscell.npy", np.array([[1, 0.9], [0, 0.2], [1, 0.8]]))
        for name in ("F", "Fneu", "spks"):
            np.save(plane / f"{name}.npy", np.arange(12.0).reshape(3, 4) + 100 * k)
    got = recordings.load_suite2p(spark, str(tmp_path), fs=2.0)
    assert [(r.plane, r.place, r.roi) for r in got["cells"].orderBy("roi").collect()] == [(0, 0, 0), (0, 2, 1), (1, 0, 2), (1, 2, 3)]
    assert frame(got["F"].where("roi = 3"), "t_ns").v.tolist() == [108.0, 109.0, 110.0, 111.0] and got["spks"].count() == 16
    assert sessions.load_session(spark, str(tmp_path), "suite2p")["Fneu"].count() == 16


def test_base_session(spark, tmp_path):
    epochs = iset(spark, [(0, 5), (5.0000005, 9), (20, 30)], label=["sleep", "wake", "sleep"])
    sessions.save_base(spark, str(tmp_path), epochs, samples(spark, [0, 1], [1.0, 2.0]))
    got = sessions.load_session(spark, str(tmp_path), "base")
    assert pairs(got["time_support"]) == [(0, 9), (20, 30)] and pairs(got["epochs"]["sleep"]) == [(0, 5), (20, 30)] and got["position"].count() == 2


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    root = sessions.Folder(spark, str(tmp_path))
    root.save("x", samples(spark, [1, 2], [3.0, 4.0]).select("t_ns", "v"), iset(spark, [(0, 5)]), "a trace")
    root["sub"].save("e", iset(spark, [(0, 1)]))
    assert root.view() == f"{tmp_path.name}\n├── sub\n│   └── e.npz\n└── x.npz" and root.keys() == ["sub", "x"]
    assert root["x"].count() == 2 and pairs(root["sub"]["e"]) == [(0, 1)] and root["x"] is root["x"]
    assert root.metadata("x")["info"] == "a trace" and root.info("x") == root.doc("x") == "a trace" and root.metadata("y") == {}
    assert set(root.load()) == {"sub", "x"}
    with pytest.raises(KeyError):
        root["none"]


PYNWB = """
import numpy as np
class TimeIntervals(dict):
    name = "trials"; parent = None
class Units(dict):
    name = "units"; parent = None
    def __len__(self): return 2
class Series:
    parent = type("P", (), {"name": "box"})
    def __init__(self, name, data, t=None): self.name, self.data, self.timestamps, self.rate, self.starting_time = name, data, t, 2.0, 1.0
class _File:
    objects = {"a": TimeIntervals(start_time=np.array([0.0, 2.0]), stop_time=np.array([1.0, 3.0])), "b": Units(spike_times=[np.array([0.5]), np.array([1.5, 2.5])]), "c": Series("x", np.arange(6.0).reshape(3, 2)), "d": Series("y", np.arange(3.0), np.array([0.0, 5.0, 7.0]))}
class NWBHDF5IO:
    def __init__(self, *a, **k): pass
    def __enter__(self): return self
    def __exit__(self, *a): pass
    def read(self): return _File()
"""
NEO = """
import numpy as np
class _Train:
    def __init__(self, t): self.times = np.array(t)
class _Signal(_Train):
    def __init__(self, t, v): super().__init__(t); self.magnitude = np.array(v)
class _Segment:
    def __init__(self, k): self.t_start, self.t_stop, self.analogsignals, self.spiketrains = 10.0 * k, 10.0 * k + 5, [_Signal([10.0 * k, 10.0 * k + 1], [[1.0, 2.0], [3.0, 4.0]])], [_Train([10.0 * k + 2]), _Train([])]
class _Reader:
    def read_block(self, lazy): return type("B", (), {"segments": [_Segment(k) for k in range(3)]})
class io:
    @staticmethod
    def get_io(path): return _Reader()
"""


def test_containers(monkeypatch):
    """The readers against stand-ins for the libraries: what the driver lists and what each partition reads."""
    for name, text in (("pynwb", PYNWB), ("neo", NEO)):
        stand_in = types.ModuleType(name)
        exec(text, stand_in.__dict__)
        monkeypatch.setitem(sys.modules, name, stand_in)
    assert {n: v[1:] for n, v in containers.nwb_objects("f.nwb").items()} == {"trials": ("epochs", 2, 1), "units": ("units", 2, 1), "x": ("signal", 3, 2), "y": ("signal", 3, 1)}
    assert set(containers.nwb_objects("f.nwb", "Units")) == {"trials", "units"} and set(containers.nwb_objects("f.nwb", "Series")) == {"trials", "x", "y"}
    nwb = containers._NwbReader({"path": "f.nwb", "object": "c", "kind": "signal", "rows": "3", "rows_per_partition": "2"})
    rows = [r for p in nwb.partitions() for b in nwb.read(p) for r in b.to_pylist()]
    assert len(nwb.partitions()) == 2 and sorted((r["t_ns"], r["col"], r["v"]) for r in rows) == [(S, "0", 0.0), (S, "1", 1.0), (S * 3 // 2, "0", 2.0), (S * 3 // 2, "1", 3.0), (2 * S, "0", 4.0), (2 * S, "1", 5.0)]
    units = containers._NwbReader({"path": "f.nwb", "object": "b", "kind": "units", "rows": "2", "rows_per_partition": "1"})
    assert [(r["unit"], r["t_ns"]) for p in units.partitions() for b in units.read(p) for r in b.to_pylist()] == [(0, S // 2), (1, S * 3 // 2), (1, S * 5 // 2)]
    for part, want in (("signal", 12), ("units", 3), ("epochs", 3)):
        neo = containers._NeoReader({"path": "r", "part": part})
        assert len(neo.partitions()) == 3 and sum(b.num_rows for p in neo.partitions() for b in neo.read(p)) == want


def test_absent_libraries_are_named():
    with pytest.raises(RuntimeError, match="no_such_library_for_tests"):
        from epochal.sources import optional

        optional("no_such_library_for_tests")
