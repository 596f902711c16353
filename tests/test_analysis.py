"""Correlograms, alignment, tuning, decoding, filters, spectra and sources on closed forms."""

import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochal.functions import signal
from epochal.operators import correlograms, decoding, filtering, groups, perievent, tuning
from epochal.sources import arrays, neuroscope, optional

from .helpers import S, frame, iset, samples


def test_correlograms(spark):
    x = samples(spark, [0, 10])
    e = iset(spark, [(0, 10)])
    got = {r.bin: r.value for r in correlograms.autocorrelogram(x, e, S, 100 * S, norm=False).collect()}
    assert len(got) == 201 and got[100] == 0 and got[90] == got[110] == 0.5 and sum(got.values()) == 1.0
    two = samples(spark, [0.0]).unionByName(samples(spark, [1.0], unit=1))
    got = {r.bin: r.value for r in correlograms.crosscorrelogram(two, iset(spark, [(-1, 5)]), S, 100 * S, norm=False).collect()}
    assert got[101] == 1.0 and sum(got.values()) == 1.0
    back = {r.bin: r.value for r in correlograms.crosscorrelogram(two, iset(spark, [(-1, 5)]), S, 100 * S, norm=False, reverse=True).collect()}
    assert back[99] == 1.0
    event = {(r.unit, r.bin): r.value for r in correlograms.eventcorrelogram(two, samples(spark, [0.0]), iset(spark, [(-1, 5)]), S, 100 * S, norm=False).collect()}
    assert event[0, 100] == 1.0 and event[1, 101] == 1.0
    isi = {r.bin: r.n for r in correlograms.isi_distribution(samples(spark, [0, 1, 3, 6, 10]), iset(spark, [(0, 20)]), [0, 2 * S, 4 * S]).collect()}
    assert isi == {0: 1, 1: 3}


def test_alignment(spark):
    data = samples(spark, [0.5, 1.2, 2.1, 3.5])
    marks = samples(spark, [1, 3]).withColumn("event_id", F.expr("cast(t_ns / 1000000000 as int)"))
    got = frame(perievent.perievent(data, marks, S // 2, 3 * S // 2), "event_id", "lag_ns")
    assert [round(x / S, 3) for x in got.lag_ns[got.event_id == 1]] == [-0.5, 0.2, 1.1]
    grid = samples(spark, range(100), [float(i) for i in range(100)])
    events = samples(spark, [20, 60, 99]).withColumn("event_id", F.expr("cast(t_ns / 1000000000 as int)"))
    got = frame(perievent.perievent_continuous(grid, events, 5, 10, iset(spark, [(0, 99)])), "event_id", "lag")
    assert got.v[got.event_id == 20].tolist() == list(range(15, 31)) and got.v[got.event_id == 99].isna().sum() == 10
    average = frame(perievent.event_triggered_average(samples(spark, [20.0, 60.0]), grid, iset(spark, [(0, 99)]), S, 2 * S, 2 * S), "lag")
    assert average.value.tolist() == [38, 39, 40, 41, 42]


def test_tuning_and_decoding(spark):
    times = [i / 10 for i in range(1000)]
    feature = samples(spark, times, [round(t % 10, 1) for t in times]).select("t_ns", F.col("v").alias("f"))
    unit = samples(spark, range(100))
    edges = {"f": np.linspace(0, 9.9, 11).tolist()}
    got = frame(tuning.tuning_curves(unit, feature, iset(spark, [(0, 100)]), edges, 10.0, return_counts=True), "bin_0")
    assert got.value.sum() == 100 and got.occupancy.sum() == 1000
    flat = spark.createDataFrame([(0, k, 10, 2.0) for k in range(4)] + [(1, k, 10, 4.0 if k == 0 else 0.0) for k in range(4)], "unit int, bin_0 int, occupancy long, value double")
    info = {r.unit: r.bits_per_spike for r in tuning.mutual_information(flat).collect()}
    assert info[0] == 0 and info[1] == pytest.approx(2.0)
    named = iset(spark, [(0, 100), (50, 100)]).withColumn("name", F.concat(F.lit("e"), "epoch_id"))
    assert {r.name: r.value for r in tuning.response_per_epoch(samples(spark, [0, 60, 100.0]), named).collect()} == {"e0": 0.03, "e1": 0.04}
    curves = spark.createDataFrame([(u, k, 10, 1.0 if u == k else 0.0) for u in range(3) for k in range(3)], "unit int, bin_0 int, occupancy long, value double")
    counts = spark.createDataFrame([(0, t, u, 1 if u == t % 3 else 0) for t in range(6) for u in range(3)], "epoch_id int, bin int, unit int, n long")
    for rows in (decoding.decode_bayes(counts, curves, S), decoding.decode_bayes(counts, curves, S, uniform_prior=False), *(decoding.decode_template(counts, curves, metric=m) for m in ("correlation", "euclidean", "cosine", "cityblock", "chebyshev", "braycurtis", "canberra", "sqeuclidean"))):
        assert [r.bin_0 for r in rows.orderBy("bin").collect()] == [0, 1, 2, 0, 1, 2]
    p = decoding.posterior(counts, curves, S)
    assert all(abs(r[0] - 1) < 1e-9 for r in p.groupBy("epoch_id", "bin").agg(F.sum("p")).select("sum(p)").collect())


def test_filter_design():
    fs = 100.0
    for order in (1, 2, 3, 4, 5):
        for kind, cut in (("lowpass", 10.0), ("highpass", 10.0), ("bandpass", (5.0, 20.0)), ("bandstop", (5.0, 20.0))):
            sections = signal.butter_sections(kind, cut, fs, order)
            for c in np.atleast_1d(cut):
                assert abs(signal.response(sections, np.array([2 * np.pi * c / fs]))[0]) == pytest.approx(math.sqrt(0.5), abs=1e-6), (kind, order)
    t = np.arange(500) / fs
    slow, fast = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 30 * t)
    out = signal.forward_backward(signal.butter_sections("lowpass", 10.0, fs), slow + fast)
    assert np.abs(out - slow)[50:-50].max() < 0.01
    assert np.allclose(signal.forward_backward(signal.butter_sections("lowpass", 10.0, fs), np.ones(80)), 1)
    kernel = signal.sinc_filter("lowpass", 10.0, fs)
    assert kernel.sum() == pytest.approx(1) and len(kernel) == 201 and signal.sinc_filter("highpass", 10.0, fs).sum() == pytest.approx(0, abs=1e-12)


def test_spectra(spark):
    t = np.arange(200) / 100
    x = samples(spark, t.tolist(), np.sin(2 * np.pi * 10 * t).tolist())
    psd = frame(filtering.power_spectral_density(x, 100.0, ["unit"]), "freq")
    assert psd.freq[psd.psd.idxmax()] == 10.0
    full = frame(filtering.fft(x, 100.0, ["unit"], full_range=True), "freq")
    want = np.fft.fftshift(np.fft.fft(np.sin(2 * np.pi * 10 * t)))
    assert np.allclose(full.re + 1j * full.im, want)
    w = frame(filtering.wavelet_transform(x, [10.0, 25.0], 100.0, ["unit"]), "freq", "t_ns")
    power = (w.re**2 + w.im**2).groupby(w.freq).mean()
    assert power[10.0] > 20 * power[25.0]
    assert filtering.mean_power_spectral_density(x.select("t_ns", "v"), iset(spark, [(0, 2)]), 100.0, 50).count() == 25  # 50 samples have 25 frequencies from 0 on
    assert filtering.decimate(x, 4, ["unit"]).count() == 50 == filtering.decimate(x, 4, ["unit"], filter_type="fir").count()
    with pytest.raises(Exception, match="missing"):
        filtering.apply_filter(samples(spark, [0, 1], [1.0, None]), "lowpass", 0.1, 1.0, ["unit"]).collect()


def test_groups(spark):
    x = samples(spark, range(10)).unionByName(samples(spark, range(5), unit=1)).select("unit", "t_ns")
    units = spark.createDataFrame([(0, 10.0, "a"), (1, 5.0, "b")], "unit int, rate double, kind string")
    assert groups.getby_threshold(x, units, "rate", 5.0, ">").select("unit").distinct().collect()[0].unit == 0
    with pytest.raises(RuntimeError):
        groups.getby_threshold(x, units, "rate", 5.0, "~")
    assert {r.unit: r.center for r in groups.getby_intervals(units, "rate", [0.0, 6.0, 12.0]).collect()} == {0: 9.0, 1: 3.0}
    assert groups.merge_groups([x, x], reset_index=True).select("unit").distinct().count() == 4
    with pytest.raises(ValueError):
        groups.merge_groups([x, x])
    assert {r.unit: r[1] for r in groups.subsample(x, 0.5, 1).groupBy("unit").count().collect()} == {0: 5, 1: 2}
    with pytest.raises(ValueError):
        groups.drop_info(units, ["rate"])
    assert groups.restrict_info(units, ["kind"]).columns == ["unit", "rate", "kind"]


def test_sources(spark, tmp_path):
    x, e = samples(spark, [0, 1.5, 2.000000001], [1.0, 2.0, 3.0]), iset(spark, [(0, 3)])
    path = str(tmp_path / "a.npz")
    arrays.save_npz(x, e, path)
    back = arrays.load_file(spark, path)
    assert [(r.unit, r.t_ns, r.v) for r in back.orderBy("t_ns").collect()] == [(r.unit, r.t_ns, r.v) for r in x.orderBy("t_ns").collect()]
    assert arrays.load_file(spark, path, "epochs").collect()[0].end_ns == 3 * S
    arrays.save_bundle(spark, str(tmp_path / "b.bundle"), {"data": x, "epochs": e}, {"who": "me"})
    assert arrays.load_file(spark, str(tmp_path / "b.bundle")).count() == 3 and arrays.bundle_info(spark, str(tmp_path / "b.bundle")) == {"who": "me"}
    assert arrays.catalog(spark, str(tmp_path), "t_") == ["t_b_data", "t_b_epochs"]
    raw = np.arange(40, dtype=np.int16)
    raw.tofile(tmp_path / "r.dat")
    arrays.register(spark)
    rec = spark.read.format("binary_recording").option("n_channels", 4).option("frequency", 10).option("samples_per_partition", 3).load(str(tmp_path / "r.dat"))
    assert [r.v for r in rec.where("channel = 2").orderBy("t_ns").collect()] == raw[2::4].tolist() and rec.count() == 40
    with pytest.raises(RuntimeError):
        arrays.load_file(spark, "x.csv")
    with pytest.raises(RuntimeError):
        optional("no_such_library")


def test_neuroscope(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<p><acquisitionSystem><nBits>16</nBits><nChannels>4</nChannels><samplingRate>20000</samplingRate></acquisitionSystem><fieldPotentials><lfpSamplingRate>1250</lfpSamplingRate></fieldPotentials></p>")
    head = neuroscope.read_header(str(tmp_path / "s.xml"))
    assert head["n_channels"] == 4 and head["fs_eeg"] == 1250
    (tmp_path / "s.clu.1").write_text("4\n0\n2\n1\n3\n2\n")
    (tmp_path / "s.res.1").write_text("100\n200\n300\n400\n500\n")
    got = neuroscope.read_spikes(spark, str(tmp_path / "s"), 1, 20000.0).orderBy("t_ns").collect()
    assert [(r.unit, r.t_ns) for r in got] == [(0, 10_000_000), (1, 20_000_000), (0, 25_000_000)]
    e = iset(spark, [(0.5, 1), (2, 3.25)])
    neuroscope.write_intervals(e, str(tmp_path / "a.evt"))
    assert neuroscope.read_intervals(spark, str(tmp_path / "a.evt")).collect() == e.collect()


def test_streams_equal_batch(spark, tmp_path):
    from epochal.streaming.windows import count_stream

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    import shutil

    shutil.copy(f"{sf}/events.parquet", tmp_path / "in/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = count_stream(stream, "ts", 3600, ["event_type"], late="0 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("counts").collect()) == sorted(count_stream(events, "ts", 3600, ["event_type"]).collect())


@pytest.mark.parametrize("which", ["same", "before", "all"])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("listed", [None, False, True])
def test_pair_counts(which, reverse, listed, monkeypatch):
    """Look-ups and listed pairs against all pairs, with equal times, odd bins and lags on the borders."""
    monkeypatch.setattr(correlograms, "LISTED", 50)
    rng = np.random.default_rng(5)
    for bin_ns, window_ns, names in ((3, 10, [7, 2, 40]), (4, 9, ["b", "a", "c"])):
        n = correlograms.lag_bins(window_ns, bin_ns)
        edges = np.array([-((n - 2 * k) * bin_ns // 2) for k in range(n + 1)])
        a, b = (pd.DataFrame({"unit": rng.choice(names, size), "t_ns": rng.integers(0, 60, size)}) for size in (80, 90))
        got = correlograms.pair_counts(a, b, edges, which, reverse, listed)
        want = Counter()
        for (u, s), (v, t) in itertools.product(a.itertuples(index=False), b.itertuples(index=False)):
            d = 2 * (s - t if reverse else t - s) + n * bin_ns
            if 0 <= d < 2 * n * bin_ns and {"same": u == v, "before": u < v, "all": True}[which]:
                want[u, v, d // (2 * bin_ns)] += 1
        assert {(r.unit, r.unit2, r.bin): r.n_pairs for r in got.itertuples()} == want
        assert not len(correlograms.pair_counts(a[:0], b, edges, which, reverse, listed))


def test_correlograms_list_no_pairs(spark):
    x = samples(spark, [0.0, 1.0]).unionByName(samples(spark, [1.0], unit=1))
    got = correlograms.crosscorrelogram(x, iset(spark, [(-1, 5)]), S, 100 * S)
    assert "t_ns_y" not in got._jdf.queryExecution().executedPlan().toString()
