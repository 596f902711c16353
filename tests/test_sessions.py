"""Session folders."""

import pytest

from epochal.sources import arrays, sessions

from .helpers import S, iset, samples


def test_neurosuite_session(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<p><acquisitionSystem><nBits>16</nBits><nChannels>4</nChannels><samplingRate>20000</samplingRate></acquisitionSystem></p>")
    for shank in (1, 2):
        (tmp_path / f"s.clu.{shank}").write_text("3\n0\n2\n3\n")
        (tmp_path / f"s.res.{shank}").write_text("100\n200\n300\n")
    from epochal.sources import neuroscope

    neuroscope.write_intervals(iset(spark, [(1, 2)]), str(tmp_path / "s.sleep.evt"))
    got = sessions.load_session(spark, str(tmp_path), "neurosuite")
    assert sorted((r.shank, r.unit, r.t_ns) for r in got["spikes"].collect()) == [(1, 0, 10_000_000), (1, 1, 15_000_000), (2, 2, 10_000_000), (2, 3, 15_000_000)]
    assert got["epochs"]["sleep"].collect()[0].end_ns == 2 * S
    with pytest.raises(ValueError):
        sessions.load_session(spark, str(tmp_path), "other")
    with pytest.raises(RuntimeError, match="pynwb"):
        sessions.load_session(spark, str(tmp_path), "phy")


def test_folder_and_series(spark, tmp_path):
    (tmp_path / "in").mkdir()
    arrays.save_npz(samples(spark, [0, 1], [1.0, 2.0]), None, str(tmp_path / "in/a.npz"))
    tree = sessions.load_session(spark, str(tmp_path))
    assert tree["in"]["a"]().count() == 2
    assert [r.t_ns for r in sessions.regular_series(spark, [1, None, 3], 4.0, 1.0).collect()] == [S, S * 5 // 4, S * 3 // 2]
