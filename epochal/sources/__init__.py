"""Readers and writers. Formats that need libraries which may be absent are read through ``optional``."""

from __future__ import annotations

import importlib


def optional(library: str):
    """A library that some formats need (h5py, pynwb, neo), or an error that names it."""
    try:
        return importlib.import_module(library)
    except ImportError as e:
        raise RuntimeError(f"this format needs {library}, which is not installed; export the data to Parquet or npz first") from e
