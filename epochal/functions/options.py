"""Options of a session: what is warned about. They are kept in the session's configuration, so all code of it sees the same."""

from __future__ import annotations

from pyspark.sql import SparkSession

_PREFIX = "epochal."
#: Decimals of a second that times keep. Fixed: times are whole nanoseconds.
TIME_PRECISION = 9
SWITCHES = ("suppress_conversion_warnings", "suppress_time_index_sorting_warnings")


class Options:
    def __init__(self, spark: SparkSession):
        self._conf = spark.conf

    @property
    def time_index_precision(self) -> int:
        return TIME_PRECISION

    @property
    def backend(self) -> str:
        """Always Spark; there is no other to choose."""
        return "spark"

    def get(self, name: str) -> bool:
        self._known(name)
        return self._conf.get(_PREFIX + name, "false") == "true"

    def set(self, name: str, value: bool) -> None:
        self._known(name)
        if not isinstance(value, bool):
            raise ValueError(f"{name} is true or false")
        self._conf.set(_PREFIX + name, str(value).lower())

    def restore_defaults(self) -> None:
        for name in SWITCHES:
            self._conf.unset(_PREFIX + name)

    @staticmethod
    def _known(name: str) -> None:
        if name not in SWITCHES:
            raise ValueError(f"option {name!r} is none of {', '.join(SWITCHES)}")
