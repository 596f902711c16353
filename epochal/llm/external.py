"""Arrays and queues of one task that move to files beyond a bound of memory.

Files lie below a folder of the shared file system, under a name of the task's own, and are read through that file system's
interface. They hold nothing that another task needs: a task that runs again starts with a folder of its own.
"""

from __future__ import annotations

import heapq
import uuid
from collections import deque

import numpy as np
from pyarrow import fs as pafs


class Space:
    """The memory in bytes from which one shard's tapes and queues take a quarter each, and the folder for what goes beyond.

    ``uri`` None: everything stays in memory.
    """

    def __init__(self, uri: str | None = None, memory: int = 64 << 20):
        self.memory, self.spilled = memory, 0
        self.fs, root = pafs.FileSystem.from_uri(uri) if uri else (None, "")
        self.folder, self.made = f"{root}/{uuid.uuid4().hex}", 0

    @property
    def chunk(self) -> int:
        """Entries that are worked on at a time."""
        return max(64, self.memory // 256)

    def full(self, held: int) -> bool:
        return self.fs is not None and held > self.memory // 4

    def new_file(self) -> str:
        if not self.made:
            self.fs.create_dir(self.folder, recursive=True)
        self.made += 1
        return f"{self.folder}/{self.made}"

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.folder)
            self.made = 0


class Tape:
    """A sequence of numbers that is written once from left to right and then read at any place."""

    def __init__(self, space: Space, dtype: str):
        self.space, self.dtype, self.n, self.held = space, np.dtype(dtype), 0, 0
        self.parts: list[np.ndarray] = []
        self.out = self.file = None
        self.path = ""

    def append(self, x: np.ndarray) -> None:
        self.parts.append(np.ascontiguousarray(x, dtype=self.dtype))
        self.n += len(x)
        self.held += self.parts[-1].nbytes
        if self.space.full(self.held):
            if self.out is None:
                self.path = self.space.new_file()
                self.out = self.space.fs.open_output_stream(self.path)
            self._flush()

    def _flush(self) -> None:
        for p in self.parts:
            self.out.write(memoryview(p).cast("B"))
            self.space.spilled += p.nbytes
        self.parts, self.held = [], 0

    def finish(self) -> Tape:
        if self.out is None:
            self.parts = [np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)]
        else:
            self._flush()
            self.out.close()
            self.file = self.space.fs.open_input_file(self.path)
        return self

    def read(self, a: int, b: int) -> np.ndarray:
        if self.file is None:
            return self.parts[0][a:b]
        z = self.dtype.itemsize
        self.file.seek(a * z)
        return np.frombuffer(self.file.read((b - a) * z), dtype=self.dtype)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these places; from a file, each block that holds some is read once."""
        if self.file is None:
            return self.parts[0][at]
        out = np.empty(len(at), dtype=self.dtype)
        order = np.argsort(at, kind="stable")
        width = self.space.chunk
        block = at[order] // width
        for part in np.split(order, np.flatnonzero(np.diff(block)) + 1) if len(at) else ():
            a = int(at[part[0]]) // width * width
            out[part] = self.read(a, min(a + width, self.n))[at[part] - a]
        return out

    def drop(self) -> None:
        if self.file is not None:
            self.file.close()
        self.parts = []


class BucketQueue:
    """Tuples by key, in order of arrival within a key. Tuples are rows of several arrays.

    When the queue holds more than its share of memory, its fullest keys go to a file.
    """

    def __init__(self, space: Space, down: bool = False):
        self.space, self.held, self.sign = space, 0, -1 if down else 1
        self.ahead: list[int] = []  # a heap of keys that hold something, the next one first
        self.keys: dict[int, deque] = {}  # tuples of arrays, or (path, place, rows, dtypes) of what is in a file
        self.size: dict[int, int] = {}  # bytes in memory by key

    def push(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        """Rows whose keys ascend."""
        if not len(keys):
            return
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        width = sum(c.itemsize for c in columns)
        for k, a, b in zip(keys[edges[:-1]].tolist(), edges, edges[1:]):
            if not self.keys.get(k):
                heapq.heappush(self.ahead, self.sign * k)
            self.keys.setdefault(k, deque()).append(tuple(c[a:b].copy() for c in columns))
            self.size[k] = self.size.get(k, 0) + (b - a) * width
        self.held += len(keys) * width
        if self.space.full(self.held):
            self._spill()

    def _spill(self) -> None:
        path = self.space.new_file()
        place = 0
        with self.space.fs.open_output_stream(path) as out:
            for k in sorted(self.size, key=self.size.get, reverse=True):
                if self.held <= self.space.memory // 8:
                    break
                entries = self.keys[k]
                kept = deque()
                for e in _joined(entries, self.space.chunk):
                    if isinstance(e[0], str):
                        kept.append(e)
                        continue
                    kept.append((path, place, len(e[0]), [c.dtype for c in e]))
                    for c in e:
                        place += out.write(np.ascontiguousarray(c))
                self.keys[k] = kept
                self.held -= self.size.pop(k)
        self.space.spilled += place

    def _load(self, k: int, entry: tuple) -> tuple[np.ndarray, ...]:
        if not isinstance(entry[0], str):
            gone = sum(c.nbytes for c in entry)
            self.size[k] -= gone
            self.held -= gone
            return entry
        path, place, rows, types = entry
        out = []
        with self.space.fs.open_input_file(path) as f:
            f.seek(place)
            for t in types:
                out.append(np.frombuffer(f.read(rows * t.itemsize), dtype=t))
        return tuple(out)

    def take(self, k: int, last: bool = False) -> tuple[np.ndarray, ...] | None:
        """The next rows of a key, or with ``last`` those that came last, in the order in which they came; None when it is empty."""
        entries = self.keys.get(k)
        if not entries:
            return None
        parts, rows = [], 0
        while entries and (not parts or rows < self.space.chunk // 2):
            parts.append(self._load(k, entries.pop() if last else entries.popleft()))
            rows += len(parts[-1][0])
        if last:
            parts.reverse()
        return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts)))

    def next(self) -> int | None:
        """The least key that holds something; the greatest if the queue is read downwards."""
        while self.ahead and not self.keys[self.sign * self.ahead[0]]:
            heapq.heappop(self.ahead)
        return self.sign * self.ahead[0] if self.ahead else None


def _joined(entries: deque, most: int):
    """The entries with small arrays in memory put together."""
    held: list[tuple] = []
    rows = 0
    for e in entries:
        if held and (isinstance(e[0], str) or rows >= most):
            yield tuple(map(np.concatenate, zip(*held)))
            held, rows = [], 0
        if isinstance(e[0], str):
            yield e
        else:
            held.append(e)
            rows += len(e[0])
    if held:
        yield tuple(map(np.concatenate, zip(*held)))
