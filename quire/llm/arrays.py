"""Arrays in the shared folder: written by tasks, memory-mapped by other tasks."""

from __future__ import annotations

import mmap
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow.fs as fs


class Arrays:
    """Numpy arrays by name under a folder that the driver and all executors see.

    A write goes to a file of its own and is then renamed, so a task that runs twice leaves one whole file.
    Arrays are memory-mapped: from a local path as they are, from other file systems through an unnamed local file that
    the task keeps as its cache, so a worker's memory holds what it looks up and not whole shards.
    """

    def __init__(self, uri: str):
        self.uri = uri
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"uri": self.uri, "_open": {}}

    def write(self, name: str, values: np.ndarray) -> None:
        system, path = fs.FileSystem.from_uri(self.uri)
        system.create_dir(path, recursive=True)
        part = f"{path}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(memoryview(np.ascontiguousarray(values)).cast("B") if values.size else b"")
        system.move(part, f"{path}/{name}")

    def names(self) -> set[str]:
        system, path = fs.FileSystem.from_uri(self.uri)
        return {x.base_name for x in system.get_file_info(fs.FileSelector(path, allow_not_found=True))}

    def read(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            system, path = fs.FileSystem.from_uri(self.uri)
            path = f"{path}/{name}"
            if system.get_file_info(path).size == 0:
                self._open[name] = np.zeros(0, dtype)
            elif isinstance(system, fs.LocalFileSystem):
                with open(path, "rb") as f:
                    self._open[name] = _mapped(f, dtype)
            else:
                with tempfile.TemporaryFile() as own:
                    with system.open_input_stream(path) as f:
                        shutil.copyfileobj(f, own, 4 << 20)
                    own.flush()
                    self._open[name] = _mapped(own, dtype)
        return self._open[name]


def _mapped(file, dtype) -> np.ndarray:
    """The file as an array that stays when it is closed. From Python 3.13 on a map needs no open file: a task has one for
    each array of each shard, and shards are as many as the input is large."""
    bare = {"trackfd": False} if sys.version_info >= (3, 13) else {}
    return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **bare), dtype)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted wanted values in sorted keys, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)
