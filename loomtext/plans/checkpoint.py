"""What a run has finished, so that an interrupted run can go on.

A folder holds `state.json` (version, run, fingerprint of the settings) and Parquet files of
(source_uri, checksum), one more for each finished batch: nothing of it is held on the driver, and a
batch costs what it holds. A state that cannot be read, of another version or of other settings starts anew."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

VERSION = 1
DONE = "source_uri string, checksum string"


def fingerprint(*settings: object) -> str:
    """A hash of all that decides on the output: dataclasses, mappings, sequences and plain values."""

    def plain(x: object) -> object:
        if dataclasses.is_dataclass(x) and not isinstance(x, type):
            return [type(x).__name__, {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}]
        if isinstance(x, dict) or hasattr(x, "items"):
            return {str(k): plain(v) for k, v in sorted(x.items())}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return x if x is None or isinstance(x, str | int | float | bool) else getattr(x, "__qualname__", type(x).__name__)

    return hashlib.sha256(json.dumps(plain(settings), sort_keys=True).encode()).hexdigest()[:16]


class Checkpoint:
    def __init__(self, spark: SparkSession, where: str, settings: str = "default") -> None:
        self.spark, self.where, self.settings = spark, where, settings
        self._fs, self._root = fs.FileSystem.from_uri(where if "://" in where else f"file://{where}")
        if self.state() != {"version": VERSION, "fingerprint": settings}:
            self.clear()

    def state(self) -> dict:
        try:
            with self._fs.open_input_stream(f"{self._root}/state.json") as f:
                raw = json.loads(f.read())
            return {k: raw.get(k) for k in ("version", "fingerprint")}
        except (FileNotFoundError, ValueError, AttributeError, UnicodeDecodeError):
            return {}

    def done(self) -> DataFrame:
        """(source_uri, checksum) of all that was finished."""
        found = self._fs.get_file_info(fs.FileSelector(f"{self._root}/done", allow_not_found=True))
        if not found:
            return self.spark.createDataFrame([], DONE)
        return self.spark.read.schema(DONE).parquet(*[f"{self.where}/done/{x.base_name}" for x in found])

    def skip(self, sources: DataFrame) -> DataFrame:
        """The sources that are not finished, or have changed since."""
        return sources.join(self.done(), ["source_uri", "checksum"], "left_anti").select(sources.columns)

    def mark(self, finished: DataFrame, run_id: str) -> None:
        """finished: (source_uri, checksum)."""
        finished.select("source_uri", "checksum").write.parquet(f"{self.where}/done/{uuid.uuid4().hex}")
        self._fs.create_dir(self._root, recursive=True)
        with self._fs.open_output_stream(f"{self._root}/state.json") as f:
            f.write(json.dumps({"version": VERSION, "fingerprint": self.settings, "run_id": run_id}).encode())

    def clear(self) -> None:
        for name in ("state.json", "done"):
            path = f"{self._root}/{name}"
            kind = self._fs.get_file_info(path).type
            if kind == fs.FileType.File:
                self._fs.delete_file(path)
            elif kind == fs.FileType.Directory:
                self._fs.delete_dir(path)
