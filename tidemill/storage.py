"""Folders that all executors share, and files in them: for what must outlive a task or a job."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, as a URI.

    Only where the session names none, and everything runs on this machine,
    a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
    return f"{as_uri(base)}/{purpose}-{uuid.uuid4().hex}"


def as_uri(folder: str) -> str:
    folder = folder.rstrip("/")
    return f"file://{folder}" if folder.startswith("/") else folder


class Folder:
    """Files of a folder, from the driver and from tasks alike."""

    def __init__(self, folder: str):
        self.uri = as_uri(folder)
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(self.uri)

    def __reduce__(self):
        return Folder, (self.uri,)

    def below(self, name: str) -> Folder:
        return Folder(f"{self.uri}/{name}")

    def names(self) -> list[str]:
        """The names of its files, sorted; none if it isn't there."""
        found = self.files.get_file_info(pyarrow.fs.FileSelector(self.root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pyarrow.fs.FileType.File and not f.base_name.startswith("."))

    def exists(self) -> bool:
        return self.files.get_file_info(self.root).type == pyarrow.fs.FileType.Directory

    def read(self, name: str) -> bytes:
        with self.files.open_input_file(f"{self.root}/{name}") as f:
            return f.read()

    def write(self, name: str, content: bytes) -> None:
        """The file is whole or not there: it is written under another name first."""
        self.files.create_dir(self.root, recursive=True)
        hidden = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        with self.files.open_output_stream(hidden, compression=None) as f:
            f.write(content)
        self.files.move(hidden, f"{self.root}/{name}")

    def clear(self) -> None:
        if self.exists():
            self.files.delete_dir(self.root)


def written_down(df: DataFrame, path: str) -> DataFrame:
    """The rows as they are now: written to the folder and read from it, so that nothing works them out twice."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
