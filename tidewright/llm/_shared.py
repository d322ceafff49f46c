"""Places that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset (tests, one machine), a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, f"tidewright-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written to the shared folder once and read back: its lineage ends there, and lost executors lose nothing."""
    path = posixpath.join(shared_dir(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class NewFile:
    """An open file that has its name only once it is complete, whichever attempt of a task completes it.

    It is written under a name of its own and moved; where a move does not replace a file, one of the same size is what
    another attempt left, since all attempts write the same bytes, and any other is replaced.
    """

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        folder = posixpath.dirname(self.path)
        self.fs.create_dir(folder, recursive=True)
        self.temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
        self.out, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.temporary, self.path)
        except OSError:
            there = self.fs.get_file_info(self.path)
            if there.is_file and there.size == self.size:
                return self.fs.delete_file(self.temporary)
            if not there.is_file:
                raise
            self.fs.delete_file(self.path)
            self.fs.move(self.temporary, self.path)

    def abandon(self) -> None:
        """After an error; a killed process leaves the temporary file, which no manifest names."""
        self.out.close()
        self.fs.delete_file(self.temporary)


def quoted(name: str) -> str:
    """A column's name as the SQL parser takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it if df has such a column, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
