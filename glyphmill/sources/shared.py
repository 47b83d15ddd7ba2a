"""The folder that all machines of a session share, and small files in it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, which ``spark.checkpoint.dir`` names; where it
    is not set, a temporary one in local mode (tests), and an error on a cluster,
    whose machines share no such folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = held.rsplit("/", 1)[0] if held else "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        if not held:
            spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/glyphmill/{spark.sparkContext.applicationId}"


class Folder:
    """A folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.at.getFileSystem(self.conf)

    def names(self) -> list[str]:
        """Names of the files in it; none if it isn't there."""
        return [s.getPath().getName() for s in self.store.listStatus(self.at)] if self.store.exists(self.at) else []

    def mark(self, name: str) -> bool:
        """Makes an empty file, all at once; False if there is one of that name."""
        self.store.mkdirs(self.at)
        return self.store.createNewFile(self.jvm.org.apache.hadoop.fs.Path(self.at, name))

    def delete(self, name: str | None = None) -> None:
        self.store.delete(self.jvm.org.apache.hadoop.fs.Path(self.at, name) if name else self.at, True)

    def qualified(self) -> str:
        """The path with its scheme, as it is the same on all machines."""
        return re.sub("^file:/(?!//)", "file:///", self.store.makeQualified(self.at).toString())
