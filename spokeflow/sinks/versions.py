"""What a table consists of, in numbered version files: a writer adds the next one, a reader opens one and lists no folder.

A version is written aside and renamed to its number without overwriting, so of two writers that make the same version one
fails (as far as the file system's rename is atomic: HDFS and stores with a rename of their own; elsewhere let one writer run).
``_newest`` names the last version; it may lag by the ones whose writer was lost before it could say so, which readers look up.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Versions:
    path: str

    def read(self, spark: SparkSession, number: int) -> dict | None:
        """What version ``number`` holds; None if there is none."""
        return _read(spark, self._file(number))

    def newest(self, spark: SparkSession) -> tuple[int, dict | None]:
        """Number and content of the newest version; 0 and None before the first."""
        known = _read(spark, f"{self.path}/_newest")
        number = known["number"] if known else 0
        content = self.read(spark, number) if number else None
        while (later := self.read(spark, number + 1)) is not None:
            number, content = number + 1, later
        return number, content

    def commit(self, spark: SparkSession, number: int, content: dict) -> None:
        _write(spark, self._file(number), content, overwrite=False)
        _write(spark, f"{self.path}/_newest", {"number": number}, overwrite=True)

    def remove(self, spark: SparkSession, first: int, end: int) -> None:
        """Remove the versions from ``first`` up to but not ``end``."""
        for number in range(first, end):
            path = spark._jvm.org.apache.hadoop.fs.Path(self._file(number))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)

    def _file(self, number: int) -> str:
        return f"{self.path}/{number}.json"


def _read(spark: SparkSession, file: str) -> dict | None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    stream = files.open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write(spark: SparkSession, file: str, content: dict, overwrite: bool) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(file)
    aside = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}-{uuid.uuid4().hex}")
    files = path.getFileSystem(conf)
    out = files.create(aside, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if overwrite else kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(aside, path, options)
    except Exception as error:
        files.delete(aside, False)
        if "FileAlreadyExistsException" in str(error):
            raise VersionTaken(f"{file} was committed by another writer") from error
        raise
