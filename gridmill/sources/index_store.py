"""Stored indexes: folders that are built once for the files they are made of, and opened again while these stay as they are."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from gridmill.sources.tables import home


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = hadoop(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, sorted; none if it is not there."""
    fs, where = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []


def publish(spark: SparkSession, made: str, path: str) -> bool:
    """Moves a finished folder to its place; False, and the folder is deleted, if another one was there first.

    Rename into a folder that exists would move below it, so the place is looked at first and again after.
    """
    fs, source = hadoop(spark, made)
    _, target = hadoop(spark, path)
    fs.mkdirs(target.getParent())
    if not fs.exists(target):
        with contextlib.suppress(Py4JJavaError):
            if fs.rename(source, target) and not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target, source.getName())):
                return True
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(target, source.getName()), True)
    fs.delete(source, True)
    return False


#: Changes with what the folders hold, so that those of an older library are not opened.
FORMAT = 1


def fingerprint(inputs: list[DataFrame], settings: str) -> str:
    """Of the files that the frames read, their sizes and times, and of the settings of an index."""
    spark = inputs[0].sparkSession
    told = []
    for name in sorted({f for df in inputs for f in df.inputFiles()}):
        fs, where = hadoop(spark, name)
        status = fs.getFileStatus(where)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join([str(FORMAT), settings, *told]).encode()).hexdigest()[:24]


def opened(name: str, inputs: list[DataFrame], settings: str, build: Callable[[str], None]) -> str:
    """The folder of the index ``name`` over ``inputs``; ``build`` writes it if it is not there yet.

    It appears whole or not at all, so a build that fails is begun again and two at once do no harm.
    """
    spark = inputs[0].sparkSession
    path = f"{home(spark)}/index-{name}-{fingerprint(inputs, settings)}"
    if not exists(spark, path):
        made = f"{path}.{uuid.uuid4().hex}"
        build(made)
        publish(spark, made, path)
    return path
