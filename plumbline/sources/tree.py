"""Files whose names start with a dot, which Spark's file sources skip.

A Python data source: the driver lists the first level of each project only, every entry is a
partition, and the tasks walk below it and open the files that are asked for. Names and sizes
are tested before a file is opened, and ignored folders are not entered. The folder has to be
one that the executors see under the same path.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "project string, path string, content binary, size long"


def _source(include: str, ignore: str):
    """The data source as a class of its own, so that workers need nothing but Spark."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Entry(InputPartition):
        def __init__(self, project: str, name: str):
            self.project, self.name = project, name

    class Reader(DataSourceReader):
        def __init__(self, root: str, limit: int | None):
            self.root, self.limit = root, limit

        def partitions(self):
            out = []
            for project in sorted(os.listdir(self.root)):
                folder = os.path.join(self.root, project)
                if os.path.isdir(folder):
                    out += [Entry(project, name) for name in sorted(os.listdir(folder))]
            return out or [Entry("", "")]

        def read(self, entry):
            wanted, left_out = re.compile(include), re.compile(ignore)
            base = os.path.join(self.root, entry.project)
            below = [entry.name] if entry.name else []
            while below:
                path = below.pop()
                full = os.path.join(base, path)
                if os.path.isdir(full) and not os.path.islink(full):
                    if not left_out.search(path + "/"):
                        below += [path + "/" + name for name in os.listdir(full)]
                elif os.path.isfile(full) and os.path.basename(path).startswith(".") and wanted.search(path) and not left_out.search(path):
                    size = os.path.getsize(full)
                    if self.limit is None or size <= self.limit:
                        with open(full, "rb") as f:
                            yield entry.project, path, f.read(), size

    class DotFiles(DataSource):
        @classmethod
        def name(cls):
            return "plumbline_dot_files"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            limit = self.options.get("limit")
            return Reader(self.options["path"], int(limit) if limit else None)

    return DotFiles


def dot_files(spark: SparkSession, root: str, include: str, ignore: str, size_limit: int | None = None) -> DataFrame:
    """(project, path, content, size) of wanted files under ``root/<project>/`` whose names start with a dot."""
    spark.dataSource.register(_source(include, ignore))
    reader = spark.read.format("plumbline_dot_files").option("path", re.sub("^file:(//)?", "", root).rstrip("/"))
    return (reader if size_limit is None else reader.option("limit", str(size_limit))).load()
