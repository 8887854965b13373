"""A log of small JSON states in a shared folder: the latest entry holds, and no entry ever replaces another."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Journal:
    """Entries ``log/<number>`` below a folder on any file system that Spark knows.

    An entry appears at once or not at all. Writers that race for one number are told apart by a rename that fails where the
    target is there: one wins, the others see False and go by the new latest entry.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> tuple[int, dict[str, Any]]:
        """The number and the state of the latest entry; 0 and nothing before the first."""
        fs, root = self._files(), self._path("log")
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        last = max((n for n in names if n.isdigit()), default=None)
        if last is None:
            return 0, {}
        return int(last), json.loads(self.spark.read.text(f"{self.path}/log/{last}", wholetext=True).first()[0])

    def advance(self, number: int, state: dict[str, Any]) -> bool:
        """Makes ``state`` entry ``number``; False if there is such an entry already."""
        made, target = self._path(f"log/trial-{uuid.uuid4().hex}"), self._path(f"log/{number:012d}")
        jvm = self.spark._jvm
        out = self._files().create(made)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(made, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError:
            self._files().delete(made, True)
            if not self._files().exists(target):
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        """Deletes a folder beside the log."""
        self._files().delete(self._path(name), True)
