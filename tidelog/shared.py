"""Files in the folder that all machines share: whole texts that appear at once, and an append-only log of them with compare-and-set.

Paths are Hadoop paths. A file appears with its content or not at all, and only if no other has its name: by a hard link on a local disk, by
FileContext.rename elsewhere, which is atomic where the file system's rename is (HDFS and its like; not plain object stores).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession


class Folder:
    """Small files of one folder, by name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._jvm, self._conf = jvm, conf
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)
        self._local = self._fs.getUri().getScheme() == "file"
        self._fs.mkdirs(self._at(""))

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _disk(self, name: str) -> str:
        return os.path.join(self._at("").toUri().getPath(), name)

    def names(self) -> list[str]:
        """Names of the files, in order; unfinished ones (beginning with . or _) are left out."""
        return sorted(n for s in self._fs.listStatus(self._at("")) if (n := s.getPath().getName())[0] not in "._")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False, and nothing is changed, if there is one of that name."""
        side = f".{uuid.uuid4().hex}"
        if self._local:
            with open(self._disk(side), "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(self._disk(side), self._disk(name))
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(self._disk(side))
        stream = self._fs.create(self._at(side), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._at(side), self._at(name), none)
            return True
        except Exception as e:
            self._fs.delete(self._at(side), False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def remove(self, name: str = "") -> None:
        """Remove a file or folder; the whole folder without a name. What does not exist is no error."""
        self._fs.delete(self._at(name), True)


class SharedLog:
    """Entries numbered from 0 without gaps, each put by one writer: whoever puts number n first has it.

    A state is the fold of all entries; a change is made by reading them, deciding, and putting the next entry, again from the start if
    another writer was quicker. An entry with "snapshot" says that those before it are no longer needed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def read(self) -> tuple[int, list[dict]]:
        """(number of the next entry, entries from the last snapshot on)."""
        names = self.folder.names()
        entries: list[dict] = []
        for name in reversed(names):
            entries.append(json.loads(self.folder.read(name)))
            if entries[-1].get("snapshot"):
                break
        return (int(names[-1].split(".")[0]) + 1 if names else 0), entries[::-1]

    def put(self, number: int, entry: dict) -> bool:
        """Put entry `number`; False if another writer has it."""
        return self.folder.create(f"{number:012d}.json", json.dumps(entry))

    def change(self, decide: Callable[[list[dict]], tuple[dict | None, Any]]) -> Any:
        """decide(entries) -> (entry, result): put the entry, with a new decision after each conflict; result. Without entry nothing is put."""
        while True:
            number, entries = self.read()
            entry, result = decide(entries)
            if entry is None or self.put(number, entry):
                return result

    def trim(self) -> None:
        """Remove the entries before the last snapshot. The snapshot's number stays the lowest, so numbers go on."""
        names = self.folder.names()
        for at, name in reversed([*enumerate(names)]):
            if json.loads(self.folder.read(name)).get("snapshot"):
                for old in names[:at]:
                    self.folder.remove(old)
                return
