"""Numbered commit records in a folder: what the largest number says is what readers see."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Commits:
    """Records 0, 1, 2, ... under folder/_commits, each a small JSON object; one writer at a time.

    A record is written aside and renamed when it is whole, so that readers see it whole or not at all.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self._conf), path

    def numbers(self) -> list[int]:
        system, where = self._at("_commits")
        if not system.exists(where):
            return []
        names = [f.getPath().getName() for f in system.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, number: int) -> dict:
        system, where = self._at(f"_commits/{number}.json")
        stream = system.open(where)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        """The newest record and its number; -1 and an empty one before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, {})

    def add(self, number: int, record: dict) -> None:
        system, final = self._at(f"_commits/{number}.json")
        _, aside = self._at(f"_commits/.{uuid.uuid4().hex}.json")
        stream = system.create(aside, False)
        stream.write(bytearray(json.dumps(record, sort_keys=True).encode()))
        stream.close()
        if system.exists(final) or not system.rename(aside, final):
            system.delete(aside, False)
            raise FileExistsError(f"{final} is there: another writer has committed")

    def forget(self, before: int) -> None:
        """Delete the records before a number."""
        for n in self.numbers():
            if n < before:
                system, where = self._at(f"_commits/{n}.json")
                system.delete(where, False)

    def delete(self, name: str) -> None:
        """Delete a folder below this one."""
        system, where = self._at(name)
        system.delete(where, True)

    def folders(self, below: str) -> list[str]:
        system, where = self._at(below)
        return sorted(f.getPath().getName() for f in system.listStatus(where) if f.isDirectory()) if system.exists(where) else []

    def size(self, name: str) -> int:
        system, where = self._at(name)
        return system.getContentSummary(where).getLength()
