"""Versions of a persisted state: small files that are each made once, in a folder that all writers share.

A state counts from the moment its file is there whole; the file of a number can be made only once, so of two writers that meet one
fails and changes nothing. A version that its writer left unfinished is passed over, and its number isn't given again.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fs(self, name: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def numbers(self) -> list[int]:
        fs, at = self.fs("versions")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict | None:
        """The state of a number; None if its writer died before it was whole."""
        fs, at = self.fs(f"versions/{number}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def current(self) -> tuple[int, dict | None]:
        """(the last number or -1, the newest whole state or None)."""
        numbers = self.numbers()
        found = next((s for n in reversed(numbers) if (s := self.read(n)) is not None), None)
        return (numbers[-1] if numbers else -1), found

    def commit(self, number: int, state: dict) -> None:
        fs, at = self.fs(f"versions/{number}.json")
        try:
            out = fs.create(at, False)
        except Exception as e:  # noqa: BLE001 - whatever the file system raises for a file that is there
            raise Conflict(f"{self.path}: version {number} is there already") from e
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()

    def clean(self, folder: str, keep: set[str]) -> list[str]:
        """Removes what lies in a folder and isn't to be kept, and all versions before the newest whole one. Not to be run beside a writer or a reader of an older version."""
        fs, at = self.fs(folder)
        gone = []
        for x in fs.listStatus(at) if fs.exists(at) else []:
            if (name := x.getPath().getName()) not in keep:
                fs.delete(x.getPath(), True)
                gone.append(name)
        numbers = self.numbers()
        newest = next((n for n in reversed(numbers) if self.read(n) is not None), -1)
        for n in numbers:
            if n < newest:
                fs.delete(self.fs(f"versions/{n}.json")[1], False)
        return gone
