"""Folders of numbered versions in any store that Spark reaches.

A version counts once its marker exists. The marker is one empty file, made in one step after everything else
is in place, so a reader finds the whole of the old version or the whole of the new one, and what a broken
run leaves behind is never read.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

MARKER = "_PUBLISHED"


class Folders:
    """A few calls of the store's own interface, below one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.base = base.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def found(self, pattern: str) -> list[str]:
        """Paths below the base that match a glob, relative to it."""
        status = self._store.globStatus(self._path(f"{self.base}/{pattern}")) or []
        depth = pattern.count("/") + 1
        return sorted("/".join(str(s.getPath()).split("/")[-depth:]) for s in status)

    def remove(self, name: str) -> None:
        self._store.delete(self._path(f"{self.base}/{name}"), True)

    def touch(self, name: str) -> None:
        self._store.create(self._path(f"{self.base}/{name}"), True).close()


def number(name: str) -> int:
    """Number of ``<label>=<number>``."""
    digits = name.rsplit("=", 1)[-1]
    return int(digits) if digits.isdigit() else -1


class Versions:
    """Folders ``<label>=<number>`` below a base, of which the published ones count."""

    def __init__(self, spark: SparkSession, base: str, label: str = "version", keep: int = 2):
        self.folders, self.label, self.keep = Folders(spark, base), label, keep

    def published(self) -> list[int]:
        """Numbers that count, newest last."""
        return sorted(number(p.split("/")[0]) for p in self.folders.found(f"{self.label}=*/{MARKER}"))

    def path(self, version: int) -> str:
        return f"{self.folders.base}/{self.label}={version}"

    def newest(self) -> str | None:
        done = self.published()
        return self.path(done[-1]) if done else None

    def fresh(self) -> int:
        """A number that no run has used, finished or not."""
        return 1 + max(map(number, self.folders.found(f"{self.label}=*")), default=0)

    def publish(self, version: int) -> None:
        self.folders.touch(f"{self.label}={version}/{MARKER}")

    def tidy(self) -> None:
        """Remove all but the newest versions; one before the last stays for readers that hold it open."""
        stay = set(self.published()[-self.keep :])
        for name in self.folders.found(f"{self.label}=*"):
            if number(name) not in stay:
                self.folders.remove(name)
