"""Writing and changing canonical tables, kept as Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, empty, struct

#: Tables that are laid out by a column that most reads filter by.
PARTITIONED = {"events": ["format_id"]}


class Store:
    """The canonical tables below one folder. A table that was never written is empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _files(self):
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        return make(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), make

    def _there(self, path: str) -> bool:
        files, make = self._files()
        return files.exists(make(path))

    def _standing(self, name: str) -> str | None:
        """Where the table is: in its place or, if a swap was broken off in the middle, beside it."""
        return next((p for p in (self.path(name), self._before(name)) if self._there(p)), None)

    def _before(self, name: str) -> str:
        return f"{self.root}/_{name}-before"

    def exists(self, name: str) -> bool:
        return self._standing(name) is not None

    def read(self, name: str) -> DataFrame:
        path = self._standing(name)
        if path is None:
            return empty(self.spark, name)
        return self.spark.read.schema(struct(TABLES[name])).parquet(path)

    def _typed(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in struct(TABLES[name]).fields])

    def write(self, name: str, rows: DataFrame, mode: str = "errorifexists") -> None:
        """The table's own columns of ``rows``, cast to its types."""
        self._typed(name, rows).write.mode(mode).partitionBy(*PARTITIONED.get(name, [])).parquet(self.path(name))

    def stage(self, name: str, rows: DataFrame, counts: dict[str, str] | None = None) -> tuple[str, dict[str, int]]:
        """Writes rows beside the table; says where, for ``put`` to take them for the table, and what was counted.

        counts: aggregates over any columns of ``rows``, as SQL; they are taken while the rows are written, without another pass.
        """
        beside = f"{self.root}/_{name}-{uuid.uuid4().hex}"
        if counts:
            seen = Observation(f"{name}-{uuid.uuid4().hex}")
            rows = rows.observe(seen, *[F.expr(c).alias(k) for k, c in counts.items()])
        self._typed(name, rows).write.partitionBy(*PARTITIONED.get(name, [])).parquet(beside)
        return beside, dict(seen.get) if counts else {}

    def put_files(self, name: str, beside: str, mark: str) -> None:
        """Moves the files of what was staged into the table, their names beginning with ``mark``; files that have it already go first."""
        files, make = self._files()
        self.take_out(name, mark)
        for file in self._parts(beside):
            inner = file[len(files.makeQualified(make(beside)).toString()) + 1 :]
            folder, _, last = f"{self.path(name)}/{inner}".rpartition("/")
            files.mkdirs(make(folder))
            self._move(file, f"{folder}/{mark}{last}")
        self.drop(beside)

    def take_out(self, name: str, mark: str) -> None:
        """Deletes the table's files whose names begin with ``mark``."""
        files, make = self._files()
        for file in self._parts(self.path(name)):
            if file.rpartition("/")[2].startswith(mark):
                files.delete(make(file), False)

    def _parts(self, folder: str) -> list[str]:
        """The Parquet files below a folder, on the driver: names only."""
        files, make = self._files()
        if not files.exists(make(folder)):
            return []
        found, out = files.listFiles(make(folder), True), []
        while found.hasNext():
            path = found.next().getPath().toString()
            if path.endswith(".parquet"):
                out.append(path)
        return sorted(out)

    def staged(self, name: str, beside: str) -> DataFrame:
        return self.spark.read.schema(struct(TABLES[name])).parquet(beside)

    def put(self, name: str, beside: str) -> None:
        """Replaces a table by what was staged. At every moment the old or the new rows are read."""
        files, make = self._files()
        here, before = self.path(name), self._before(name)
        if self._there(here):
            files.delete(make(before), True)
            self._move(here, before)
        self._move(beside, here)
        files.delete(make(before), True)

    def _move(self, a: str, b: str) -> None:
        files, make = self._files()
        if not files.rename(make(a), make(b)):
            raise OSError(f"{a} could not be moved to {b}")

    def drop(self, beside: str) -> None:
        files, make = self._files()
        files.delete(make(beside), True)

    def swap(self, name: str, rows: DataFrame) -> None:
        """Replaces a table by rows that may be made from it."""
        self.put(name, self.stage(name, rows)[0])

    def load_cards(self, cards: DataFrame) -> None:
        """Writes the card table. Raises RuntimeError if there are cards already, since ids may be in use."""
        if self.exists("cards") and not self.read("cards").isEmpty():
            raise RuntimeError("the card table is not empty")
        self.write("cards", cards, "overwrite")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not among them."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: list[str]) -> DataFrame:
    """Old and new rows by key; of a key in both, the columns ``replace`` are the new row's."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    found = F.coalesce(*[F.col(f"n.{k}").isNotNull() for k in keys], F.lit(False))
    out = []
    for c in old.columns:
        if c in keys or c not in replace:
            out.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(found, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out)


def upsert_additive(old: DataFrame, new: DataFrame, keys: list[str], add: list[str]) -> DataFrame:
    """Rows of both by key, their ``add`` columns summed."""
    both = old.select(*keys, *add).unionByName(new.select(*keys, *add))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in add])
