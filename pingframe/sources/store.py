"""Stored reports: several tables that change together, in versions. A version is there once its pointer is, and a pointer is written last.

Below the root, data/<table>/schema=<k>/batch=<id> has the rows of a run as Parquet, saved/<id> says for each key (a survey) and table which batch holds its
rows, and versions/<number> is the pointer: a small JSON file that gets its name when it is whole and is never changed. What no pointer leads to is not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SAVED = "key string, tab string, digest string, batch string"
Tables = dict[str, DataFrame]


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make; what it read is out of date."""


class Unfit(ValueError):
    """Rows do not have the columns of the stored table; a migration has to change it first."""


@dataclass(frozen=True)
class Migration:
    """A step to the next schema: from the tables as they are, by name, those that it changes or adds."""

    number: int
    name: str
    change: Callable[[Tables], Tables]


class Store:
    """Tables of reports under a root that driver and executors share. Every table has the key column (a survey)."""

    def __init__(self, spark: SparkSession, root: str, key: str = "survey_id") -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, *names: str):
        path = self._hadoop.Path("/".join([self.root, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, system = self._path("versions")
        return sorted(int(f.getPath().getName()) for f in system.listStatus(path) if f.getPath().getName().isdigit()) if system.exists(path) else []

    def state(self, version: int | None = None) -> dict:
        """What a version's pointer says; of the last one, if none is named. Nothing is stored at version 0."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if not version:
            return {"version": 0, "schema": 0, "saved": None, "tables": {}, "applied": []}
        path, system = self._path("versions", f"{version:08d}")
        stream = system.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, state: dict) -> int:
        """Write the next version's pointer beside the others and give it its name, which fails if another writer has taken that; this run's rows then stay unread."""
        own, system = self._path("pointers", uuid.uuid4().hex)
        path, _ = self._path("versions", f"{state['version']:08d}")
        system.mkdirs(path.getParent())
        stream = system.create(own, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        kind = getattr(self._hadoop, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(kind, 1)
        never_over[0] = kind.valueOf("NONE")
        try:
            self._hadoop.FileContext.getFileContext(own.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, path, never_over)
        except Exception as error:  # each file system has its own
            if system.exists(path):
                raise Conflict(f"version {state['version']} is there already") from error
            raise
        return state["version"]

    def _saved(self, state: dict) -> DataFrame:
        if state["saved"] is None:
            return self.spark.createDataFrame([], SAVED)
        return self.spark.read.schema(SAVED).parquet(f"{self.root}/saved/{state['saved']}")

    def _digests(self, tables: Tables) -> DataFrame:
        """(key, tab, digest) of the rows of each key, whatever their order: their number, and sums of two hashes of each."""
        each = []
        for name, df in tables.items():
            row = [F.col(f"`{c}`") for c in df.columns]
            sums = F.sum(F.xxhash64(*row).cast("decimal(20,0)")), F.sum(F.xxhash64(F.lit(1), *row).cast("decimal(20,0)"))
            each.append(df.groupBy(F.col(self.key).cast("string").alias("key")).agg(F.concat_ws(":", F.count("*"), *sums).alias("digest")).select("key", F.lit(name).alias("tab"), "digest"))
        return reduce(DataFrame.unionByName, each)

    def _written(self, tables: Tables, saved: DataFrame, state: dict, changed: DataFrame, batch: str) -> str:
        """Write the rows of the changed keys of each table, then who has which batch; the name of the latter."""
        for name, df in tables.items():
            own = changed.where(F.col("tab") == name).select(F.col("key").alias("__key"))
            df.join(own, F.col(self.key).cast("string") == F.col("__key"), "left_semi").write.parquet(f"{self.root}/data/{name}/schema={state['tables'][name]['schema']}/batch={batch}")
        same = ["key", "tab"]
        after = saved.join(changed, same, "left_anti").unionByName(changed.withColumn("batch", F.lit(batch)).select("key", "tab", "digest", "batch"))
        after.write.parquet(f"{self.root}/saved/{batch}")
        return batch

    def save(self, tables: Tables) -> int:
        """Put the reports of all keys in tables into the store as one version, and return its number.

        A key's rows take the place of those that it had in these tables; other keys and tables stay. Keys whose rows are as they were are not
        written, and if nothing has changed, the version stays what it was. Rows without a key are not stored. A run that breaks off
        leaves the version before.
        """
        state = self.state()
        for name, df in tables.items():
            ddl = json.loads(df.schema.json())
            plain = [(f["name"], f["type"]) for f in ddl["fields"]]
            known = state["tables"].get(name)
            if known and [(f["name"], f["type"]) for f in json.loads(known["columns"])["fields"]] != plain:
                raise Unfit(f"{name} has other columns or types than the stored table")
            state["tables"].setdefault(name, {"schema": state["schema"], "columns": df.schema.json()})
        saved, batch = self._saved(state), uuid.uuid4().hex
        found = f"{self.root}/runs/{batch}"
        self._digests(tables).where("key is not null").join(saved.drop("batch"), ["key", "tab", "digest"], "left_anti").write.parquet(found)
        changed = self.spark.read.schema("key string, tab string, digest string").parquet(found)
        if changed.isEmpty():
            return state["version"]
        state["saved"] = self._written(tables, saved, state, changed, batch)
        state["version"] += 1
        return self._point(state)

    def delete(self, keys: DataFrame) -> int:
        """Take the reports of keys (a column) out of all tables, as one version."""
        state, batch = self.state(), uuid.uuid4().hex
        gone = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).distinct()
        saved = self._saved(state)
        if saved.join(gone, "key", "left_semi").isEmpty():
            return state["version"]
        saved.join(gone, "key", "left_anti").write.parquet(f"{self.root}/saved/{batch}")
        return self._point(state | {"saved": batch, "version": state["version"] + 1})

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as the last version has it, or an earlier one. Its rows are those of the batches that its keys were last saved in."""
        state = self.state(version)
        if table not in state["tables"]:
            raise KeyError(f"no table {table}")
        known = state["tables"][table]
        columns = StructType.fromJson(json.loads(known["columns"]))
        where = f"{self.root}/data/{table}/schema={known['schema']}"
        path, system = self._path("data", table, f"schema={known['schema']}")
        if state["saved"] is None or not system.exists(path):
            return self.spark.createDataFrame([], columns)
        batch = self.spark.read.schema(StructType(columns.fields).add("batch", "string")).parquet(where)
        own = self._saved(state).where(F.col("tab") == table).select(F.col("key").alias("__key"), F.col("batch").alias("__batch"))
        same = (F.col("batch") == F.col("__batch")) & (F.col(self.key).cast("string") == F.col("__key"))
        return batch.join(own, same, "left_semi").select(*[F.col(f"`{c}`") for c in columns.names])

    def migrate(self, migrations: list[Migration]) -> list[int]:
        """Apply those migrations that the store has not had, in the order of their numbers, each as one version; returns their numbers.

        Numbers go 1, 2, 3 .. without a gap, and what was applied must still be there under its name. A migration that breaks off is not recorded, those before it
        are, and the tables stay as they were after these. Only the tables that it gives back are written anew.
        """
        steps = sorted(migrations, key=lambda m: m.number)
        if [m.number for m in steps] != list(range(1, len(steps) + 1)):
            raise ValueError("migrations must be numbered from 1 on without gaps")
        done = self.state()["applied"]
        for number, name, _ in done:
            if number > len(steps) or steps[number - 1].name != name:
                raise ValueError(f"migration {number} was applied as {name}")
        return [self._migrated(m) for m in steps[len(done) :]]

    def _migrated(self, step: Migration) -> int:
        state, batch = self.state(), uuid.uuid4().hex
        tables = step.change({name: self.read(name, state["version"]) for name in state["tables"]})
        state["schema"] = step.number
        state["tables"] |= {name: {"schema": step.number, "columns": df.schema.json()} for name, df in tables.items()}
        state["applied"] = [*state["applied"], [step.number, step.name, datetime.now(UTC).isoformat()]]
        if tables:
            saved = self._saved(self.state()).where(~F.col("tab").isin(*tables))
            state["saved"] = self._written(tables, saved, state, self._digests(tables).where("key is not null"), batch)
        state["version"] += 1
        self._point(state)
        return step.number

    def vacuum(self) -> int:
        """Delete the batches and lists that only versions before the last one or broken runs have; earlier versions go. Returns how many folders went.

        No other writer may be at work.
        """
        state, gone = self.state(), 0
        kept = {r["batch"] for r in self._saved(state).select("batch").distinct().collect()}
        path, system = self._path("data")
        for f in system.globStatus(self._hadoop.Path(f"{self.root}/data/*/*/batch=*")) or []:
            if f.getPath().getName().removeprefix("batch=") not in kept:
                gone += system.delete(f.getPath(), True)
        for f in [*(system.globStatus(self._hadoop.Path(f"{self.root}/saved/*")) or []), *(system.globStatus(self._hadoop.Path(f"{self.root}/runs/*")) or []), *(system.globStatus(self._hadoop.Path(f"{self.root}/pointers/*")) or [])]:
            if f.getPath().getName() != state["saved"]:
                gone += system.delete(f.getPath(), True)
        for v in self.versions()[:-1]:
            system.delete(self._path("versions", f"{v:08d}")[0], False)
        return gone


def new_models(models: DataFrame, known: DataFrame) -> DataFrame:
    """Models (kind, name, version ..) that known has not, each kind:name@version once, that of the smallest row."""
    label = lambda: F.concat(F.col("kind"), F.lit(":"), F.col("name"), F.lit("@"), F.col("version"))
    first = models.groupBy(label().alias("model")).agg(F.min(F.struct(*models.columns)).alias("m")).select("model", "m.*")
    return first.join(known.select(label().alias("model")).distinct(), "model", "left_anti")


def segments(points: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, points): the track segments of points (by, order, lat, lon) in order; those of fewer than two points are left out.

    A segment is gathered into one row, as it is stored; a line is cut into segments of bounded length before.
    """
    placed = points.where("lat is not null and lon is not null")
    whole = placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "lat", "lon"))).alias("points"))
    return whole.where("size(points) >= 2")
