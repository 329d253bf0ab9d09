"""Tables fed by batches: sorted runs, merged by size, that become visible together.

A batch writes one run a table; the manifest of the batch names all runs of all tables and
is renamed into place last, so readers see the whole batch or nothing of it. A batch done
again starts from the manifest before it and replaces its own. Runs of a level are
merged into one of the next when there are ``FAN`` of them, so their number grows with the
logarithm of the batches.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of one level before they are merged, rows of a file, rows of a page within it.
FAN, FILE_ROWS, PAGE_ROWS = 8, 1_000_000, 1_000
#: Keys that are looked up by filters pushed to the files, so many in one scan; beyond that all keys are read.
PUSHED, PUSHED_AT_ONCE = 16_384, 256


@dataclass(frozen=True)
class Table:
    """Columns, the columns that its runs are sorted by, whether runs are merged (not worth it for file contents), rows of a file."""

    schema: str
    key: tuple[str, ...]
    merged: bool = True
    file_rows: int = FILE_ROWS


class RunStore:
    """One writer at a time; readers take what the last manifest names."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---------------------------------------------------------------

    def _listed(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def batches(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._listed("_commits") if n.endswith(".json")]

    def manifest(self, before: int | None = None) -> dict[str, list[dict]]:
        """``table -> runs`` of the last batch, or of the last one before a batch."""
        seen = [b for b in self.batches() if before is None or b < before]
        if not seen:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_commits/{max(seen):012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, batch: int, runs: dict[str, list[dict]]) -> None:
        hidden = self._path(f"{self.root}/_commits/_{uuid.uuid4().hex}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        shown = self._path(f"{self.root}/_commits/{batch:012d}.json")
        if self._fs.exists(shown):
            self._fs.delete(shown, False)
        if not self._fs.rename(hidden, shown):
            raise OSError(f"could not publish batch {batch}")

    def _clean(self, batch: int) -> None:
        """Remove manifests and runs that neither this batch nor the one before it names, those of killed attempts too."""
        kept = sorted(b for b in self.batches() if b <= batch)[-2:]
        named = {r["path"] for b in kept for runs in self.manifest(b + 1).values() for r in runs}
        for b in self.batches():
            if b < kept[0]:
                self._fs.delete(self._path(f"{self.root}/_commits/{b:012d}.json"), False)
        for table in self.tables:
            for name in self._listed(f"table={table}"):
                if f"table={table}/{name}" not in named:
                    self._fs.delete(self._path(f"{self.root}/table={table}/{name}"), True)

    # --- reading -----------------------------------------------------------------

    def _read(self, table: str, runs: list[dict]) -> DataFrame:
        schema = self.tables[table].schema
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{r['path']}" for r in runs])

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """All rows of a table, or those before a batch."""
        return self._read(table, self.manifest(before).get(table, []))

    def lookup(self, table: str, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of a table whose first key column is in the column of the same name of ``keys``.

        Runs are sorted by it and carry Bloom filters, and equality filters reach the pages of the files, so what
        is read follows the keys. More than ``PUSHED`` keys read the column in full.
        """
        column = self.tables[table].key[0]
        wanted = keys.select(column).where(F.col(column).isNotNull()).distinct()
        rows = self.read(table, before)
        some = sorted(r[0] for r in wanted.limit(PUSHED + 1).collect())  # bounded by PUSHED
        if len(some) > PUSHED:
            return rows.join(wanted, column, "left_semi").select(*rows.columns)
        parts = [rows.where(_any(F.col(column), some[i : i + PUSHED_AT_ONCE])) for i in range(0, len(some), PUSHED_AT_ONCE)]
        return reduce(DataFrame.unionByName, parts) if parts else rows.where("false")

    # --- writing -----------------------------------------------------------------

    def _write(self, table: str, batch: int, rows: DataFrame, level: int, count: int) -> dict:
        spec = self.tables[table]
        path = f"table={table}/run={batch:012d}-{level}-{uuid.uuid4().hex}"
        files = max(1, -(-count // spec.file_rows))
        dealt = rows.repartitionByRange(files, *spec.key) if files > 1 else rows.coalesce(1)
        (
            dealt.sortWithinPartitions(*spec.key).write.option(f"parquet.bloom.filter.enabled#{spec.key[0]}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{spec.key[0]}", max(1, min(count, spec.file_rows)))
            .option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{self.root}/{path}")
        )
        return {"path": path, "level": level, "rows": count}

    def commit(self, batch: int, rows: dict[str, DataFrame]) -> None:
        """Rows of several tables, visible together; a table's columns are those of its schema."""
        state = {t: list(runs) for t, runs in self.manifest(before=batch).items()}
        for table, added in rows.items():
            rows_of = added.select(*self._read(table, []).columns)
            count = rows_of.count()
            if count:
                state.setdefault(table, []).append(self._write(table, batch, rows_of, 0, count))
        for table, runs in state.items():
            if self.tables[table].merged:
                state[table] = self._merged(table, batch, runs)
        self._publish(batch, state)
        self._clean(batch)

    def _merged(self, table: str, batch: int, runs: list[dict]) -> list[dict]:
        level = 0
        while level <= max((r["level"] for r in runs), default=-1):
            same = [r for r in runs if r["level"] == level]
            if len(same) >= FAN:
                one = self._write(table, batch, self._read(table, same), level + 1, sum(r["rows"] for r in same))
                runs = [r for r in runs if r["level"] != level] + [one]
            level += 1
        return runs


def _any(column: Column, values: list[str]) -> Column:
    """One of the values, as a balanced tree of equalities, which files can be asked one by one."""
    if len(values) == 1:
        return column == values[0]
    half = len(values) // 2
    return _any(column, values[:half]) | _any(column, values[half:])
