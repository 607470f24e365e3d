"""Running statements: the dialect, parameters, events, timeouts."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import writes
from tidemark.engine.catalog import VIEWS, Catalog
from tidemark.functions import pg
from tidemark.operators.changes import settled
from tidemark.plans import dialect
from tidemark.sources import sinks

#: The session's views belong to one statement at a time.
_views = threading.RLock()
VERSION_CALL = re.compile(r"(?i)(?<![\w.'])version\s*\(\s*\)")


class Engine:
    """SQL over the tables of a folder.

    A statement is a text, [text, [values]], [text, {names}] or {"query", "params", "named_params"}.
    """

    def __init__(self, spark: SparkSession, folder: str, timeout: float | None = 60.0):
        self.spark, self.catalog, self.timeout = spark, Catalog(spark, folder), timeout
        self._written: dict[str, DataFrame] = {}  # tables that statements have changed

    def table(self, name: str) -> DataFrame:
        """A table as this engine sees it."""
        return self._written[name] if name in self._written else self.catalog.table(name)

    @staticmethod
    def parts(statement: str | list | dict) -> tuple[str, Any]:
        if isinstance(statement, str):
            return statement, None
        if isinstance(statement, dict):
            return statement["query"], statement.get("named_params") or statement.get("params")
        return statement[0], statement[1] if len(statement) > 1 else None

    def query(self, statement: str | list | dict) -> DataFrame:
        """The result of one statement that reads; nothing runs before the frame is used."""
        sql, values = self.parts(statement)
        dialect.check_read_only(sql)
        return self.read(sql, values)

    def read(self, sql: str, values: Any = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """Resolve a statement against this engine's tables (or those given in their place), whatever views the session has.

        Names are resolved as soon as the frame is made, so views may serve another engine right after.
        """
        words = {t.strip('"`').lower() for t in dialect.tokens(sql)}
        known = [n for n in self.catalog.keys if n in words]
        frames = {n: tables[n] if tables and n in tables else self.table(n) for n in known}
        kinds: dict[str, str] = {}
        for df in frames.values():
            for f in df.schema:
                kind = f.dataType.simpleString()
                kinds[f.name.lower()] = kind if kinds.get(f.name.lower(), kind) == kind else "several"
        text = dialect.rewrite(sql, kinds=kinds)
        text = VERSION_CALL.sub("tide_version()", text) if "version" in words else text
        args = dialect.parameters(dialect.typed(values, sql, kinds), sql)
        used = {t.lower() for t in dialect.tokens(text)}
        with _views:
            for name, df in frames.items():
                df.createOrReplaceTempView(name)
            for name in VIEWS:
                if name in used:
                    self.catalog.system_view(name).createOrReplaceTempView(name)
            if called := {n for n in used if n.startswith("tide_")}:
                lookups = self.catalog.definitions() if called & {"tide_constraintdef", "tide_indexdef", "tide_functiondef", "tide_function_arguments"} else None
                pg.register(self.spark, called, lookups)
            return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def collect(self, statement: str | list | dict) -> list[Row]:
        """The rows of a statement that reads; TimeoutError once the engine's timeout is over."""
        with self.limited():
            return self.query(statement).collect()

    def execute(self, statements: list[str | list | dict]) -> list[dict[str, Any]]:
        """Statements that write, all or none: of each the rows affected, the time taken and, with RETURNING, the rows.

        A statement sees what those before it have done. The changed tables take effect together, at the end, for this
        engine only; their files stay as they are. An error leaves every table as it was.
        """
        staged: dict[str, DataFrame] = {}
        out = []
        with self.limited():
            for statement in statements:
                began = time.monotonic()
                sql, values = self.parts(statement)
                if len(dialect.statements(sql)) != 1:
                    raise ValueError("one statement at a time")
                write = writes.parse(dialect.statements(sql)[0])
                if write.table not in self.catalog.keys:
                    raise LookupError(f"no table {write.table}")
                stored = staged[write.table] if write.table in staged else self.table(write.table)
                read = lambda text, bound, tables: self.read(text, bound, staged | tables)
                after, touched = writes.apply(write, stored, self.catalog.keys[write.table], {}, read, values)
                touched = settled(touched)
                done = {"rows_affected": touched.count(), "time": time.monotonic() - began}
                if write.returning:
                    done["rows"] = self.read(f"SELECT {write.returning} FROM {write.table}", values, staged | {write.table: touched}).collect()
                staged[write.table] = settled(after)
                out.append(done)
        self._written |= staged
        return out

    def explain(self, statement: str | list | dict) -> str:
        """The physical plan as text."""
        return self.spark._jvm.PythonSQLUtils.explainString(self.query(statement)._jdf.queryExecution(), "formatted")

    def events(self, statement: str | list | dict) -> Iterator[str]:
        """One JSON text a line: columns, a row each, then the end with the time taken. Rows come one partition at a time."""
        began = time.monotonic()
        df = self.query(statement)
        yield sinks.event(columns=df.columns)
        with self.limited():
            for n, row in enumerate(df.toLocalIterator(), 1):
                yield sinks.event(row=[n, [sinks.plain(x) for x in row]])
        yield sinks.event(eoq={"time": time.monotonic() - began})

    def limited(self) -> Limit:
        """Cancels the jobs of the block once the timeout is over; 0 or None: never."""
        return Limit(self.spark, self.timeout)

    def table_stats(self, names: list[str]) -> tuple[DataFrame, list[str]]:
        """Row counts by table in one job, and the names that aren't tables."""
        known = [n for n in names if n in self.catalog.keys]
        counts = None
        for n in known:
            one = self.table(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
            counts = one if counts is None else counts.unionAll(one)
        if counts is None:
            counts = self.spark.createDataFrame([], "table_name string, n_rows long")
        return counts, [n for n in names if n not in known]


class Limit:
    """Cancels the jobs that its block starts once the time is over, which then ends with a TimeoutError."""

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.spark, self.seconds, self.tag, self.over = spark, seconds, f"query-{uuid.uuid4().hex}", False
        self.timer = threading.Timer(seconds, self._stop) if seconds else None

    def _stop(self) -> None:
        self.over = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __enter__(self) -> Limit:
        self.spark.sparkContext.addJobTag(self.tag)
        if self.timer:
            self.timer.daemon = True
            self.timer.start()
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: object) -> None:
        if self.timer:
            self.timer.cancel()
        self.spark.sparkContext.removeJobTag(self.tag)
        if self.over and error is not None:
            raise TimeoutError(f"stopped after {self.seconds} s") from error
