"""A relational table as a stream, polled by key.

The reference asks its database again and again for the oldest rows that are
not yet synced.  Here a Python data source does the asking: a stream's offset is
the last (updated_at, id) that was read, a poll takes the rows after it up to
the newest one, in slices of the time range that executors read side by side,
and the offset in the stream's checkpoint says where to go on.  A row that
changes gets a newer time and is read again, so every version that is still
there at a poll is seen once; NULL times cannot be polled for and are read by the
batch scan (S1).

Two rows of one time are told apart by their ids, so a poll between two of them
loses none.  Rows that are committed late with a time before the offset would
be missed: ``lag`` seconds keep that far behind the newest time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FETCH_ROWS = 4_096


@dataclass(frozen=True)
class PolledTable:
    """A table behind a DB-API connection; ``connect`` is called once on the driver for each poll and once in each slice.

    ``mark`` is the driver's parameter style ('?' or '%s'); the time column must compare as the database stores it.
    """

    connect: Callable[[], Any]
    table: str
    id_field: str
    updated_at_field: str
    columns: tuple[str, ...]
    where: str = "1 = 1"
    mark: str = "?"

    def _rows(self, sql: str, values) -> list[tuple]:
        con = self.connect()
        try:
            cur = con.cursor()
            cur.execute(sql, values)
            return cur.fetchall()
        finally:
            con.close()

    def last(self, before: str | None = None) -> tuple | None:
        """The newest (time, id) up to the time ``before``; None: no row."""
        t, i = self.updated_at_field, self.id_field
        limit, values = (f" AND {t} <= {self.mark}", (before,)) if before is not None else ("", ())
        rows = self._rows(f"SELECT {t}, {i} FROM {self.table} WHERE ({self.where}) AND {t} IS NOT NULL{limit} ORDER BY {t} DESC, {i} DESC LIMIT 1",
                          values)
        return tuple(rows[0]) if rows else None

    def cuts(self, start: tuple | None, end: tuple, slices: int) -> list[tuple]:
        """Keys that cut the rows after ``start`` up to ``end`` into about ``slices`` equal parts."""
        where, values = self._between(start, end)
        t, i = self.updated_at_field, self.id_field
        n = self._rows(f"SELECT count(*) FROM {self.table} WHERE {where}", values)[0][0]
        step = max(1, -(-n // slices))
        out = []
        for at in range(step, n, step):
            out += self._rows(f"SELECT {t}, {i} FROM {self.table} WHERE {where} ORDER BY {t}, {i} LIMIT 1 OFFSET {at - 1}", values)
        return [tuple(c) for c in out]

    def _between(self, start: tuple | None, end: tuple) -> tuple[str, tuple]:
        t, i, m = self.updated_at_field, self.id_field, self.mark
        sql, values = f"({self.where}) AND ({t} < {m} OR ({t} = {m} AND {i} <= {m}))", (end[0], end[0], end[1])
        if start is not None:
            sql, values = f"{sql} AND ({t} > {m} OR ({t} = {m} AND {i} > {m}))", (*values, start[0], start[0], start[1])
        return sql, values

    def read(self, start: tuple | None, end: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        where, values = self._between(start, end)
        con = self.connect()
        try:
            cur = con.cursor()
            cur.execute(f"SELECT {', '.join(self.columns)} FROM {self.table} WHERE {where}", values)
            while rows := cur.fetchmany(FETCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            con.close()


@dataclass
class Slice(InputPartition):
    start: tuple | None
    end: tuple


def polled_stream(spark: SparkSession, table: PolledTable, schema: T.StructType, slices: int = 8,
                  horizon: Callable[[], str] | None = None) -> DataFrame:
    """A streaming frame of ``table``'s rows, new and changed ones at each poll.

    ``schema`` gives the types of ``table.columns`` in order; ``horizon`` (called on the driver at each poll) is the newest
    time that may be read, for databases whose rows can be committed late.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"at": None}

        def latestOffset(self) -> dict:
            last = table.last(horizon() if horizon else None)
            return {"at": list(last) if last else None}

        def partitions(self, start: dict, end: dict):
            if end["at"] is None or start["at"] == end["at"]:
                return []
            a, z = (tuple(o["at"]) if o["at"] else None for o in (start, end))
            ends = [*table.cuts(a, z, slices), z]
            return [Slice(x, y) for x, y in zip([a, *ends], ends)]

        def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
            return table.read(partition.start, partition.end, arrow)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "polled_" + "".join(c if c.isalnum() else "_" for c in table.table)

        def schema(self):
            return schema

        def streamReader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format(Source.name()).load()
