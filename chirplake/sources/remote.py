"""A Python data source for catalogs behind an interface of their own, with selections pushed down.

``spark.read.format("remote_catalog").option("fetcher", "package.module:function")``
calls ``function(selection)`` in a worker; ``selection`` maps a column to (operator,
value) pairs that the source need only treat as hints, since Spark filters again.
The function yields dictionaries with the pool's columns. A TypeError from it means
that it takes no selection, and it is then called without. HDF5 and FITS tables
are read this way too, by a function over the library that is installed there.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from chirplake.ship import ship

COLUMNS = (("gps", "double"), ("ifo", "string"), ("label", "string"), ("snr", "double"), ("peak_frequency", "double"), ("central_freq", "double"), ("bandwidth", "double"), ("duration", "double"), ("confidence", "double"), ("gravityspy_id", "string"))


class RemoteCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_catalog"

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in COLUMNS)

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.fetcher = options.get("fetcher", "")
        self.ifos = [x for x in options.get("ifos", "").split(",") if x]
        self.selection: dict[str, list[tuple[str, object]]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - Spark's name
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in"}
        for f in filters:
            if (sign := signs.get(type(f))) and len(f.attribute) == 1:
                self.selection.setdefault(f.attribute[0], []).append((sign, f.value))
            yield f  # the source may ignore the hint

    def partitions(self) -> list[InputPartition]:
        """One partition per detector that is asked for, or one in all."""
        return [InputPartition(i) for i in self.ifos] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.fetcher.partition(":")
        if not function:
            raise ValueError("remote_catalog needs the option fetcher=package.module:function")
        fetch = getattr(importlib.import_module(module), function)
        selection = dict(self.selection)
        if partition.value is not None:
            selection["ifo"] = [*selection.get("ifo", []), ("=", partition.value)]
        try:
            rows = fetch(selection)
        except TypeError:
            rows = fetch()
        for row in rows:
            if partition.value is None or row.get("ifo") == partition.value:
                yield tuple(row.get(n) for n, _ in COLUMNS)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RemoteCatalog)
