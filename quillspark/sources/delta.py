"""The change feed as a streaming source of its own: token offsets for each drive, a partition for each drive, expiry as a new generation.

``spark.dataSource.register(DeltaFeed)``, then ``spark.readStream.format("delta_feed").option("client", "module:factory")``.  The client is
what talks to the store's feed; options go to its factory, on the driver and on the executors.  It has

* ``drives()`` – the drives to follow,
* ``head(drive)`` – (generation, token): up to where a pass goes now; the generation grows whenever old tokens have become void,
* ``page(drive, token)`` – (rows, next token, or None at the end); a token of None begins a full walk; raises :class:`Expired`.

An offset is {drive: [generation, token]}.  A batch reads each drive from its old token to its new one; where the generation has changed it
walks the whole drive, and its rows carry the new generation, so the handler can drop what a completed walk hasn't seen.  A token
that expires between planning and reading does the same.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .feed import SCHEMA


class Expired(Exception):
    """The feed no longer knows a token."""


class Walk(InputPartition):
    def __init__(self, drive: str, generation: int, start: str | None, end: str | None):
        self.drive, self.generation, self.start, self.end = drive, generation, start, end


FIELDS = [f.split()[0] for f in SCHEMA.split(", ") if f.split()[0] not in ("drive_id", "expired")]


class DeltaFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delta_feed"

    def schema(self) -> str:
        """The feed's columns, the generation of the walk, and the row's place in its drive's batch."""
        return SCHEMA.replace(", expired boolean", "") + ", generation long, full_walk boolean, arrival long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002
        return DeltaReader(dict(self.options))


class DeltaReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        module, factory = options["client"].split(":")
        self.client = getattr(importlib.import_module(module), factory)(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {d: list(self.client.head(d)) for d in sorted(self.client.drives())}

    def partitions(self, start: dict, end: dict) -> list[Walk]:
        out = []
        for drive, (generation, token) in end.items():
            before = start.get(drive)
            if before is None or before[0] != generation:
                out.append(Walk(drive, generation, None, token))
            elif before[1] != token:
                out.append(Walk(drive, generation, before[1], token))
        return out

    def read(self, partition: Walk) -> Iterator[tuple]:
        walk = self._pages(partition.drive, partition.start, partition.end)
        full = partition.start is None
        generation = partition.generation
        try:
            first = next(walk, None)
        except Expired:
            # Void since the batch was planned: the batch becomes a full walk, of the generation that has come.
            generation = self.client.head(partition.drive)[0]
            walk, full = self._pages(partition.drive, None, None), True
            first = next(walk, None)
        n = 0
        while first is not None:
            for row in first:
                yield (partition.drive, *(row.get(f, {"is_file": True, "is_deleted": False}.get(f)) for f in FIELDS), generation, full, n)
                n += 1
            first = next(walk, None)

    def _pages(self, drive: str, token: str | None, end: str | None) -> Iterator[list[dict]]:
        """Pages behind ``token`` up to the one that ends with ``end``, or all that there are."""
        while token is None or token != end:
            rows, token = self.client.page(drive, token)
            yield rows
            if token is None:
                return

    def commit(self, end: dict) -> None:
        """Nothing to release: tokens live in Spark's checkpoint."""


class FolderClient:
    """A feed that lies in a folder all machines share: <drive>/<generation>/<page number>.json, rows one a line.

    A drive's newest generation is the one that counts; a token is "<generation>:<pages read>".
    """

    def __init__(self, options: dict):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] else (fs.LocalFileSystem(), options["path"])

    def _names(self, path: str) -> list[str]:
        from pyarrow import fs

        return sorted(f.base_name for f in self.fs.get_file_info(fs.FileSelector(path)))

    def drives(self) -> list[str]:
        return self._names(self.root)

    def head(self, drive: str) -> tuple[int, str]:
        generation = max(map(int, self._names(f"{self.root}/{drive}")))
        return generation, f"{generation}:{len(self._names(f'{self.root}/{drive}/{generation}'))}"

    def page(self, drive: str, token: str | None) -> tuple[list[dict], str | None]:
        newest, last = self.head(drive)
        generation, at = (newest, 0) if token is None else map(int, token.split(":"))
        if generation != newest:
            raise Expired(token)
        names = self._names(f"{self.root}/{drive}/{generation}")
        if at >= len(names):
            return [], None
        with self.fs.open_input_stream(f"{self.root}/{drive}/{generation}/{names[at]}") as f:
            rows = [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]
        after = f"{generation}:{at + 1}"
        return rows, after
