"""Tables as immutable Parquet files and a log that says which of them count.

A version is a log entry, created once under its number: the files it adds and those it puts out of use.  Readers take the files of
one version, so they never see half a write, and a writer that dies before its entry leaves nothing behind but files that no one
reads.  A batch of a stream is committed under its run and epoch; the same batch again changes nothing.  Writers don't lock:
who finds the next number taken looks at what the other has done, goes on behind it if it touched other buckets, and else
begins again from the new version, up to five times.

Rows are spread over buckets by a hash of some columns of the key.  A merge rewrites the buckets that its rows fall into and leaves
the files of all others as they are.  The driver holds names of files, never rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indexing
from . import files

BUCKET = "__bucket"
#: A version in so many is also written as a whole, so that readers fold few entries.
WHOLE_EVERY = 20
RETRIES = 5


class Conflict(Exception):
    """Another writer has changed the same buckets."""


@dataclass(frozen=True)
class File:
    path: str
    bucket: int
    bytes: int


@dataclass
class State:
    """A version: its files, the last epoch of each run, and what its writer noted."""

    version: int = -1
    files: dict[str, File] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def after(self, entry: dict) -> State:
        kept = {p: f for p, f in self.files.items() if p not in set(entry["remove"])}
        added = {p: File(p, b, n) for p, b, n in entry["add"]}
        epochs = self.epochs | ({entry["batch"][0]: entry["batch"][1]} if entry["batch"] else {})
        return State(entry["version"], kept | added, epochs, self.notes | entry["notes"])

    def has(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and self.epochs.get(batch[0], -1) >= batch[1]

    def dump(self) -> str:
        return json.dumps({"version": self.version, "files": [[f.path, f.bucket, f.bytes] for f in self.files.values()], "epochs": self.epochs, "notes": self.notes})

    @staticmethod
    def load(text: str) -> State:
        x = json.loads(text)
        return State(x["version"], {p: File(p, b, n) for p, b, n in x["files"]}, x["epochs"], x["notes"])


@dataclass
class LogTable:
    """A table below ``folder``; ``by`` are the columns whose hash is a row's bucket, or one integer column that names it."""

    spark: SparkSession
    folder: str
    schema: str
    buckets: int = 1
    by: tuple[str, ...] = ()
    bucket_column: str | None = None
    #: Order within a file, so that filters on these columns skip most of it.
    order: tuple[str, ...] = ()

    def bucket_of(self) -> Column:
        if self.bucket_column:
            return F.col(self.bucket_column).cast("int")
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int") if self.by else F.lit(0)

    # Reading

    def state(self, version: int | None = None) -> State:
        """The newest version, or the one given."""
        found = files.names(self.spark, f"{self.folder}/log")
        entries = sorted(int(n[:-5]) for n in found if n.endswith(".json") and n[:-5].isdigit())
        wanted = version if version is not None else (entries[-1] if entries else -1)
        whole = [int(n.split(".")[0]) for n in found if n.endswith(".whole") and int(n.split(".")[0]) <= wanted]
        at = State.load(files.read_text(self.spark, f"{self.folder}/log/{max(whole):020d}.whole")) if whole else State()
        for v in entries:
            if at.version < v <= wanted:
                at = at.after(self._entry(v))
        if at.version != wanted:
            raise ValueError(f"version {wanted} is no longer kept")
        return at

    def _entry(self, version: int) -> dict | None:
        text = files.read_text(self.spark, f"{self.folder}/log/{version:020d}.json")
        return None if text is None else json.loads(text)

    def read(self, state: State | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), of some buckets only if given: other files are not opened."""
        return self.rows(self.paths(state, buckets))

    def paths(self, state: State | None = None, buckets: Iterable[int] | None = None) -> list[str]:
        state = self.state() if state is None else state
        wanted = None if buckets is None else set(buckets)
        return sorted(f.path for f in state.files.values() if wanted is None or f.bucket in wanted)

    def rows(self, paths: list[str]) -> DataFrame:
        """The rows of some files, named as in :meth:`paths`."""
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{p}" for p in paths))

    # Writing

    def write_files(self, rows: DataFrame, dealt: bool = False) -> list[File]:
        """New files for rows of the table's columns, a bucket to itself; they count once an entry names them.

        Spark splits a bucket with very many rows over several files.  ``dealt`` rows lie by bucket already and are written where they are.
        """
        place = uuid.uuid4().hex
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self._fields())).withColumn(BUCKET, self.bucket_of())
        rows = rows if dealt else rows.hint("rebalance", F.col(BUCKET))
        rows.sortWithinPartitions(BUCKET, *self.order).write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.folder}/data/{place}")
        out = files.data_files(self.spark, f"{self.folder}/data/{place}")
        return [File(f"{place}/{p}", int(p.split("=")[1].split("/")[0]), n) for p, n, _ in out]

    def commit(self, base: State, add: list[File], gone: Iterable[str] = (), batch: tuple[str, int] | None = None, touched: Iterable[int] | None = (), notes: dict | None = None) -> State:
        """The version that adds and drops these files.  ``touched`` are the buckets whose rows were read for it; None stands for all.

        A batch that is in the log already is not committed again.
        """
        gone, at = list(gone), base
        read = None if touched is None else set(touched)
        while not at.has(batch):
            entry = {"version": at.version + 1, "batch": list(batch) if batch else None, "add": [[f.path, f.bucket, f.bytes] for f in add], "remove": gone, "notes": notes or {}}
            if files.create_once(self.spark, f"{self.folder}/log/{entry['version']:020d}.json", json.dumps(entry)):
                at = at.after(entry)
                if at.version % WHOLE_EVERY == WHOLE_EVERY - 1:
                    files.create_once(self.spark, f"{self.folder}/log/{at.version:020d}.whole", at.dump())
                return at
            other = self._entry(at.version + 1)
            changed = {b for _, b, _ in other["add"]} | {at.files[p].bucket for p in other["remove"]}
            same = batch is not None and other["batch"] == list(batch)
            if not same and (changed if read is None else read & changed):
                raise Conflict(f"version {at.version + 1} changed buckets {sorted(changed)[:10]}")
            at = at.after(other)
        return at

    def update(self, change: Callable[[State], tuple[list[File], Iterable[str], Iterable[int] | None]], batch: tuple[str, int] | None = None, retries: int = RETRIES, notes: dict | None = None) -> State:
        """Commit what ``change`` makes of the newest version: (new files, files out of use, buckets read).

        After a conflict it begins again from the version that won, ``retries`` times at most.
        """
        for turn in range(retries + 1):
            at = self.state()
            if at.has(batch):
                return at
            add, gone, touched = change(at)
            try:
                return self.commit(at, add, gone, batch, touched, notes)
            except Conflict:
                if turn == retries:
                    raise
        return at

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, notes: dict | None = None, dealt: bool = False) -> State:
        at = self.state()
        return at if at.has(batch) else self.commit(at, self.write_files(rows, dealt), batch=batch, notes=notes)

    def overwrite(self, rows: DataFrame, batch: tuple[str, int] | None = None, notes: dict | None = None, dealt: bool = False) -> State:
        """These rows and no others."""
        return self.update(lambda at: (self.write_files(rows, dealt), list(at.files), None), batch, notes=notes)

    def merge(self, rows: DataFrame, key: list[str], batch: tuple[str, int] | None = None, deleted: str | None = None, notes: dict | None = None) -> State:
        """Rows replace those of their key, or take them out where ``deleted`` is true; of several the last to arrive counts (``arrival``).

        Only the buckets of these rows are read and written.
        """
        rest = [f.name for f in self._fields() if f.name not in key]
        arrival = [F.desc("arrival")] if "arrival" in rows.columns else []
        last = lambda fresh: indexing.latest(fresh, key, [*arrival, *(F.desc_nulls_last(c) for c in rest)] or [F.lit(0)])
        return self._rewrite(rows, key, last, batch, deleted, notes)

    def insert(self, rows: DataFrame, key: list[str], batch: tuple[str, int] | None = None) -> State:
        """Rows whose key the table doesn't have yet are appended, the first to arrive of each; the others change nothing.

        Only the keys of these rows' buckets are read, and no file is rewritten.
        """
        stage = f"{self.folder}/stage/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self.bucket_of()).write.option("compression", "zstd").parquet(stage)
        try:
            fresh = self.spark.read.parquet(stage)
            touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
            rest = [F.asc_nulls_last(c) for c in fresh.columns if c not in (*key, BUCKET)]
            first = indexing.latest(fresh, key, rest or [F.lit(0)])

            def change(at: State):
                same = reduce(lambda a, b: a & b, (F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in key))
                new = first.alias("n").join(self.read(at, touched).select(*key).alias("o"), same, "left_anti")
                return (self.write_files(new) if touched else []), [], touched

            return self.update(change, batch)
        finally:
            files.remove(self.spark, stage)

    def added_by(self, batch: tuple[str, int]) -> DataFrame:
        """The rows of the files that a batch's version added, newest versions first looked at; none if it isn't in the log."""
        version = self.state().version
        while version >= 0 and (entry := self._entry(version)) is not None:
            if entry["batch"] == list(batch):
                return self.rows([p for p, _, _ in entry["add"]])
            version -= 1
        return self.rows([])

    def replace(self, rows: DataFrame, by: list[str], batch: tuple[str, int] | None = None, deleted: str | None = None, notes: dict | None = None) -> State:
        """All rows with these values of ``by`` give way to the new ones, of which there may be several a value; a ``deleted`` one brings none."""
        return self._rewrite(rows, by, lambda fresh: fresh, batch, deleted, notes)

    def _fields(self):
        return self.spark.createDataFrame([], self.schema).schema

    def _rewrite(self, rows: DataFrame, key: list[str], pick: Callable[[DataFrame], DataFrame], batch, deleted: str | None, notes: dict | None) -> State:
        if self.bucket_column is None and not set(self.by) <= set(key):
            raise ValueError("the buckets must follow from the key")
        stage = f"{self.folder}/stage/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self.bucket_of()).write.option("compression", "zstd").parquet(stage)  # once, though it is read for the buckets and for the merge
        try:
            fresh = self.spark.read.parquet(stage)
            touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]
            columns = [f.name for f in self._fields()]
            put = pick(fresh)
            put = put if deleted is None else put.filter(~F.coalesce(F.col(deleted), F.lit(False)))

            def change(at: State):
                gone = self.paths(at, touched)
                same = reduce(lambda a, b: a & b, (F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key))
                kept = self.rows(gone).alias("o").join(fresh.select(*key).distinct().alias("n"), same, "left_anti")
                return (self.write_files(kept.select(*columns).unionByName(put.select(*columns))) if touched else []), gone, touched

            return self.update(change, batch, notes=notes)
        finally:
            files.remove(self.spark, stage)

    def delete(self, where: Column, batch: tuple[str, int] | None = None) -> State:
        """Rows for which ``where`` is true go; buckets without any keep their files."""

        def change(at: State):
            hit = [r[0] for r in self.read(at).filter(where).select(self.bucket_of().alias(BUCKET)).distinct().collect()]
            gone = self.paths(at, hit)
            return (self.write_files(self.rows(gone).filter(~F.coalesce(where, F.lit(False)))) if gone else []), gone, None

        return self.update(change, batch)

    # Retention

    def clean(self, keep: int = 10, age_s: float = 3600.0) -> int:
        """Remove files that none of the last ``keep`` versions has, and older entries; files younger than ``age_s`` may be a writer's and stay.

        Returns the number of data files that went.
        """
        newest = self.state()
        first = max(0, newest.version - keep + 1)
        live: set[str] = set()
        for v in range(first, newest.version + 1):
            live |= set(self.state(v).files)
        files.create_once(self.spark, f"{self.folder}/log/{first:020d}.whole", self.state(first).dump()) if newest.version >= 0 else None
        now, n = time.time() * 1000, 0
        for path, _, changed in files.data_files(self.spark, f"{self.folder}/data"):
            if path not in live and now - changed >= age_s * 1000:
                files.remove(self.spark, f"{self.folder}/data/{path}")
                n += 1
        for name in files.names(self.spark, f"{self.folder}/log"):
            if name[:20].isdigit() and int(name[:20]) < first:
                files.remove(self.spark, f"{self.folder}/log/{name}")
        return n
