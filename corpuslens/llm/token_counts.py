"""Token totals by source, language and tokenizer version, maintained by deltas.

A batch of changes holds signed rows: an insert adds a document and its tokens, a delete
takes them away, a revised count takes the old one away and adds the new one. A batch is
summed by key before it is written, so it costs as many rows as it has keys, and totals are
sums over batches: documents are never read again.

A commit is idempotent: a batch becomes visible by one rename to a name made of its id, and
an id that is there already changes nothing, whether the first attempt was ours, another
writer's or one whose answer was lost. ``compact`` folds batches into one table that
remembers their ids; readers and writers need not wait for it.

A missing text has no tokens. Missing sources and languages are keys of their own. Repeated
rows count each. Keys whose totals are all zero are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoded
from .staging import delete_path

KEYS = ["source", "lang", "version"]
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, version: str, tokenizer: str, text: str = "text", passed: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """(passed columns, version, n_tokens) of every document; only counts leave the worker."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for row, ids in encoded(batch.column(len(passed)), tokenizer):
                n[row] = len(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], [*passed, "n_tokens"])

    chosen = docs.select(*passed, F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"{c} {chosen.schema[c].dataType.simpleString()}" for c in passed)
    return chosen.mapInArrow(count, f"{schema}, n_tokens long").withColumn("version", F.lit(version))


def _signed(counted: DataFrame, sign: int) -> DataFrame:
    return counted.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))


def inserts(counted: DataFrame) -> DataFrame:
    return _signed(counted, 1)


def deletes(counted: DataFrame) -> DataFrame:
    return _signed(counted, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts that replace others, of the same or another version, source or language."""
    return _signed(old, -1).unionByName(_signed(new, 1))


class TokenRollup:
    """The totals kept in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(folder))

    def _names(self, kind: str) -> list[str]:
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(n for n in found if n.startswith(f"{kind}-"))

    def _publish(self, df: DataFrame, name: str) -> bool:
        """Write under a name of our own, then rename; the first rename wins."""
        own = f"{self.folder}/.writing-{uuid.uuid4().hex}"
        df.write.parquet(own)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration()) if ":" in self.folder else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        never = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(own), self._path(f"{self.folder}/{name}"), never)
        except Exception as error:
            if not self._fs.exists(self._path(f"{self.folder}/{name}")):
                raise error
            delete_path(self.spark, own)
            return False
        return True

    @staticmethod
    def _batch_name(batch_id: str) -> str:
        return "batch-" + quote(batch_id, safe="").replace(".", "%2E").replace("%", "=")

    def _folded(self, state: str | None, names: list[str] | None = None) -> DataFrame:
        """Names of the batches that a state holds, of ``names`` only where given."""
        if state is None:
            return self.spark.createDataFrame([], "batch string")
        held = self.spark.read.schema(f"{_DELTA}, batch string").parquet(f"{self.folder}/{state}").filter("batch IS NOT NULL")
        return (held if names is None else held.filter(F.col("batch").isin(names))).select("batch")

    def _snapshot(self) -> tuple[str | None, list[str], list[str]]:
        """The last state, and the batches that lie beside it: those to add to it, and those
        it holds already.

        Batches are listed first. One that a compaction folds meanwhile is in the state that is
        listed then, so it counts once, as a batch or in the state.
        """
        names = self._names("batch")
        state = (self._names("state") or [None])[-1]
        held = {r["batch"] for r in self._folded(state, names).collect()} if names else set()
        return state, [n for n in names if n not in held], sorted(held)

    def committed(self, batch_id: str) -> bool:
        """Whether a batch counts, compacted or not; only that id is looked up."""
        name = self._batch_name(batch_id)
        # In this order: a batch is in a state before its folder goes.
        if self._fs.exists(self._path(f"{self.folder}/{name}")):
            return True
        return not self._folded((self._names("state") or [None])[-1], [name]).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add the signed rows of a batch; False if that batch was there already."""
        if self.committed(batch_id):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return self._publish(summed, self._batch_name(batch_id))

    def _sums(self, state: str | None, fresh: list[str]) -> DataFrame:
        """Totals of a state and of batches that are not in it."""
        rows = self.spark.createDataFrame([], _DELTA)
        if state is not None:
            table = self.spark.read.schema(f"{_DELTA}, batch string").parquet(f"{self.folder}/{state}")
            rows = rows.unionByName(table.filter("batch IS NULL").drop("batch"))
        if fresh:
            rows = rows.unionByName(self.spark.read.schema(_DELTA).parquet(*[f"{self.folder}/{n}" for n in fresh]))
        return (
            rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            .filter("n_docs != 0 OR n_tokens != 0")
        )

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of the batches that count now.

        The rows may be read later: what they come from stays until the compaction after the
        next one. After that reading them fails; it never gives less."""
        state, fresh, _ = self._snapshot()
        return self._sums(state, fresh)

    def compact(self) -> None:
        """Fold all batches into one table; safe to repeat, to lose half-way and to run beside
        commits, readers and other compactions.

        Exactly the batches of one listing are summed and named. Batches go once the state
        before holds them, and so do the states before that one, so whoever listed a
        folder a compaction ago still finds everything."""
        state, fresh, held = self._snapshot()
        older = [n for n in self._names("state") if state is not None and n < state]
        if fresh:
            ids = self._folded(state).unionByName(self.spark.createDataFrame([(n,) for n in fresh], "batch string"))
            table = self._sums(state, fresh).withColumn("batch", F.lit(None).cast("string")).unionByName(ids, allowMissingColumns=True)
            last = int(state.removeprefix("state-")) if state else 0
            if not self._publish(table, f"state-{last + 1:09d}"):
                return
        for name in [*held, *older]:
            delete_path(self.spark, f"{self.folder}/{name}")
