"""Token counts kept as additive rollups under signed deltas, with idempotent batch commits.

A change is an insert, a delete or a revision of one document's count.  A batch
of changes is summed by source, language and tokenizer version and written as a
few signed rows; the batch counts once its commit file names the attempt whose
rows are to be read.  That file is written as a draft and renamed into place
without overwriting, so it is there whole or not at all.  Batches can be sent
again, raced or lost half-way.

Totals are a base and the deltas of the batches committed since.  After
``COMPACT`` of those a new base is summed up and published by a manifest that
lists the batches in it, again by a rename; who reads meanwhile, or compacts at
the same time, sees one base or the other, and each batch once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.files import Folder

from .packing import Encoder

KEYS = ["source", "lang", "tokenizer"]
#: Batches beside the base before a new base is summed up.
COMPACT = 64
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _counts(json_path: str, ranks_path: str | None, pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(json_path, ranks_path, pattern)
        for batch in batches:
            n = [len(encode(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lang"), batch.column("before"), pa.array(n, pa.int64())], ["source", "lang", "before", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """source, lang, before, n_tokens per row; ``before`` passes through.

    A null or empty text has 0 tokens; texts of any length are encoded whole.  Other columns are not read.
    """
    return docs.select("source", "lang", "before", "text").mapInArrow(_counts(json_path, ranks_path, pattern), "source string, lang string, before long, n_tokens long")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes`` (source, lang, tokenizer, op, n_tokens, before).

    insert: +1 document, +n_tokens; delete: -1, -n_tokens; revise: -before
    +n_tokens and no document.  Null counts are 0; null keys are keys of their
    own; another op fails the batch.  Sums are taken before the shuffle, so a
    hot source costs a row per task.
    """
    n, before = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("before", F.lit(0)).cast("long")
    wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("long")
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(wrong)
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - before).otherwise(wrong)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Totals below ``path``, a folder that driver and executors share.

    ``deltas/batch/attempt`` and ``bases/attempt`` are tables; ``commits/batch``
    has the attempt of a batch, ``manifests/number`` the attempt of a base and
    the ids of its batches.
    """

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT):
        self.spark, self.files, self.compact_after = spark, Folder(spark, path), compact

    def _text(self, name: str) -> str:
        text = self.files.read(name)
        if not text:
            raise OSError(f"{self.files / name} is empty: its batch is in doubt")
        return text

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        return self.files.names("commits")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False where a batch of that id counts already."""
        if not batch or "/" in batch or "\n" in batch or batch.startswith((".", "_")):
            raise ValueError(f"no batch id: {batch!r}")
        if self.files.exists(f"commits/{batch}"):
            self._text(f"commits/{batch}")
            return False
        attempt = uuid.uuid4().hex
        deltas(changes).write.parquet(self.files / f"deltas/{batch}/{attempt}")
        if not self.files.publish(f"commits/{batch}", attempt):
            return False
        if len(self._state()[1]) > self.compact_after:
            self.compact()
        return True

    def _state(self) -> tuple[str | None, list[str], set[str], int]:
        """Folder of the base, batches committed since, batches in the base, and the number of its manifest."""
        numbers = [int(n) for n in self.files.names("manifests") if n.isdigit()]
        if not numbers:
            return None, self.committed(), set(), 0
        base, *inside = self._text(f"manifests/{max(numbers):09d}").split("\n")
        inside = set(inside)
        return self.files / f"bases/{base}", [b for b in self.committed() if b not in inside], inside, max(numbers)

    def _sums(self, base: str | None, batches: list[str]) -> DataFrame:
        paths = [*([base] if base else []), *(self.files / f"deltas/{b}/{self._text(f'commits/{b}')}" for b in batches)]
        rows = self.spark.read.schema(_TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], _TOTALS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> bool:
        """Sums what is committed into a new base; False where another writer published one meanwhile."""
        base, batches, inside, number = self._state()
        if not batches:
            return False
        attempt = uuid.uuid4().hex
        self._sums(base, batches).write.parquet(self.files / f"bases/{attempt}")
        return self.files.publish(f"manifests/{number + 1:09d}", "\n".join([attempt, *sorted(inside), *batches]))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; keys whose sums are all 0 are gone."""
        base, batches, _, _ = self._state()
        return self._sums(base, batches).filter("n_docs <> 0 OR n_tokens <> 0")
