"""A catalogue of datasets: Parquet folders with published metadata, and a bounded cache of frames."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections import OrderedDict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from plumbline.sources.files import Folder
from plumbline.sources.loader import DATASET_ID, MOST_BYTES, TooLarge, load

#: Frames remembered, and bytes of files up to which their rows are kept in memory; larger tables are scanned each time.
CACHED, CACHED_BYTES = 4, 256 << 20


class NotFound(KeyError):
    """No dataset of that id."""


class Store:
    """Datasets below ``root``: ``{id}.parquet`` holds the rows, ``{id}.json`` what is known of them.

    ``root`` is a folder that driver and executors share, of any scheme Spark
    reads; the metadata file is published last and by a rename, so a dataset is
    there whole or not at all.
    """

    def __init__(self, spark: SparkSession, root: str, cached: int = CACHED):
        self.spark, self.root, self.cached = spark, Folder(spark, root), cached
        self._frames: OrderedDict[str, DataFrame] = OrderedDict()
        self._lock = threading.Lock()

    def save(self, df: DataFrame, filename: str) -> dict:
        key = uuid.uuid4().hex
        path = self.root / f"{key}.parquet"
        df.write.parquet(path)
        meta = {"dataset_id": key, "filename": filename, "uploaded_at": datetime.now(UTC).isoformat(), "n_rows": self.spark.read.parquet(path).count(), "n_cols": len(df.columns), "columns": [{"name": n, "dtype": t} for n, t in df.dtypes]}
        self.root.publish(f"{key}.json", json.dumps(meta, ensure_ascii=False))
        return meta

    def upload(self, path: str) -> dict:
        """Loads a file of at most 200 MB, wherever Spark can read it, and saves it."""
        folder, name = os.path.split(path)
        there = Folder(self.spark, folder or ".")
        if there.exists(name) and there.size(name) > MOST_BYTES:
            raise TooLarge(f"larger than {MOST_BYTES} bytes")
        return self.save(load(self.spark, path), name)

    def meta(self, key: str) -> dict:
        if not DATASET_ID.fullmatch(key) or not self.root.exists(f"{key}.json"):
            raise NotFound(key)
        return json.loads(self.root.read(f"{key}.json"))

    def list(self) -> list[dict]:
        """All datasets, the newest first."""
        found = [json.loads(self.root.read(n)) for n in self.root.names() if n.endswith(".json") and DATASET_ID.fullmatch(n.removesuffix(".json"))]
        return sorted(found, key=lambda m: (m["uploaded_at"], m["dataset_id"]), reverse=True)

    def frame(self, key: str) -> DataFrame:
        """The rows; those of small tables stay in memory for the few datasets used last."""
        self.meta(key)
        with self._lock:
            if key in self._frames:
                self._frames.move_to_end(key)
            else:
                df = self.spark.read.parquet(self.root / f"{key}.parquet")
                self._frames[key] = df.persist(StorageLevel.MEMORY_AND_DISK) if self.root.size(f"{key}.parquet") <= CACHED_BYTES else df
                while len(self._frames) > self.cached:
                    self._frames.popitem(last=False)[1].unpersist()
            return self._frames[key]

    def profile_text(self, key: str) -> str | None:
        """The published profile of a dataset; None where there is none."""
        return self.root.read(f"{key}.profile") if self.root.exists(f"{key}.profile") else None

    def publish_profile(self, key: str, text: str) -> None:
        self.root.publish(f"{key}.profile", text, replace=True)

    def drop(self, key: str) -> None:
        self.meta(key)
        self.root.delete(f"{key}.json")
        with self._lock:
            if key in self._frames:
                self._frames.pop(key).unpersist()
        for kind in ("parquet", "profile"):
            self.root.delete(f"{key}.{kind}")
