"""The engine: datasets, profiles, recommendations, charts and probes behind one object."""

from __future__ import annotations

import threading
from collections import OrderedDict, defaultdict

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import typing
from plumbline.operators.probes import Probes
from plumbline.operators.profiler import profile_dataset
from plumbline.operators.render import plain, render
from plumbline.operators.sampling import PROFILE_ROWS, exact_sample
from plumbline.plans.confidence import excluded
from plumbline.plans.model import Profile, Spec
from plumbline.plans.recommend import recommend
from plumbline.plans.roles import role_of
from plumbline.sources.store import Store

PREVIEW = (1, 50, 1000)
#: Samples kept in memory.
SAMPLES = 4


class Engine:
    """Everything of one catalogue; safe for several threads, and each profile is computed once."""

    def __init__(self, spark: SparkSession, root: str, threshold: int = PROFILE_ROWS):
        self.spark, self.threshold = spark, threshold
        self.store = Store(spark, root)
        self._profiles: dict[str, Profile] = {}
        self._probes: dict[str, Probes] = {}
        self._samples: OrderedDict[str, DataFrame] = OrderedDict()
        self._locks: dict[str, threading.Lock] = defaultdict(threading.Lock)
        self._guard = threading.Lock()

    def load(self, path: str) -> dict:
        return self.store.upload(path)

    def save(self, df: DataFrame, name: str = "frame") -> dict:
        return self.store.save(df, name)

    def list(self) -> list[dict]:
        return self.store.list()

    def preview(self, key: str, n: int = PREVIEW[1]) -> list[dict]:
        """The first rows in order of their columns, as JSON-safe records; ``n`` is held between 1 and 1000."""
        n = max(PREVIEW[0], min(PREVIEW[2], n))
        df = self.store.frame(key)
        return [{k: plain(v) for k, v in r.asDict().items()} for r in df.orderBy(*(c for c, t in df.dtypes if not t.startswith("map"))).limit(n).collect()]

    def _lock(self, key: str) -> threading.Lock:
        with self._guard:
            return self._locks[key]

    def profile(self, key: str) -> Profile:
        """From memory, else from its file where that is of this version, else computed and published."""
        if key in self._profiles:
            return self._profiles[key]
        with self._lock(key):
            if key not in self._profiles:
                try:
                    found = Profile.from_json(self.store.profile_text(key) or "")
                except ValueError:
                    found = profile_dataset(self.store.frame(key), key, self.threshold, self._sample(key))
                    self.store.publish_profile(key, found.to_json())
                self._profiles[key] = found
            return self._profiles[key]

    def roles(self, key: str) -> dict:
        return {c.name: role_of(c) for c in self.profile(key).columns}

    def casted(self, key: str) -> DataFrame:
        """The full table with the profile's casts replayed."""
        return typing.apply_casts(self.store.frame(key), {c.name: c.cast for c in self.profile(key).columns})

    def recommend(self, key: str) -> dict:
        profile = self.profile(key)
        return {"recommendations": recommend(profile), "warnings": excluded(profile)}

    def render(self, key: str, spec: Spec) -> dict:
        return render(self.casted(key), spec, self.profile(key))

    def _sample(self, key: str) -> DataFrame:
        """The bounded sample that profile and probes share, kept for the few datasets used last."""
        with self._guard:
            if key not in self._samples:
                df, n = self.store.frame(key), self.store.meta(key)["n_rows"]
                self._samples[key] = (exact_sample(df, self.threshold, total=n) if n > self.threshold else df).persist()
            self._samples.move_to_end(key)
            while len(self._samples) > SAMPLES:
                old, rows = self._samples.popitem(last=False)
                self._probes.pop(old, None)
                rows.unpersist()
            return self._samples[key]

    def probes(self, key: str) -> Probes:
        """What runs probes on a dataset's sample and remembers their results."""
        profile = self.profile(key)
        with self._lock(key):
            sample = self._sample(key)
            if key not in self._probes:
                self._probes[key] = Probes(typing.apply_casts(sample, {c.name: c.cast for c in profile.columns}), profile)
            return self._probes[key]

    def probe(self, key: str, requests: list[dict]) -> list:
        return self.probes(key).run(requests)

    def drop(self, key: str) -> None:
        """Deletes a dataset and what is kept of it."""
        self.store.drop(key)
        with self._guard:
            self._profiles.pop(key, None)
            self._probes.pop(key, None)
            if key in self._samples:
                self._samples.pop(key).unpersist()
