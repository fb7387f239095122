"""Models behind a common lifecycle: loaded once for each task, run over Arrow batches, released at its end.

A provider maps a batch of texts to results; calls that fail become failed rows, never failed jobs. Filters come before
the call, so Catalyst keeps them out of Python. The models that the flow was made for need hardware or a network; here
are the interface, a deterministic local provider, and stubs that always fail.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNLOADED, LOADING, READY, RUNNING, ERROR, RELEASED = "unloaded", "loading", "ready", "running", "error", "released"
RESULT = "success boolean, data string, confidence double, provider_id string, elapsed_ms double, error string, skipped boolean"


@dataclass
class Result:
    success: bool
    data: str | None = None
    confidence: float = 0.0
    provider_id: str = ""
    elapsed_ms: float = 0.0
    error: str | None = None

    @property
    def skipped(self) -> bool:
        return self.success and self.data is None

    @staticmethod
    def ok(data: str, confidence: float = 1.0) -> Result:
        return Result(True, data, confidence)

    @staticmethod
    def fail(error: str) -> Result:
        return Result(False, error=error)

    @staticmethod
    def skip() -> Result:
        return Result(True)


@dataclass
class Provider:
    """load() makes the model, call(model, text) a Result or a text; retries is the number of further attempts."""

    provider_id: str
    load: Callable[[], object] = lambda: None
    call: Callable[[object, str], Result | str] = lambda model, text: text
    release: Callable[[object], None] = lambda model: None
    enabled: bool = True
    retries: int = 0
    status: str = UNLOADED
    model: object = field(default=None, repr=False)

    def start(self) -> bool:
        if self.status in (READY, RUNNING):
            return True
        self.status = LOADING
        try:
            self.model, self.status = self.load(), READY
        except Exception:  # noqa: BLE001  the caller sees the status
            self.status = ERROR
        return self.status == READY

    def stop(self) -> None:
        if self.status in (READY, RUNNING):
            self.release(self.model)
        self.model, self.status = None, RELEASED

    def should_run(self) -> bool:
        return self.enabled and self.status == READY

    def run(self, text: str) -> Result:
        """Timed; an exception is a failed result after all attempts."""
        if not self.should_run():
            return Result(False, provider_id=self.provider_id, error=f"{self.provider_id} is {self.status if self.enabled else 'disabled'}")
        began, self.status = time.perf_counter(), RUNNING
        for _ in range(self.retries + 1):
            try:
                got = self.call(self.model, text)
                result = got if isinstance(got, Result) else Result.ok(got)
            except Exception as e:  # noqa: BLE001
                result = Result.fail(f"{type(e).__name__}: {e}")
            if result.success:
                break
        self.status = READY
        result.provider_id, result.elapsed_ms = self.provider_id, (time.perf_counter() - began) * 1000
        return result


class Registry:
    """Factories by id; a pool keeps at most one heavy provider loaded besides those that are kept warm."""

    def __init__(self):
        self.factories: dict[str, Callable[[], Provider]] = {}

    def register(self, name: str, factory: Callable[[], Provider]) -> None:
        self.factories[name] = factory

    def get(self, name: str) -> Provider:
        if name not in self.factories:
            raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(self.factories))}")
        return self.factories[name]()


class Pool:
    def __init__(self, registry: Registry, warm: tuple[str, ...] = ()):
        self.registry, self.warm, self.loaded = registry, warm, {}

    def acquire(self, *names: str) -> Provider | None:
        """The first that can be loaded; all others that aren't kept warm are released first."""
        for name in names:
            for other in [n for n in self.loaded if n != name and n not in self.warm]:
                self.loaded.pop(other).stop()
            provider = self.loaded.get(name) or self.registry.get(name)
            if provider.enabled and provider.start():
                self.loaded[name] = provider
                return provider
        return None


def identity() -> Provider:
    """A local stand-in for a translator: deterministic, and dependent on its row only."""
    return Provider("local", call=lambda _, text: Result.ok(text.upper(), 0.85) if text.strip() else Result.skip())


def stub(name: str) -> Callable[[], Provider]:
    def factory() -> Provider:
        return Provider(name, call=lambda _, text: Result.fail(f"{name} is not available offline"), enabled=False)

    return factory


REGISTRY = Registry()
REGISTRY.register("local", identity)
for _name in ("chat", "remote", "vision", "detector", "recogniser"):
    REGISTRY.register(_name, stub(_name))


def apply(frame: DataFrame, text: str, names: list[str], where: Column | None = None, registry: Registry = REGISTRY) -> DataFrame:
    """frame with a struct column `result`: the first of the named providers that can be loaded runs on rows that
    satisfy `where`; the others are skipped. Null texts are skipped too."""
    keys = [c for c in frame.columns if c != "result"]
    chosen = (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)) & F.col(text).isNotNull()
    schema = frame.select(*keys).schema.simpleString()[7:-1] + f",result:struct<{','.join(x.strip().replace(' ', ':', 1) for x in RESULT.split(','))}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = Pool(registry).acquire(*names)
        try:
            for batch in batches:
                rows = []
                for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                    r = provider.run(t) if provider else Result.fail("no provider can be loaded")
                    rows.append({"success": r.success, "data": r.data, "confidence": r.confidence, "provider_id": r.provider_id, "elapsed_ms": r.elapsed_ms, "error": r.error, "skipped": r.skipped})
                kind = pa.struct([("success", pa.bool_()), ("data", pa.string()), ("confidence", pa.float64()), ("provider_id", pa.string()), ("elapsed_ms", pa.float64()), ("error", pa.string()), ("skipped", pa.bool_())])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "result"])
        finally:
            if provider:
                provider.stop()

    done = frame.where(chosen).select(*keys).mapInArrow(run, schema)
    skipped = F.struct(F.lit(True).alias("success"), F.lit(None).cast("string").alias("data"), F.lit(0.0).cast("double").alias("confidence"), F.lit("").alias("provider_id"), F.lit(0.0).cast("double").alias("elapsed_ms"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("skipped"))
    return done.unionByName(frame.where(~chosen).select(*keys).withColumn("result", skipped))
