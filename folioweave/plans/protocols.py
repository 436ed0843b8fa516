"""What outside parts must offer: recognition engines, listeners of a run, optional packages."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.operators.scans import cache_key


@runtime_checkable
class Recogniser(Protocol):
    """An engine that turns page images into words; it is sent to the executors."""

    engine_id: str
    adapter_version: str

    def request_params(self) -> dict[str, Any]: ...

    def recognise(self, image: bytes, pdf_page: int) -> dict[str, Any]: ...

    def to_words(self, answer: dict[str, Any]) -> list[dict[str, Any]]: ...


ENGINES: dict[str, Callable[..., Recogniser]] = {}


def register_engine(name: str, make: Callable[..., Recogniser]) -> None:
    """Makes an engine known by name; it is only made when it is used."""
    ENGINES[name] = make


def engine(name: str, **options: Any) -> Recogniser:
    if name not in ENGINES:
        raise LookupError(f"no engine {name!r}; known: {', '.join(sorted(ENGINES)) or 'none'}")
    return ENGINES[name](**options)


def require(package: str, extra: str) -> None:
    """Raises with the extra to install where an optional package is missing."""
    if importlib.util.find_spec(package) is None:
        raise ImportError(f"{package} is needed; install the extra {extra!r}")


@runtime_checkable
class Listener(Protocol):
    """Is told of events: a name and its values."""

    def on(self, event: str, **values: Any) -> None: ...


class Silent:
    def on(self, event: str, **values: Any) -> None:
        pass


class Recorded:
    """Keeps events; ``rows`` makes a table of them."""

    def __init__(self) -> None:
        self.events: list[tuple[int, str, dict[str, Any]]] = []

    def on(self, event: str, **values: Any) -> None:
        self.events.append((len(self.events) + 1, event, values))

    def rows(self, spark) -> DataFrame:
        import json

        return spark.createDataFrame([(n, e, json.dumps(v, ensure_ascii=False, default=str)) for n, e, v in self.events], "seq int, event string, data string")


class Both:
    """Tells several listeners; one that fails does not keep the others from being told."""

    def __init__(self, *listeners: Listener) -> None:
        self.listeners = listeners

    def on(self, event: str, **values: Any) -> None:
        faults = []
        for one in self.listeners:
            try:
                one.on(event, **values)
            except Exception as e:  # told after all have heard
                faults.append(e)
        if faults:
            raise faults[0]


ANSWER = "book_id string, pdf_page int, cache_key string, answer string, error string, attempts int"


def recognised(images: DataFrame, cached: DataFrame, one: Recogniser, retries: int = 3, wait: float = 2.0) -> DataFrame:
    """(book_id, pdf_page, cache_key, answer, error, attempts) of images (book_id, pdf_page, sha256, image) that no cache holds.

    A page's key is that of its image, the engine, its version and its parameters. A page that fails is tried again after
    2, 4, 8 ... times ``wait`` / 2 seconds, and then is a row with its error; other pages go on.
    """
    import json

    params = json.dumps(one.request_params(), sort_keys=True)
    keyed = images.withColumn("cache_key", cache_key(F.col("sha256").alias("image"), F.lit(one.engine_id).alias("engine"), F.lit(one.adapter_version).alias("version"), F.lit(params).alias("params")))
    todo = keyed.join(cached.select("cache_key").distinct(), "cache_key", "left_anti").select("book_id", "pdf_page", "cache_key", "image")

    def ask(batches: Iterator) -> Iterator:
        import time

        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                answer = error = None
                for attempt in range(1, retries + 2):
                    try:
                        answer, error = json.dumps(one.recognise(bytes(r.image), int(r.pdf_page)), ensure_ascii=False), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if attempt <= retries:
                            time.sleep(wait * 2 ** (attempt - 1))
                out.append((r.book_id, r.pdf_page, r.cache_key, answer, error, attempt))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return todo.mapInPandas(ask, ANSWER)
