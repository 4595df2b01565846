"""Driver-side guards: size of requests, confinement of paths, one writer at a time, configuration."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

MAX_ELEMENTS, MAX_DEPTH = 10_000, 64
#: Keys of a project's configuration and their types.
CONFIG = {"root": str, "store": str, "ignore": list, "chunk_lines": int, "extensions": list}


def check_request(value: object) -> None:
    """Raise if a request has too many elements or is nested too deeply; without recursion, so that it can't overflow itself."""
    todo, n = [(value, 1)], 0
    while todo:
        item, depth = todo.pop()
        n += 1
        if n > MAX_ELEMENTS:
            raise ValueError(f"a request has at most {MAX_ELEMENTS} elements")
        if depth > MAX_DEPTH:
            raise ValueError(f"a request is nested at most {MAX_DEPTH} deep")
        inner = item.values() if isinstance(item, dict) else item if isinstance(item, (list, tuple, set)) else ()
        todo += [(x, depth + 1) for x in inner]


def confined(root: str, path: str) -> str | None:
    """``path`` relative to ``root`` with forward slashes if it lies inside after all links are followed, else None."""
    top = Path(root).resolve()
    full = (top / path).resolve()
    return full.relative_to(top).as_posix() if full != top and full.is_relative_to(top) else None


def load_config(path: str) -> dict[str, object]:
    """A JSON configuration; unknown keys and wrong types are errors, a missing file is an empty one."""
    if not Path(path).is_file():
        return {}
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError("a configuration is an object")
    for k, v in found.items():
        if k not in CONFIG:
            raise ValueError(f"unknown setting {k}")
        if not isinstance(v, CONFIG[k]) or isinstance(v, bool):
            raise ValueError(f"{k} must be {CONFIG[k].__name__}")
    return found


@contextmanager
def one_writer(spark: SparkSession, root: str, wait: float = 60.0, dead_after: float = 3600.0) -> Iterator[None]:
    """Hold the index's writer lock, a file that is created only if it isn't there; one older than ``dead_after`` seconds is taken over."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/writer.lock")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    end = time.monotonic() + wait
    while not fs.createNewFile(path):
        if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > dead_after:
            fs.delete(path, False)
        elif time.monotonic() > end:
            raise TimeoutError("another writer holds the index")
        else:
            time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(path, False)
