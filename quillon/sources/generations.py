"""Published generations of an index: a folder of Parquet tables each, and one pointer that names the current one.

A generation is written aside and published by replacing the pointer; readers open what it names and so see one state. Each
table's footer isn't trusted alone: the generation's meta file names its tables, build and format, and a reader
fails closed on any difference.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FORMAT = 1
KEPT = 3


@dataclass
class Store:
    """Generations under ``root``, on any file system that Spark reaches."""

    spark: SparkSession
    root: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _write(self, name: str, text: str) -> None:
        """Write beside and rename over, so that a reader sees the old or the new text."""
        fs, path = self._fs()
        aside = path(f"{self.root}/.{name.replace('/', '-')}-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        target = path(f"{self.root}/{name}")
        # One atomic step that overwrites: there is no moment without a target, and a crash leaves the old or the new one.
        jvm = self.spark.sparkContext._jvm
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)

    def _read(self, name: str) -> dict | None:
        """A small JSON file; None without one, an empty one if it isn't an object of JSON."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/{name}")):
            return None
        stream = fs.open(path(f"{self.root}/{name}"))
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            found = {}
        finally:
            stream.close()
        return found if isinstance(found, dict) else {}

    def publish(self, tables: dict[str, DataFrame], **facts: object) -> str:
        """Write a generation and make it the current one; its name. Generations that readers hold by :meth:`pin` stay."""
        build = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/gen={build}/{name}")
            self._write(f"gen={build}/{name}/_build.json", json.dumps({"build": build, "format": FORMAT}))  # Spark's readers pass over names with an underscore
        meta = {"build": build, "format": FORMAT, "tables": {k: df.schema.jsonValue() for k, df in tables.items()}, **facts}
        self._write(f"gen={build}/meta.json", json.dumps(meta))
        self._write("current.json", json.dumps({"build": build, "format": FORMAT}))
        self.collect(self.pins())
        return build

    def pin(self, hours: float = 24) -> tuple[str, str]:
        """Hold the current generation for so long, or until :meth:`unpin`: ``(build, pin)``."""
        if (state := self.state()) != "committed":
            raise ValueError(f"the index is {state}")
        build, name = self._read("current.json")["build"], uuid.uuid4().hex
        self._write(f"pins/{name}.json", json.dumps({"build": build, "until": time.time() + 3600 * hours}))
        return build, name

    def unpin(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/pins/{name}.json"), False)

    def pins(self) -> tuple[str, ...]:
        """Builds that readers hold; pins that are over are removed."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/pins")):
            return ()
        held = set()
        for s in fs.listStatus(path(f"{self.root}/pins")):
            name = s.getPath().getName()
            if not name.startswith(".") and name.endswith(".json") and (p := self._read(f"pins/{name}")):
                if p["until"] > time.time():
                    held.add(p["build"])
                else:
                    self.unpin(name.removesuffix(".json"))
        return tuple(sorted(held))

    def state(self) -> str:
        """What lies under the root.

        Without a pointer: empty, unfinished (generations, none of them whole) or recoverable (one is whole, but was never published). With one: committed,
        incomplete (it names what isn't whole), legacy (an older format) or foreign (a newer format, or no pointer of ours).
        """
        pointer = self._read("current.json")
        if pointer is None:
            builds = self.generations()
            return "empty" if not builds else "recoverable" if any(map(self.whole, builds)) else "unfinished"
        form = pointer.get("format")
        if type(form) is not int or form > FORMAT or not isinstance(pointer.get("build"), str):
            return "foreign"
        if form < FORMAT:
            return "legacy"
        return "committed" if self.whole(pointer["build"]) else "incomplete"

    def whole(self, build: str) -> bool:
        """Whether a generation's meta file is there and its own."""
        return (self._read(f"gen={build}/meta.json") or {}).get("build") == build

    def problems(self, build: str, *names: str) -> dict[str, str]:
        """Tables of a generation, all or those named, that don't carry its build and format, each with what is wrong."""
        meta, found = self._read(f"gen={build}/meta.json") or {}, {}
        for name in names or meta.get("tables", {}):
            own = self._read(f"gen={build}/{name}/_build.json")
            if own is None:
                found[name] = "missing"
            elif (own.get("build"), own.get("format")) != (build, meta.get("format")):
                found[name] = "of another build"
        return found

    def recover(self) -> str | None:
        """Publish the newest generation that is whole and without problems, where the pointer is missing or names nothing whole; its name."""
        if self.state() not in ("recoverable", "incomplete"):
            return None
        for build in reversed(self.generations()):
            if self.whole(build) and not self.problems(build):
                self._write("current.json", json.dumps({"build": build, "format": FORMAT}))
                return build
        return None

    def meta(self) -> dict | None:
        """What the current generation says of itself; None unless it is whole."""
        return self._read(f"gen={self._read('current.json')['build']}/meta.json") if self.state() == "committed" else None

    def open(self, *names: str) -> dict[str, DataFrame]:
        """The current generation's tables, all or those named."""
        if (state := self.state()) != "committed":
            raise ValueError(f"the index is {state}")
        build = self._read("current.json")["build"]
        meta = self._read(f"gen={build}/meta.json")
        if missing := [n for n in names if n not in meta["tables"]]:
            raise ValueError(f"the generation has no {', '.join(missing)}")
        if wrong := self.problems(build, *(names or meta["tables"])):
            raise ValueError(f"the generation's tables aren't its own: {wrong}")
        from pyspark.sql.types import StructType

        return {n: self.spark.read.schema(StructType.fromJson(meta["tables"][n])).parquet(f"{self.root}/gen={build}/{n}") for n in names or meta["tables"]}

    def generations(self) -> list[str]:
        """Builds, oldest first."""
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(s.getPath().getName()[4:] for s in fs.listStatus(path(self.root)) if s.getPath().getName().startswith("gen="))

    def collect(self, pinned: tuple[str, ...] = ()) -> list[str]:
        """Delete all but the newest generations, the current one and pinned ones; what went."""
        fs, path = self._fs()
        current = (self._read("current.json") or {}).get("build")
        gone = [b for b in self.generations()[:-KEPT] if b != current and b not in pinned]
        for b in gone:
            fs.delete(path(f"{self.root}/gen={b}"), True)
        return gone
