"""The library's surface: a project with an index, and the questions that can be asked of it.

Every question gives a DataFrame; only :meth:`Project.map_markdown` and the command line render text.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths, scores, text
from quillon.operators import analyzers, chunking, composed, detail, graph, health, manifest, notes, patterns, preflight, review, search, vectors
from quillon.sources import files as sources
from quillon.sources import guards
from quillon.sources.generations import Store
from quillon.sources.shared import keeper


@dataclass
class Project:
    """A tree of files under ``root`` and its index under ``store``."""

    spark: SparkSession
    root: str
    store: str
    ignore: list[str] = field(default_factory=list)
    provider: vectors.EmbeddingProvider | None = None
    chunk_lines: int = 50

    @property
    def index(self) -> Store:
        return Store(self.spark, self.store)

    # ------------------------------------------------------------------ building

    def preview(self) -> DataFrame:
        """What an index would hold and what it would skip, by reason."""
        return sources.preview(sources.scan(self.spark, self.root, self.ignore or None))

    def _tables(self, files: DataFrame) -> dict[str, DataFrame]:
        files = files.select("path", "text")
        chunks = chunking.line_chunks(files, self.chunk_lines, key="path")
        chunks = chunks.withColumns({"language": paths.language(F.col("path")), "layer": paths.layer(F.col("path")), "complexity": text.complexity(F.col("content")), "chunk_id": chunking.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.lit(None).cast("string"))})
        if self.provider is not None:
            chunks = vectors.embedded(chunks, self.provider)
        found = analyzers.imports(files).select("path", "line", "source", F.explode_outer("names").alias("symbol"))
        again = analyzers.reexports(files).select("path", F.lit(None).cast("int").alias("line"), "source", F.lit("*").alias("symbol"))
        proofs = found.union(again)
        known = analyzers.resolved(proofs.select("path", "source"), files)
        edges = proofs.join(known.where("outcome = 'resolved'"), ["path", "source"]).select(F.col("path").alias("src"), F.col("target").alias("dst"), "line", F.coalesce("symbol", F.lit("*")).alias("symbol"))
        python = analyzers.python_symbols(files.where(paths.language(F.col("path")) == "python"))
        other = analyzers.lexical_symbols(files.where(paths.language(F.col("path")) != "python"))
        symbols = python.union(other.select("path", "kind", "name", F.col("line").alias("start"), F.col("line").alias("end"), F.lit(None).cast("string").alias("parent")))
        return {"files": files, "manifest": manifest.manifest(files), "chunks": chunks, "symbols": symbols, "edges": graph.merged_edges(edges), "packages": known.where("outcome = 'external'").select("path", "source"), "unresolved": known.where("outcome in ('not-found', 'outside-root')"), "facts": analyzers.framework_facts(files), "dependencies": sources.packages(sources.package_files(self.spark, self.root))}

    @property
    def _embedding(self) -> str:
        return f"{type(self.provider).__name__}:{self.provider.dimensions}" if self.provider else "none"

    def _publish(self, tables: dict[str, DataFrame]) -> str:
        with guards.one_writer(self.spark, self.store):
            return self.index.publish(tables, root=self.root, embedding=self._embedding, chunk_lines=self.chunk_lines, built=dt.datetime.now(dt.timezone.utc).isoformat())

    def build(self) -> str:
        """Index all eligible files as a new generation."""
        kept, _ = sources.capped(sources.scan(self.spark, self.root, self.ignore or None))
        return self._publish(self._tables(kept))

    def refresh(self) -> str | None:
        """A new generation if any file changed; only changed files are cut and embedded anew.

        An index that isn't whole, or was made with another provider or chunk size, is built from nothing.
        """
        meta = self.index.meta()
        if meta is None or (meta.get("embedding"), meta.get("chunk_lines")) != (self._embedding, self.chunk_lines):
            return self.build()
        kept, _ = sources.capped(sources.scan(self.spark, self.root, self.ignore or None))
        old = self.index.open()
        changes = manifest.diff(old["manifest"], manifest.manifest(kept)).where("status <> 'unchanged'")
        if changes.isEmpty():
            return None
        touched = kept.join(changes.where("status in ('added', 'changed')").select("path"), "path", "left_semi")
        new = self._tables(kept)
        new["chunks"] = manifest.rebuilt(old["chunks"], changes, self._tables(touched)["chunks"].select(*old["chunks"].columns))
        return self._publish(new)

    def heal(self) -> str:
        """Mend an index that can't be opened, and say how: nothing was wrong, recovered (an earlier whole generation is current again), rebuilt, or refused, as it isn't ours."""
        state = self.index.state()
        if state == "foreign":
            return "refused"
        if state == "committed":
            meta = self.index.meta()
            if not self.index.problems(meta["build"]):
                return "nothing"
        elif self.index.recover() is not None:
            return "recovered"
        self.build()
        return "rebuilt"

    def status(self) -> dict[str, object]:
        """The index's state and its counts."""
        state = self.index.state()
        return {"state": state} if state != "committed" else {"state": state} | {k: df.count() for k, df in self.index.open().items()}

    # ------------------------------------------------------------------ questions

    def _searchable(self, filters: dict[str, str] | None = None) -> DataFrame:
        """The index's chunks as :mod:`quillon.operators.composed` takes them."""
        held = self.index.open("chunks", "symbols", "edges")
        chunks = search.filtered(held["chunks"], filters or {}).withColumnRenamed("chunk_id", "id")
        symbols = held["symbols"].select(F.col("path").alias("in"), F.col("name").alias("symbol"), F.col("kind").alias("symbol_kind"), "start")
        own = chunks.select("id", "path", "start_line", "end_line").join(symbols, (F.col("in") == F.col("path")) & F.col("start").between(F.col("start_line"), F.col("end_line")))
        own = own.groupBy("id").agg(F.collect_set("symbol").alias("names"), F.min_by("symbol_kind", "start").alias("kind"), F.min_by("symbol", "start").alias("name"))
        central = graph.centrality(held["edges"]).select(F.col("node").alias("path"), "centrality")
        rows = chunks.join(own, "id", "left").join(central, "path", "left")
        none = F.array().cast("array<string>")
        return rows.withColumns({"names": F.coalesce("names", none), "tags": F.array_compact(F.array("language", "layer", "kind")), "trend": F.lit(None).cast("string")})

    def search(self, *queries: str, k: int = 5, filters: dict[str, str] | None = None, current: bool = False, scorer=None) -> DataFrame:
        """Ranked files for each query: keywords with rescue and, with a provider, vectors, fused and scored; a second pass where the first is weak; best chunk of a file.

        With ``current`` only files count whose bytes are still those that were indexed. ``scorer``, a function of result rows, orders close first results.
        """
        guards.check_request([queries, filters])
        chunks = self._searchable(filters)
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
        fresh = None
        if current:
            kept, _ = sources.capped(sources.scan(self.spark, self.root, self.ignore or None))
            fresh = manifest.manifest(kept).join(self.index.open("manifest")["manifest"], ["path", "hash"], "left_semi")

        def near(forms: DataFrame) -> DataFrame:
            v = vectors.embedded(forms.select("query_id", F.col("query").alias("content")), self.provider)
            return search.nearest(v, chunks.select(F.col("id").alias("vec_id"), "embedding"), 50).select("query_id", F.col("vec_id").alias("id"), "rank")

        if fresh is not None:
            chunks = chunks.join(fresh.select("path"), "path", "left_semi")
        keep = keeper(self.spark)
        chunks = keep(chunks, "chunks")
        found = composed.searched(asked, chunks, keep, k, near if self.provider is not None else None, scorer)
        rows = found.join(chunks.select("id", "start_line", "end_line", "content"), "id").join(asked, "query_id")
        return rows.select("query_id", "rank", "path", "start_line", "end_line", F.round("score", 4).alias("score"), chunking.preview(F.col("content"), text.query_terms(F.col("query"))).alias("preview"), "chosen", "status", "confidence")

    def search_quality(self, *queries: str) -> DataFrame:
        rows = self.search(*queries).withColumn("test", paths.is_test(F.col("path")))
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
        return composed.judged(rows, asked)

    def references(self, symbol: str, limit: int = 10) -> DataFrame:
        """Files that name a symbol, most uses first, with the first line."""
        rows = self.index.open("files")["files"].select("path", F.posexplode(chunking.lines_of(F.col("text"))).alias("line", "body"))
        hits = rows.where(F.contains("body", F.lit(symbol))).withColumn("n", text.occurrences(F.col("body"), F.lit(symbol))).where("n > 0")
        out = hits.groupBy("path").agg(F.sum("n").alias("uses"), (F.min("line") + 1).alias("line"), F.min_by("body", "line").alias("preview"))
        return out.orderBy(F.desc("uses"), "path").limit(limit)

    def cycles(self, scope: str = "") -> DataFrame:
        c = graph.short_cycles(self.index.open("edges")["edges"])
        return c.where(F.forall("nodes", lambda n: n.startswith(scope))).withColumn("severity", scores.cycle_severity(F.col("length"))).orderBy("length", "nodes")

    def cycle_groups(self) -> DataFrame:
        """``node, group`` of all files on cycles of any length."""
        return graph.cycle_groups(self.index.open("edges")["edges"].select("src", "dst"), keeper(self.spark))

    def health(self, level: str = "low", file: str | None = None) -> DataFrame:
        e = self.index.open("edges", "chunks")
        cycles = graph.short_cycles(e["edges"]).select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("cycles"))
        complexity = e["chunks"].groupBy(F.col("path").alias("node")).agg(F.max("complexity").alias("complexity"))
        rows = health.at_least(health.scored(health.metrics(graph.degrees(e["edges"]), cycles, complexity)), level)
        rows = rows if file is None else rows.where(F.col("node") == file)
        return rows.orderBy(F.desc("severity"), F.desc("score"), "node").drop("severity")

    def relationships(self, file: str, direction: str = "out", hops: int = 1, most: int = 200) -> DataFrame:
        """Paths from a file whose edges still hold: both ends are as they were indexed."""
        old = self.index.open("edges", "manifest")
        now = manifest.manifest(sources.scan(self.spark, self.root, self.ignore or None).where("skip_reason is null"))
        fresh = manifest.freshness(old["manifest"].select("path"), old["manifest"], now).where("state = 'current'").select("path")
        e = old["edges"].join(fresh.select(F.col("path").alias("src")), "src", "left_semi").join(fresh.select(F.col("path").alias("dst")), "dst", "left_semi")
        return graph.paths(e, self.spark.createDataFrame([(file,)], "node string"), hops, direction, most)

    def impact(self, *files: str) -> DataFrame:
        return graph.impact(self.index.open("edges")["edges"], self.spark.createDataFrame([(f,) for f in files], "node string"))

    def preflight(self, *files: str) -> DataFrame:
        """How risky an edit of each file is."""
        n = self.impact(*files).groupBy("target").agg(F.count("*").alias("affected"))
        c = graph.short_cycles(self.index.open("edges")["edges"]).select(F.explode("nodes").alias("target")).groupBy("target").agg(F.count("*").alias("cycles"))
        rows = self.spark.createDataFrame([(f,) for f in files], "target string").join(n, "target", "left").join(c, "target", "left")
        return preflight.risk(rows.fillna(0, ["affected", "cycles"]))

    def patterns(self, category: str | None = None) -> DataFrame:
        facts = self.index.open("facts")["facts"]
        seen = facts.select("category", "name", F.col("path").alias("file"), F.lit(None).cast("timestamp").alias("ts"))
        rows = patterns.consensus(seen, F.current_timestamp()).select("category", "name", "n", "percent", "place", "guidance")
        return rows.where(F.col("category") == category) if category else rows

    def metadata(self) -> DataFrame:
        """Languages with their files, and dependencies with their categories."""
        t = self.index.open("files", "dependencies")
        langs = t["files"].groupBy(paths.language(F.col("path")).alias("name")).agg(F.count("*").cast("string").alias("value")).select(F.lit("language").alias("kind"), "name", "value")
        deps = patterns.merged_dependencies(t["dependencies"])
        return langs.union(deps.select(F.concat(F.lit("dependency: "), paths.dependency_category(F.col("name"))), "name", "version"))

    def style_guide(self, query: str = "") -> DataFrame:
        rows = sources.guides(self.spark, self.root)
        return notes.matching(rows, query.lower().split(), "heading", "body")

    def review(self, base: str, head: str = "HEAD", k: int = 5) -> DataFrame:
        """What to read before reviewing a change: results of the queries that it suggests."""
        patches = self.spark.createDataFrame(sources.git_diff(self.root, base, head), "path string, patch string")
        ids = review.changed_identifiers(patches).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "identifier"))), lambda x: x["identifier"]).alias("identifiers"))
        size = review.patch_stats(patches).select("path", (F.col("additions") + F.col("deletions")).alias("changes"))
        asked = review.review_queries(size.join(ids, "path", "left").withColumn("identifiers", F.coalesce("identifiers", F.array().cast("array<string>")))).collect()  # eight rows at most
        if not asked:
            return self.search("", k=k).limit(0)
        names = self.spark.createDataFrame([(i, r.query, r.files) for i, r in enumerate(asked)], "query_id long, query string, asked_by array<string>")
        return self.search(*[r.query for r in asked], k=k).join(names, "query_id")

    # ------------------------------------------------------------------ notes

    @property
    def _notes(self) -> str:
        return f"{self.store}/notes"

    def remember(self, kind: str, category: str, memory: str, reason: str, scope: str = "global", file: str | None = None, symbol: str | None = None) -> bool:
        """Store a note; whether it is new."""
        s = notes.scope_text(F.lit(scope), F.lit(file), F.lit(symbol))
        row = self.spark.range(1).select(F.lit(kind).alias("type"), F.lit(category).alias("category"), F.lit(memory).alias("memory"), F.lit(reason).alias("reason"), F.lit(dt.datetime.now(dt.timezone.utc).isoformat()).alias("date"), F.struct(F.lit(scope).alias("kind"), F.lit(file).cast("string").alias("file"), F.lit(symbol).cast("string").alias("symbol")).alias("scope"))
        row = row.withColumn("id", notes.identity(F.col("type"), F.col("category"), F.col("memory"), F.col("reason"), s))
        return bool(sources.append_notes(self.spark, self._notes, row))

    def memory(self, query: str = "", kind: str | None = None, category: str | None = None, k: int = 20) -> DataFrame:
        """Notes with their confidence as of now; the newest k if nothing is asked for."""
        rows = notes.decayed(sources.read_notes(self.spark, self._notes), F.current_timestamp())
        rows = rows if kind is None else rows.where(F.col("type") == kind)
        rows = rows if category is None else rows.where(F.col("category") == category)
        rows = notes.matching(rows, query.lower().split(), "memory", "reason")
        return rows if query or kind or category else notes.recent(rows, k)

    # ------------------------------------------------------------------ map

    def map(self) -> dict[str, DataFrame]:
        """Sections of a project's map: layers, entry points, hubs, hotspots, packages."""
        t = self.index.open("edges", "packages")
        e = t["edges"].where(paths.is_map_eligible(F.col("src")) & paths.is_map_eligible(F.col("dst")))
        nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
        fan = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("importers"))
        degree = graph.degrees(e).select("node", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
        return {
            "layers": nodes.groupBy(F.element_at(F.split("node", "/"), 1).alias("layer")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "layer"),
            "entrypoints": graph.entrypoints(e).orderBy("node").limit(8),
            "hubs": graph.top(fan, 5, F.desc("importers"), F.asc("node")),
            "hotspots": graph.top(degree, 5, F.desc("degree"), F.asc("node")),
            "packages": t["packages"].groupBy("source").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "source").limit(8),
        }

    def map_markdown(self) -> str:
        """The map as text; every section has a fixed number of rows."""
        out = ["# Map"]
        for name, df in self.map().items():
            out += ["", f"## {name.capitalize()}", "", *["- " + ", ".join(f"{v}" for k, v in r.asDict().items() if k != "rank") for r in df.collect()]]
        return "\n".join(out) + "\n"
