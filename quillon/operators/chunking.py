"""From files to chunks: line windows, component windows, interval trees, segments, merges. Lines of a file stay in its row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Fixed value: files that a fold holds as Python objects at once.
FILES = 256


def lines_of(text: Column) -> Column:
    """The lines of a text; trailing empty ones count."""
    return F.split(text, "\n", -1)


def line_chunks(files: DataFrame, size: int = 50, overlap: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of ``size`` lines, each ``overlap`` lines before the end of the last: ``key, chunk, start_line, end_line, content``.

    A window is a slice of its own row's lines, so that nothing is shuffled. No window starts within the last ``overlap`` lines.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    rows = files.select(key, lines_of(F.col(text)).alias("lines")).where("lines is not null")
    last = F.greatest(F.size("lines") - 1 - overlap, F.lit(0))
    rows = rows.select(key, "lines", F.posexplode(F.sequence(F.lit(0), last, F.lit(size - overlap))).alias("chunk", "start"))
    end = F.least(F.col("start") + size, F.size("lines"))
    return rows.select(key, "chunk", (F.col("start") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", F.col("start") + 1, F.lit(size)), "\n").alias("content"))


def component_chunks(files: DataFrame, components: DataFrame, context: int = 5, key: str = "doc_id") -> DataFrame:
    """The lines of each component ``(key, name, start, end)`` with lines around it, cut to the file."""
    rows = files.select(key, lines_of(F.col("text")).alias("lines")).join(components, key)
    first, last = F.greatest(F.col("start") - context, F.lit(1)), F.least(F.col("end") + context, F.size("lines"))
    return rows.select(key, "name", first.alias("start_line"), last.alias("end_line"), F.array_join(F.slice("lines", first, last - first + 1), "\n").alias("content"))


def containment(symbols: DataFrame, key: str = "file") -> DataFrame:
    """Each symbol ``(key, id, start, end)`` with ``parent``, the smallest other interval of its file that holds it strictly."""
    p = symbols.select(F.col(key).alias("pk"), F.col("id").alias("pid"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    inside = (F.col("pk") == F.col(key)) & (F.col("ps") <= F.col("start")) & (F.col("pe") >= F.col("end")) & ((F.col("ps") < F.col("start")) | (F.col("pe") > F.col("end")))
    best = symbols.join(p, inside).groupBy(key, "id").agg(F.min_by("pid", F.struct(F.col("pe") - F.col("ps"), "ps", "pid")).alias("parent"))
    return symbols.join(best, [key, "id"], "left")


def segments(symbols: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """A partition of each file's lines 1 to ``n_lines`` at all starts and ends; ``owner`` is the innermost symbol there, null in gaps."""
    cuts = symbols.select(key, F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("at")).union(files.select(key, F.explode(F.array(F.lit(1), F.col("n_lines") + 1))))
    w = Window.partitionBy(key).orderBy("at")
    parts = cuts.distinct().withColumn("next", F.lead("at").over(w)).where("next is not null").select(key, F.col("at").alias("start_line"), (F.col("next") - 1).alias("end_line"))
    s = symbols.select(F.col(key).alias("sk"), "id", "start", "end")
    hit = parts.join(s, (F.col("sk") == F.col(key)) & (F.col("start") <= F.col("start_line")) & (F.col("end") >= F.col("end_line")), "left")
    return hit.groupBy(key, "start_line", "end_line").agg(F.min_by("id", F.struct(F.col("end") - F.col("start"), "start", "id")).alias("owner"))


def _folded(chunks: DataFrame, key: str, joins, merged) -> DataFrame:
    """A fold over each file's chunks in order of lines: ``merged(last, row)`` takes the place of both wherever ``joins(last, row)``."""
    cells = [F.col(c) for c in chunks.columns]

    def folded(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for row in sorted(rows, key=lambda r: (r["start_line"], r["end_line"])):
            if out and joins(out[-1], row):
                out[-1] = merged(out[-1], row)
            else:
                out.append(row)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("rows")
            schema = pa.schema(list(files.type.value_type))
            for low in range(0, len(files), FILES):  # files whose rows are Python objects at once
                yield pa.RecordBatch.from_pylist([row for file in files.slice(low, FILES).to_pylist() for row in folded(file)], schema=schema)

    return chunks.groupBy(F.col(key).alias("file")).agg(F.collect_list(F.struct(*cells)).alias("rows")).select("rows").mapInArrow(run, chunks.schema)


def merge_small(chunks: DataFrame, least: int = 15, key: str = "doc_id", same: tuple[str, ...] | None = None, united: tuple[str, ...] = (), owners: tuple[str, ...] = ()) -> DataFrame:
    """Adjacent chunks of a file become one if each, the one so far and the next, has fewer than ``least`` lines.

    All other columns must agree (or just those named in ``same``); array columns in ``united`` become their union, in order, and chunks with a value in
    one of ``owners`` stay as they are. Whether two merge depends on the size so far, so that it is a fold over each file's chunks in order.
    """
    fixed = {key, "start_line", "end_line", "content", *united, *owners}
    agree = tuple(c for c in chunks.columns if c not in fixed) if same is None else same

    def lines(row: dict) -> int:
        return row["content"].count("\n") + 1

    def joins(last: dict, row: dict) -> bool:
        spans = all(r["end_line"] - r["start_line"] + 1 == lines(r) for r in (last, row))
        return spans and row["start_line"] == last["end_line"] + 1 and max(lines(last), lines(row)) < least and all(last[c] == row[c] for c in agree) and all(r[c] is None for c in owners for r in (last, row))

    def merged(last: dict, row: dict) -> dict:
        both = {c: list(dict.fromkeys([*(last[c] if last[c] is not None else []), *(row[c] if row[c] is not None else [])])) for c in united}
        return last | both | {"end_line": row["end_line"], "content": last["content"] + "\n" + row["content"]}

    return _folded(chunks.select(key, "start_line", "end_line", "content", *[c for c in chunks.columns if c in {*agree, *united, *owners}]), key, joins, merged)


def merge_symbols(chunks: DataFrame, least: int, key: str = "doc_id") -> DataFrame:
    """Neighbouring chunks of symbols with one ``parent``, each of fewer than ``least`` lines, become one with both names; ``symbol`` is null for other chunks."""
    def size(row: dict) -> int:
        return row["end_line"] - row["start_line"] + 1

    def joins(last: dict, row: dict) -> bool:
        return last["symbol"] is not None and row["symbol"] is not None and max(size(last), size(row)) < least and last["parent"] == row["parent"]

    return _folded(chunks, key, joins, lambda last, row: last | {"end_line": row["end_line"], "content": last["content"] + "\n" + row["content"], "symbol": last["symbol"] + "+" + row["symbol"]})


def split_oversized(chunks: DataFrame, most: int = 150) -> DataFrame:
    """Chunks of over ``most`` lines are cut in two until none is.

    The cut comes after the line nearest the middle that is blank, a comment or a closing brace, within 20 lines or a quarter of the chunk, the first
    on ties; without one it is at the middle. Where there is a column ``symbol``, the parts of a chunk are numbered after its name.
    """
    schema = chunks.schema
    safe = re.compile(r"\s*(?://|#|/\*|\*/)|\s*(?:\};?)?\s*$")

    def halves(start: int, lines: list[str]) -> list[tuple[int, list[str]]]:
        if len(lines) <= most:
            return [(start, lines)]
        middle, reach = len(lines) // 2, min(20, len(lines) // 4)
        near = [i for i in range(max(1, middle - reach), min(len(lines) - 1, middle + reach) + 1) if safe.match(lines[i])]
        at = min(near, key=lambda i: (abs(i - middle), i)) + 1 if near else middle
        return [(start, lines)] if at >= len(lines) else halves(start, lines[:at]) + halves(start + at, lines[at:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                parts = halves(row["start_line"], row["content"].split("\n"))
                for n, (s, part) in enumerate(parts, 1):
                    name = {"symbol": f"{re.sub(':[0-9]+$', '', row['symbol'] or 'chunk')}:{n}"} if len(parts) > 1 and "symbol" in row else {}
                    out.append(row | name | {"start_line": s, "end_line": s + len(part) - 1, "content": "\n".join(part)})
            yield pd.DataFrame(out, columns=rows.columns)

    return chunks.mapInPandas(run, schema)


def partition(symbols: DataFrame, files: DataFrame, key: str = "file") -> DataFrame:
    """:func:`segments` with ``kind``: a leaf's own lines are its ``body``, lines of a container before, between and after its parts its ``header``, ``body`` and ``footer``, the rest ``filler``."""
    rows = segments(symbols, files, key)
    s = symbols.select(F.col(key).alias("sk"), F.col("id").alias("owner_id"), F.col("start").alias("s"), F.col("end").alias("e"))
    inner = symbols.select(F.col(key).alias("ik"), F.col("id").alias("iid"), F.col("start").alias("is"), F.col("end").alias("ie"))
    inside = (F.col("ik") == F.col("sk")) & (F.col("is") >= F.col("s")) & (F.col("ie") <= F.col("e")) & (F.col("iid") != F.col("owner_id")) & ((F.col("is") > F.col("s")) | (F.col("ie") < F.col("e")))
    parts = s.join(inner, inside, "left").groupBy("sk", "owner_id").agg(F.min("is").alias("first"), F.max("ie").alias("last"))
    kind = F.when(F.col("owner").isNull(), "filler").when(F.col("first").isNull(), "body").when(F.col("end_line") < F.col("first"), "header").when(F.col("start_line") > F.col("last"), "footer").otherwise("body")
    return rows.join(parts, (F.col(key) == F.col("sk")) & (F.col("owner") == F.col("owner_id")), "left").select(*rows.columns, kind.alias("kind"))


def broken(chunks: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks whose text isn't the lines of their file that they claim."""
    rows = chunks.join(files.select(key, lines_of(F.col("text")).alias("lines")), key)
    n = F.col("end_line") - F.col("start_line") + 1
    good = (F.size(lines_of(F.col("content"))) == n) & (F.array_join(F.slice("lines", F.col("start_line"), n), "\n") == F.col("content"))
    return rows.where(~F.coalesce(good, F.lit(False))).select(*chunks.columns)


def chunk_id(path: Column, start: Column, end: Column, symbol: Column) -> Column:
    """An identifier that the same chunk gets in every build."""
    return F.sha2(F.concat_ws("|", path, start.cast("string"), end.cast("string"), F.coalesce(symbol, F.lit(""))), 256)


def tags(kind: Column, decorators: Column, hooks: Column, state: Column, layer: Column, framework: Column, standalone: Column, routes: Column) -> Column:
    """What a chunk is tagged with, in this order, each tag once."""
    one = F.filter(F.array(state, layer, framework, F.when(standalone, "standalone"), F.when(routes, "routing")), lambda x: x.isNotNull())
    lists = [F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower) for c in (decorators, hooks)]
    return F.array_distinct(F.concat(F.filter(F.array(kind), lambda x: x.isNotNull()), *lists, one))


def embedding_text(path: Column, kind: Column, component: Column, layer: Column, body: Column) -> Column:
    """What is embedded for a chunk: what is known of it, then its text."""
    def part(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value))

    return F.concat_ws("\n", F.concat_ws(" ", part("path", path), part("type", kind), part("component", component), part("layer", layer)), body)


def preview(text: Column, terms: Column, k: int = 3) -> Column:
    """The k lines around the first line that has most of the terms."""
    rows = lines_of(text)
    hits = F.transform(rows, lambda line, i: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.lower(line), t))).alias("n"), (-i).alias("i")))
    at = -F.array_max(hits)["i"]
    return F.array_join(F.slice(rows, F.greatest(at + 1 - k // 2, F.lit(1)), k), "\n")


def sections(text: Column, mark: str = "## ") -> Column:
    """The parts of a guide that start at a line with ``mark``, heading and body; what stands before the first has no heading."""
    parts = F.split(F.concat(F.lit("\n"), text), "\n" + mark, -1)
    return F.transform(parts, lambda p, i: F.struct(F.when(i > 0, F.btrim(F.substring_index(p, "\n", 1))).alias("heading"), F.btrim(F.when(i > 0, F.when(F.contains(p, F.lit("\n")), F.substring(p, F.instr(p, "\n") + 1, F.length(p))).otherwise("")).otherwise(p), F.lit(" \n")).alias("body")))
