"""Line dedup by distinct-site spread, in DataFrame operations only.

A line is boilerplate if it stands on at least ``min_sites`` sites.  Every line is two 64-bit hashes of its trimmed text.  HyperLogLog
sketches of the sites merge by aggregation, one a line hash; lines whose estimate is clearly below or above the bound are decided by it, those
near it get an exact distinct count.  Of a boilerplate line the first occurrence, by doc_id and position, stays and all others go, so that
no content is lost altogether when whole documents are copied from site to site.

Only hashes and positions are shuffled by line; a common line is aggregated before that.  A document's text is rebuilt from its own lines.

Defined cases: null text stays null; empty texts and lines that are empty after trimming are kept and never boilerplate; a null site counts as
no site; rows are documents by id and text, so that repeated rows lose the same lines; occurrences under a null doc_id come after all others;
an empty table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import realigned, stored

#: log2 of a sketch's registers; its relative standard error is 1.04 / sqrt(4096), 1.6 %.
LOG_REGISTERS = 12
#: Share of the bound on either side of it, three standard errors, within which an estimate isn't trusted; and one site.
MARGIN = 0.05


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _without(parts: Column, gone: Column) -> Column:
    """``parts`` without the elements at the positions ``gone``, in time linear in both: a set difference of positions, then a look at each."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    bound = F.array(F.struct(parts.alias("parts"), kept.alias("kept")))  # so that no step of the loop computes either again
    return F.get(F.transform(bound, lambda x: F.transform(x["kept"], lambda i: F.get(x["parts"], i))), 0)


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``h1, h2, first`` of lines on at least ``min_sites`` sites, from ``(site, h1, h2, at)``; ``first`` is the smallest ``at``."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.min("at").alias("first"))
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    spread = stored(spread.where(F.col("sites") >= low), "spread")
    near = spread.where(F.col("sites") < high).select(realigned(F.col("h1")).alias("k1"), F.col("h2").alias("k2"), F.col("first").alias("near_first"))
    exact = lines.join(near, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    exact = exact.groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"), F.min("near_first").alias("first"))
    return spread.where(F.col("sites") >= high).select("h1", "h2", "first").union(exact.where(F.col("sites") >= min_sites).select("h1", "h2", "first"))


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, keep_first: bool = True) -> DataFrame:
    """``docs`` with its boilerplate lines cut from the text, and ``n_lines`` and ``n_removed``, which replace columns of those names."""
    out = _cut(docs.drop("n_lines", "n_removed"), id_col, text_col, site_col, min_sites, keep_first)
    return out.withColumnsRenamed({"__n_lines": "n_lines", "__n_removed": "n_removed"})


def _cut(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, keep_first: bool) -> DataFrame:
    own = docs.select(F.col(id_col).alias("doc"), F.col(site_col).cast("string").alias("site"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    own = own.select("doc", "site", "tag", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))  # tag first: a row of the explosion doesn't hash the whole text
    own = own.withColumn("line", _trimmed(F.col("line"))).where("line <> ''")
    at = F.struct(F.col("doc").isNull().alias("unknown"), "doc", "pos", "tag")
    lines = stored(own.select("doc", "tag", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "pos", at.alias("at")), "lines")
    common = boilerplate(lines, min_sites).select(realigned(F.col("h1")).alias("k1"), F.col("h2").alias("k2"), "first")
    hit = lines.join(common, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    if keep_first:
        hit = hit.where(F.col("at") != F.col("first"))
    gone = hit.groupBy("doc", "tag").agg(F.collect_set("pos").alias("gone")).select(F.col("doc").alias("__gone_doc"), F.shiftleft("tag", 0).alias("__gone_tag"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col("__gone_doc")) & (F.xxhash64(docs[text_col]) == F.col("__gone_tag")), "left")
    parts = F.split(docs[text_col], "\n", -1)
    kept = F.when(F.col("__gone").isNull(), docs[text_col]).otherwise(F.array_join(_without(parts, F.col("__gone")), "\n"))
    columns = [kept.alias(c) if c == text_col else docs[c] for c in docs.columns]
    n_lines = F.size(F.filter(parts, lambda x: _trimmed(x) != ""))
    return joined.select(*columns, F.when(docs[text_col].isNull(), 0).otherwise(n_lines).cast("long").alias("__n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("__n_removed"))


def op3_line_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed`` and the SHA-256 of the text that stays."""
    rows = without_boilerplate(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


ORACLE = """
WITH own AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
named AS (SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS plain FROM own),
common AS (
  SELECT plain, min(struct_pack(d := doc_id, p := pos)) AS first FROM named
  WHERE plain <> '' GROUP BY plain HAVING count(DISTINCT source) >= 10),
marked AS (
  SELECT n.*, c.plain IS NOT NULL AND NOT (n.doc_id = c.first.d AND n.pos = c.first.p) AS gone
  FROM named n LEFT JOIN common c USING (plain))
SELECT d.doc_id, count(*) FILTER (WHERE m.plain <> '')::BIGINT AS n_lines, count(*) FILTER (WHERE m.gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '')) AS text_sha256
FROM documents d JOIN marked m USING (doc_id) GROUP BY d.doc_id
"""


def keep_unspread(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """``docs`` without boilerplate lines; same columns, ``n_chars`` the length of what stays."""
    out = _cut(docs, "doc_id", "text", "source", min_sites, True).drop("__n_lines", "__n_removed")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
