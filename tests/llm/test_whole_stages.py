"""Stages of the pipeline do the whole job, whatever the sizes of their inputs."""

from __future__ import annotations

from quillon.llm import decontaminate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_cuts_do_not_depend_on_the_number_of_phrase_sets(spark):
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(words[i * 5 : i * 5 + 12])) for i in range(37)]  # each overlaps the next two
    docs = [(0, " ".join(["before", *words[:192], "after"])), (1, " ".join(["a", *words[:17], "b", *words[40:57], "c"])), (2, "nothing of it"), (3, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS).selectExpr("*", "7 AS __spans")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.phrase_sets(bench, "item_id", "text", 10, 300)) > 3
    one, many = (decontaminate.decontaminated(frame, bench, phrase_bytes=n) for n in (1 << 20, 300))
    assert many.columns == frame.columns and many.schema.fields == frame.schema.fields
    got = sorted(tuple(r) for r in many.collect())
    assert got == sorted(tuple(r) for r in one.collect())
    assert {r[0]: r[1] for r in got} == {0: "before  after", 1: "a  b  c", 2: "nothing of it", 3: None}
