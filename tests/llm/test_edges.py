"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for all operators."""

import pytest
from pyspark.sql import functions as F

from sitescore.llm import decontam_prefix, filter_audit, html_pagediff, langid_subword, line_dedup, mix_flow, pii_feistel, quality_cascade, simhash_anchors, token_separator, toxicity_segments, warc_source

from .conftest import edge_cases

OPERATORS = {
    "simhash": lambda d, labels, bench: simhash_anchors.near_duplicates(d),
    "toxicity": lambda d, labels, bench: toxicity_segments.toxicity(d, labels),
    "language": lambda d, labels, bench: langid_subword.identify(d),
    "quality": lambda d, labels, bench: quality_cascade.quality(d),
    "pii": lambda d, labels, bench: pii_feistel.pseudonymised(d),
    "mix": lambda d, labels, bench: mix_flow.mix(d),
    "decontam": lambda d, labels, bench: decontam_prefix.contamination(d, bench),
    "decontam_joined": lambda d, labels, bench: decontam_prefix.contamination(d, bench, 8),
    "tokens": lambda d, labels, bench: token_separator.token_counts(d),
    "lines": lambda d, labels, bench: line_dedup.deduplicated(d),
    "masks": lambda d, labels, bench: filter_audit.masks(d).withColumn("doc_id", F.explode(F.array_repeat("doc_id", F.col("n").cast("int")))),
}
FILTERS = {
    "simhash": lambda d, labels, bench: simhash_anchors.keep_one(d),
    "toxicity": lambda d, labels, bench: toxicity_segments.keep_clean(d, labels),
    "decontam": lambda d, labels, bench: decontam_prefix.keep_uncontaminated(d, bench),
    "decontam_joined": lambda d, labels, bench: decontam_prefix.keep_uncontaminated(d, bench, 8),
    "pii": lambda d, labels, bench: pii_feistel.replaced(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(name, edge, empty, labels, benchmark):
    got = OPERATORS[name](edge, labels, benchmark).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, *_ in edge_cases())
    assert OPERATORS[name](empty, labels, benchmark).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_side_tables(name, spark, edge, labels, benchmark):
    got = OPERATORS[name](edge, labels.limit(0), benchmark.limit(0)).count()
    assert got == len(edge_cases())


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(name, edge, empty, labels, benchmark):
    got = FILTERS[name](edge, labels, benchmark)
    assert got.columns == edge.columns
    assert got.count() <= len(edge_cases())
    assert FILTERS[name](empty, labels, benchmark).count() == 0
    assert FILTERS[name](empty, labels, benchmark).columns == edge.columns


def test_mix_keeps_columns(edge, empty):
    got = mix_flow.keep_drawn(edge)
    assert {*got.columns} == {*edge.columns} | {"source_size"}
    assert mix_flow.keep_drawn(empty).count() == 0


PAGES = [(1, "http://a.org/x/1", "<p>one</p>"), (2, None, "<p>two"), (3, "http://a.org/x/2", None), (4, "not a url", ""), (None, "http://a.org/x/1", "<p>" + "word " * 50_000), (1, "http://a.org/x/1", "<p>one</p>"), (5, "", "<<<>>> & &nope; <a href='x>")]


def test_pages(spark):
    pages = spark.createDataFrame([(*r, "x", "y") for r in PAGES], "page_id long, url string, html string, text string, record_type string")
    found = html_pagediff.extract(pages)
    assert sorted(str(r["page_id"]) for r in found.collect()) == sorted(str(r[0]) for r in PAGES)
    assert {r["page_id"]: r["text"] for r in found.where("page_id in (2, 3, 4)").collect()} == {2: "two", 3: "", 4: ""}
    assert html_pagediff.extract(pages.limit(0)).count() == 0
    kept = warc_source.archived(pages)
    assert kept.count() == len(PAGES)
    assert {r["page_id"]: r["payload_bytes"] for r in kept.where("page_id in (2, 3, 4)").collect()} == {2: 6, 3: 0, 4: 0}
    assert warc_source.archived(pages.limit(0)).count() == 0
    assert warc_source.archived(pages, compression="none").agg(F.sum("payload_bytes")).first()[0] == sum(len((h or "").encode()) for _, _, h in PAGES)
