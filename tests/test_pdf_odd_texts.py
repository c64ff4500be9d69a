"""PDF queries over texts of any characters, missing texts and items of several rows."""

from __future__ import annotations

import os

import pytest
from oracle import compare

from millrace.plans import registry
from millrace.sources.pdf import simple_extractor, simple_pdf

ODD = ["cœur „x“ – … €", "日本 кот 😀", "a\rb", "\r", "\x01\x7f\x85\xa0", "x\ty", "<41> (a) \\1 [b] /F2", ""]


def test_any_characters_come_back():
    assert simple_extractor(simple_pdf(ODD)) == ODD
    assert simple_extractor(simple_pdf(["é\nж\n€ )\nz", "plain"])) == ["é\nж\n€ )\nz", "plain"]


@pytest.fixture
def odd_sf(spark, sf, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(20, "\n".join(ODD)), (21, None), (30, "a\nb\n"), (30, "c"), (30, None), (31, "s\nt"), (31, "s\nt"), (None, "n")]
    for f in os.listdir(sf):
        if f != "benchmark.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["pdf_pages", "pdf_markdown"])
def test_odd_items(spark, odd_sf, name):
    assert compare(registry.queries()[name](spark, odd_sf), registry.oracle_sql()[name], odd_sf) == ""
