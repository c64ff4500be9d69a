"""Streams of PDF files, whatever bytes they hold."""

from __future__ import annotations

import random
import re

from oracle import compare

from millrace.plans import registry
from millrace.sources.pdf import simple_extractor, simple_pdf


def test_deflated_streams_may_end_with_any_byte():
    """One in 256 ends with a carriage return, which belongs to it."""
    draw = random.Random(1)
    for _ in range(2_000):
        pages = ["".join(draw.choices("abc de", k=30)).strip(), "x"]
        assert simple_extractor(simple_pdf(pages)) == pages


def test_plain_streams_with_words_of_the_file_format():
    drawn = b"BT (1 0 obj) Tj 0 -12 Td (\nendstream endobj 3 0 obj) Tj ET"
    head = b"%%PDF-1.4\n1 0 obj\n<< /Type /Pages /Kids [2 0 R] /Count 1 >>\nendobj\n2 0 obj\n<< /Type /Page /Parent 1 0 R /Contents 4 0 R >>\nendobj\n5 0 obj\n%d\nendobj\n" % len(drawn)
    for length in (b"%d" % len(drawn), b"5 0 R"):
        assert simple_extractor(head + b"4 0 obj\n<< /Length " + length + b" >>\nstream\n" + drawn + b"\nendstream\nendobj\n") == ["1 0 obj\n\nendstream endobj 3 0 obj"]


def test_a_wrong_length_is_no_end():
    made = re.sub(rb"/Length \d+", b"/Length 3", simple_pdf(["one\ntwo", "three"]))
    assert simple_extractor(made) == ["one\ntwo", "three"]
    assert simple_extractor(re.sub(rb"/Length \d+ ", b"", made)) == ["one\ntwo", "three"]


def test_pdf_pages_over_more_items(spark):
    assert compare(registry.queries()["pdf_pages"](spark, "/root/testdata/sf0.1"), registry.oracle_sql()["pdf_pages"], "/root/testdata/sf0.1") == ""


def test_pdf_markdown_over_more_items(spark):
    assert compare(registry.queries()["pdf_markdown"](spark, "/root/testdata/sf0.1"), registry.oracle_sql()["pdf_markdown"], "/root/testdata/sf0.1") == ""
