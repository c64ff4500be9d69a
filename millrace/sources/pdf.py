"""PDF text as rows of pages. The extractor is injected; the built-in one reads text drawn with simple fonts and fonts of UTF-16 codes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import without_nul
from millrace.session import reachable

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_BODY = re.compile(rb"\bstream\r?\n|\bendobj\b")
_LENGTH = re.compile(rb"/Length\s+(\d+)(\s+\d+\s+R\b)?")
_STREAM_END = re.compile(rb"\s*endstream\b")
_UTF16 = re.compile(rb"<0000>\s*<[Ff]{4}>\s*<0000>")  # what a font's ToUnicode map says if its codes are UTF-16
_DRAWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[+-]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_NARROW = re.compile("[\n\t -~\xa0-\xff]*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")

    def unescaped(m):
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|.)", unescaped, token[1:-1], flags=re.S).decode("latin-1")


def _page_text(content: bytes, wide: frozenset[bytes] = frozenset()) -> str:
    """A page's strings by their places: lines from the top, in a line from the left. wide: the names of fonts whose codes are UTF-16."""
    drawn: list[tuple[float, float, str]] = []
    held: list = []
    name = font = b""
    x = y = line_x = leading = 0.0
    for token in _DRAWN.findall(content):
        if token[:1] in b"(<":
            held.append(_string(token))
        elif re.fullmatch(rb"[+-]?\d*\.?\d+", token):
            held.append(float(token))
        elif token[:1] == b"/":
            name = token[1:]
        elif token in (b"[", b"]"):
            continue
        else:
            numbers = [v for v in held if isinstance(v, float)]
            if token in (b"Td", b"TD") and len(numbers) >= 2:
                line_x, y = line_x + numbers[-2], y + numbers[-1]
                x, leading = line_x, -numbers[-1] if token == b"TD" else leading
            elif token == b"Tm" and len(numbers) >= 6:
                line_x = x = numbers[-2]
                y = numbers[-1]
            elif token == b"TL" and numbers:
                leading = numbers[-1]
            elif token == b"Tf":
                font = name
            elif token == b"BT":
                x = y = line_x = 0.0
            if token in (b"T*", b"'", b'"'):
                x, y = line_x, y - leading
            if token in (b"Tj", b"TJ", b"'", b'"') and (text := "".join(v for v in held if isinstance(v, str))):
                text = text.encode("latin-1").decode("utf-16-be", "replace") if font in wide else text
                drawn.append((-y, x, text))
                x += len(text)
            held = []
    lines: dict[float, list[str]] = {}
    for down, _, text in sorted(drawn, key=lambda d: d[:2]):
        lines.setdefault(round(down, 1), []).append(text)
    return "\n".join("".join(parts) for parts in lines.values())


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """(what stands before the stream, the stream or None) of each object. A stream has the bytes that its length says, whatever they are; without a right length it ends before `endstream`."""
    out: dict[int, tuple[bytes, bytes | None]] = {}
    at = 0
    while (m := _OBJECT.search(data, at)) and (e := _BODY.search(data, m.end())):
        head, own, at = data[m.end() : e.start()], None, e.end()
        if e[0] != b"endobj":
            size = _LENGTH.search(head)
            if size and size[2]:  # the length is an object of its own
                size = re.search(rb"\b%d\s+\d+\s+obj\s+(\d+)\s+endobj\b" % int(size[1]), data)
            end = at + int(size[1]) if size else -1
            if end < at or not _STREAM_END.match(data, end):
                end = data.find(b"endstream", at)
                end = len(data) if end < 0 else end
            own, at = data[at:end], end
        out[int(m[1])] = head, own
    return out


def simple_extractor(data: bytes) -> list[str]:
    """The text of each page, in page order. Streams may be plain or deflated; encrypted files and fonts with codes of their own other than UTF-16 are not read."""
    parts = _objects(data)
    objects = {n: head for n, (head, _) in parts.items()}

    def stream(n: int) -> bytes:
        head, own = parts.get(n, (b"", None))
        return b"" if not own else zlib.decompressobj().decompress(own) if b"/FlateDecode" in head else own

    def pages(n: int, seen: frozenset) -> Iterator[int]:
        body = objects.get(n, b"")
        if n in seen:
            return
        if kids := re.search(rb"/Kids\s*\[([^\]]*)\]", body):
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                yield from pages(int(k), seen | {n})
        elif re.search(rb"/Type\s*/Page\b", body):
            yield n

    def utf16(n: int) -> bool:
        own = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", objects.get(n, b""))
        return bool(own and _UTF16.search(stream(int(own[1]))))

    out = []
    wide = {n for n, b in objects.items() if b"/Identity-H" in b and utf16(n)}
    for root in (n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b):
        for n in pages(root, frozenset()):
            m = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+)\s+\d+\s+R)", objects[n])
            refs = [] if not m else [int(m[2])] if m[2] else [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", m[1])]
            fonts = frozenset(name for name, k in re.findall(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", objects[n]) if int(k) in wide)
            out.append(_page_text(b"\n".join(map(stream, refs)), fonts))
    return out


def simple_pdf(pages: list[str]) -> bytes:
    """A PDF of plain text, a line of text a line. Lines with other characters than the visible ones of Latin-1 are in a font of UTF-16 codes."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    fonts, kids = b"/F1 3 0 R", []
    if not all(map(_NARROW.fullmatch, pages)):
        fonts += b" /F2 4 0 R"
        objects.append(b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 6 0 R >>")
        objects.append(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>")
        codes = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
        objects.append(b"<< /Length %d >>\nstream\n" % len(codes) + codes + b"\nendstream")

    def shown(line: str) -> bytes:
        if _NARROW.fullmatch(line):
            return b"(" + re.sub(rb"([()\\])", rb"\\\1", line.encode("latin-1")) + b") Tj"
        return b"/F2 10 Tf <" + line.encode("utf-16-be").hex().encode() + b"> Tj /F1 10 Tf"

    for text in pages:
        body = zlib.compress(b"BT /F1 10 Tf 12 TL 40 800 Td " + b" T* ".join(map(shown, text.split("\n"))) + b" ET")
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << %s >> >> >>" % (len(objects), fonts))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n" % (k + 1) + o + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer << /Root 1 0 R /Size %d >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def pages_of(files: DataFrame, key: str = "path", extract: Callable[[bytes], list[str]] = simple_extractor) -> DataFrame:
    """key, page, text of the pages of files (key, content), without NUL characters. A file that can't be read gives one row with a null page."""
    reachable(files.sparkSession)
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(1)):  # a file at a time
                try:
                    texts = extract(data.as_py() or b"")
                except Exception:
                    texts = None
                n = 1 if texts is None else len(texts)
                columns = [batch.column(0).take(pa.array([k] * n, pa.int64())), pa.array([None] if texts is None else range(n), pa.int32()), pa.array([None] if texts is None else texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "page", "text"])

    rows = files.select(F.col(key).alias("key"), "content").mapInArrow(run, f"key {kind}, page int, text string")
    return rows.select(F.col("key").alias(key), "page", without_nul(F.col("text")).alias("text"))


def pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] = simple_extractor) -> DataFrame:
    """path, page, text of the PDF files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    return pages_of(files.select("path", "content"), "path", extract)
