"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes in the order in which they are applied.
XML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def xml_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in XML_ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fill(template: Column, **values: Column) -> Column:
    """{name} in a template replaced by a column."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def fill_marks(template: Column, **values: Column) -> Column:
    """#(name) in a template replaced by a column."""
    for k, v in values.items():
        template = F.replace(template, F.lit(f"#({k})"), v)
    return template


def words(c: Column) -> Column:
    return F.split(c, "[ \n]+")


def token_estimate(c: Column) -> Column:
    """An estimate of a text's tokens: its runs of word characters and its other visible characters."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]"), F.lit(0)))


def references() -> dict[str, str]:
    """What the named character references of HTML 4 stand for, and the numbers 128 to 159, which browsers read as Windows-1252. A no-break space is a space in visible text."""
    from html.entities import name2codepoint

    out = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
    for code in range(128, 160):
        out[f"#{code}"] = bytes([code]).decode("cp1252", "replace")
    return out | {"nbsp": " ", "#160": " "}


#: A reference after its ampersand.
REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"


def decoded(c: Column) -> Column:
    """Character references decoded, once each: named ones and any number. What is no reference stays; numbers of no character become U+FFFD. Texts without an ampersand are left as they are."""
    known = references()
    values = F.map_from_arrays(F.array(*map(F.lit, known)), F.array(*map(F.lit, known.values())))

    # In steps, so that each is evaluated once: a piece with its reference's name, with its number, with its value.
    def named(p: Column) -> Column:
        return F.struct(p.alias("p"), F.regexp_extract(p, REFERENCE, 1).alias("name"))

    def numbered(x: Column) -> Column:
        name = x["name"]
        code = F.when(~name.startswith("#"), F.lit(None).cast("long")).when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10).cast("long")).otherwise(F.substring(name, 2, 7).try_cast("long"))
        return F.struct(x["p"].alias("p"), name.alias("name"), code.alias("code"), F.when(name != "", F.try_element_at(values, name)).alias("known"))

    def tail(x: Column) -> Column:
        code = x["code"]
        none = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        number = F.when(code.isNull(), F.lit(None).cast("string")).when(none, F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        rest = F.substr(x["p"], F.length(x["name"]) + 2)
        return F.when(x["known"].isNotNull(), F.concat(x["known"], rest)).when(code.isNotNull(), F.concat(number, rest)).otherwise(F.concat(F.lit("&"), x["p"]))

    parts = F.split(c, "&")
    pieces = F.transform(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), named), numbered)
    whole = F.concat(parts[0], F.array_join(F.transform(pieces, tail), ""))
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


#: What is not visible: scripts, styles, the head, comments, tags. A tag may have quoted values with any character in them; one whose quotes don't match ends at its first angle bracket.
INVISIBLE = (r"(?s)<script[^>]*>.*?</script>", r"(?s)<style[^>]*>.*?</style>", r"(?s)<head[^>]*>.*?</head>", r"(?s)<!--.*?-->", r"""<[a-zA-Z/!?](?:[^>"']|"[^"]*"|'[^']*')*>""", r"<[a-zA-Z/!?][^>]*>")


def html_text(c: Column) -> Column:
    """Visible text of a page's body: no scripts, styles, comments or tags, references decoded, white space as one space."""
    for pattern in INVISIBLE:
        c = F.regexp_replace(c, pattern.replace("""[^>"']|""", """[^>"']++|""").replace(")*>", ")*+>"), " ")  # without going back, and so without a deep stack
    return F.trim(F.regexp_replace(decoded(c), "[ \t\r\n]+", " "))


def html_title(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)<title>(.*?)</title>", 1)


def summary(c: Column, n: int = 10) -> Column:
    """A deterministic stand-in for a summariser: a text's first and last n words, each once."""
    w = words(c)
    return F.array_join(F.concat(F.slice(w, 1, n), F.slice(w, F.greatest(F.lit(n + 1), F.size(w) - (n - 1)), n)), " ")


def strip_fence(c: Column) -> Column:
    """The inside of a fenced block: without the opening ```markdown and the closing ```."""
    inner = F.regexp_replace(c, r"(?s)^```(?:markdown)?\n(.*)```$", "$1")
    return F.when(c.startswith("```"), inner).otherwise(c)


def tagged(c: Column, tag: str) -> Column:
    """The contents of all <tag>...</tag> in a text, in order."""
    return F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def without_nul(c: Column) -> Column:
    return F.translate(c, "\0", "")


def mask_secret(c: Column, keep: int = 4) -> Column:
    """All but the first characters hidden."""
    return F.concat(F.substring(c, 1, keep), F.repeat(F.lit("*"), F.greatest(F.length(c) - keep, F.lit(0))))
