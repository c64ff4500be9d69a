"""Main text of web pages by consensus host paths.

Each page scores its containers and votes for their generalised paths (tags with classes, without ids and numbers);
votes are summed for each host in Spark; each page is then extracted again from the elements at its host's winning
path, or from its own best container where it has none there. A path is known by a hash of its tags and classes.

Left out are elements that are never main text by their tag (menus, asides, footers; headers outside the article and
outside containers that are named as one), and block containers whose class, role or id is made of words for such parts
alone: "cookie-notice" is, "subscriber-content" and "related-work" aren't. Inside an article ids are slugs of its headings,
and only those of reader comments count; so do words that articles use of their own parts ("discussion", "responses",
"dialog") only beside words for readers. Paragraphs, list items and spans go where they are named as adverts, notices,
invitations to subscribe or share, or comments; headings and cells never go by a name. A form goes, unless it only
wraps the page: it holds an article, or most of the page's text and far more text than controls. Scripts, styles,
comments and what browsers don't show of embedded elements are markup.

Null html is empty and gives an empty text; a null or odd url belongs to the host ''. Rows repeat as they are given,
ties between paths go to the greater hash, null page_ids are kept, other columns are not read; an empty table gives an
empty result. Time is linear in a page's length, however deep its elements are nested or its tags left open.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import small_side, table, trimmed

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)|<xmp\b[^>]*>(.*?)(?:</xmp\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr pre blockquote figure figcaption header footer nav aside form fieldset address details summary hr center xmp".split()
)
SCOPE = frozenset("ul ol dl table article section div body html main aside nav td th blockquote".split())
#: Elements that end an open one of their kind in the same scope: which kind they are of.
KIND = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "option": 5}
CONTAINER = frozenset("html body main article section div td blockquote center".split())
#: Elements that are never main text, and block containers that may be left out by their names.
OUT_TAGS = frozenset("nav aside footer head button dialog menu template select canvas audio video datalist".split())
NAMED = frozenset("div section ul ol dl table header figure fieldset details center".split())
#: Elements that may be left out by names of adverts and the like, and the words of these.
SMALL = frozenset("p li span dt dd small".split())
SMALL_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices newsletter newsletters
    subscribe subscription signup popup popups share sharing sharebar comment comments disqus""".split()
)
#: Words that articles use of parts of their own, and words beside which they are about readers.
OWN_WORDS = frozenset("discussion discussions responses dialog".split())
OF_READERS = frozenset("reader readers user users thread".split())
#: Containers that are named as an article, whose headers hold its title.
ARTICLE_WORDS, ARTICLE_NEUTRAL = frozenset("article post entry story".split()), frozenset("article post entry story content body single blog main text item full detail".split())
CONTROLS = frozenset("input select button".split())
#: A form wraps the page if it has this share of its text, and so many characters for each control that shows.
WRAPS, TEXT_OF_CONTROL = 0.5, 80
NEVER_OUT = frozenset("html body main article".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
#: Words for parts that are not main text, and words that may stand beside them in a name without making it another.
OUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adbox adslot adsense banner banners sponsor sponsors sponsored promo promos promotion promotions nav navi navbar navigation menu menus breadcrumb
    breadcrumbs footer footers sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter newsletters subscribe subscription
    signup login signin search searchbox share sharing sharebar social related recommended recommendations comment comments commentlist reply replies respond responses disqus discussion discussions pagination pager copyright
    masthead topbar toolbar skip skiplink dialog header""".split()
)
NEUTRAL_WORDS = frozenset(
    """site page main top bottom left right primary secondary global inner outer list lists box boxes area container wrapper wrap block section bar links link button buttons form posts post articles article entry entries items
    item slot unit group holder row col column content reader readers user media icons icon thread to us policy bg fixed sticky mobile desktop text info my the and container-fluid""".split()
)
#: A header's own name alone doesn't make it the page's; nor do these words beside it.
NOT_ALONE = frozenset("header".split())
COMMENT_IDS = frozenset("comments comment-list commentlist comments-area comments-section comment-section respond disqus disqus_thread reader-comments user-comments".split())
IN_WORDS = re.compile(r"(?:^|[^a-z])(?:article|post|entry|content|story|main|text|body)(?![a-z])")
BONUS = {"article": 3.0, "main": 2.0, "body": 0.6, "html": 0.5, "": 0.4}
_SPLIT = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])|(?<=\d)(?=\D)|(?<=\D)(?=\d)")
_OUT_NAMES: dict[tuple[str, bool], bool] = {}


def _words(name: str) -> list[str]:
    return [w.lower() for w in _SPLIT.split(name) if len(w) > 1 and not w.isdigit()]


def out_name(name: str, in_article: bool = False) -> bool:
    """Whether a class or an id is made of words for parts that are not main text, and neutral ones."""
    known = _OUT_NAMES.get((name, in_article))
    if known is None:
        if len(_OUT_NAMES) > 100_000:
            _OUT_NAMES.clear()
        parts = _words(name)
        telling = [w for w in parts if w in OUT_WORDS]
        known = bool(telling) and all(w in OUT_WORDS or w in NEUTRAL_WORDS for w in parts) and not (set(telling) <= NOT_ALONE and not set(parts) & {"site", "page", "main", "top", "global"})
        known = known and not (in_article and set(telling) <= OWN_WORDS and not set(parts) & OF_READERS)
        if len(name) <= 200:
            _OUT_NAMES[name, in_article] = known
    return known


def article_name(name: str) -> bool:
    parts = set(_words(name))
    return bool(parts & ARTICLE_WORDS) and parts <= ARTICLE_NEUTRAL


def small_name(name: str) -> bool:
    """Whether the class of a paragraph or the like is that of an advert, a notice, an invitation or a comment."""
    parts = _words(name)
    return any(w in SMALL_WORDS for w in parts) and all(w in SMALL_WORDS or w in NEUTRAL_WORDS for w in parts)


_ELEMENTS: dict[tuple[str, str], tuple[str, bool, bool, bool, bool]] = {}


def _known(name: str, attributes: str) -> tuple[str, bool, bool, bool, bool]:
    """(label, whether its names speak for main text, whether it is named as an article, left out outside an article, left out inside one) of an element. Pages repeat their elements, so these are kept."""
    known = _ELEMENTS.get((name, attributes))
    if known is None:
        said = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        classes, own = said.get("class", "").split(), said.get("id", "").strip()
        outside = inside = name not in NEVER_OUT and name in OUT_TAGS
        if said and name in NAMED:
            role = said.get("role", "").lower() in OUT_ROLES
            outside = outside or role or any(map(out_name, classes)) or bool(own) and out_name(own)
            inside = inside or role or any(out_name(c, True) for c in classes) or own.lower() in COMMENT_IDS
        elif said and name in SMALL:
            outside = inside = outside or any(map(small_name, classes))
        article = name in ("div", "section") and any(map(article_name, classes))
        label = ".".join([name, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes})])
        known = label, bool(said and IN_WORDS.search(" ".join(said.values()).lower())), article, outside, inside
        if len(attributes) <= 500:
            if len(_ELEMENTS) > 50_000:
                _ELEMENTS.clear()
            _ELEMENTS[name, attributes] = known
    return known


class Page:
    """Elements in page order (element 0 stands for the page) and the texts and block edges between them."""

    def __init__(self, html: str):
        self.tag, self.path, self.parent, self.out, self.end, self.good = [""], [0], [-1], [False], [0], [False]
        self.items: list[tuple[int, str | None]] = []  # (element, text), or None at a block's edge
        self.literal: set[int] = set()  # items whose references are not decoded
        self.forms: list[int] = []
        self.controls: list[int] = []  # the elements that controls stand in
        # Beside each open element: whether it lies in an article, whether in a container named as one, and the places of the open elements of each kind in its scope.
        self.stack, self.main, self.named, self.kinds, self.open = [0], [False], [False], [(0,) * 6], Counter()
        at, last = 0, html.rfind(">") + 1
        html = html[:last] + re.sub(r"<(?!!--)", "&lt;", html[last:])  # no tag ends there
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self.items.append((self.stack[-1], html[at : m.start()]))
            at = m.end()
            if m[2] is not None:
                self.items.append((self.stack[-1], None))
                self.literal.add(len(self.items))
                self.items += [(self.stack[-1], m[2]), (self.stack[-1], None)]
                continue
            name = m[4] or m[7]
            if not name:
                continue
            name = name.lower()
            if m[3] or m[6]:
                if self.open[name]:
                    k = len(self.stack) - 1
                    while self.tag[self.stack[k]] != name:
                        k -= 1
                    self._close(k)
                if name in BLOCK:
                    self.items.append((self.stack[-1], None))
            else:
                self._open(name, m[5] or m[8] or "")
        if at < len(html):
            self.items.append((self.stack[-1], html[at:]))
        self._close(1)
        self.end[0] = len(self.tag)
        if self.forms:
            self._leave_out_forms()

    def _close(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for i in self.stack[k:]:
            self.end[i] = len(self.tag)
            self.open[self.tag[i]] -= 1
        del self.stack[k:], self.main[k:], self.named[k:], self.kinds[k:]

    def _leave_out_forms(self) -> None:
        """Forms go, but for those that wrap the page."""
        n = len(self.tag)
        chars, controls, articles = [0] * n, [0] * n, [0] * n
        for i, text in self.items:
            if text and not self.out[i]:
                chars[i] += len(text.strip())
        for i in self.controls:
            controls[i] += 1
        for i, name in enumerate(self.tag):
            articles[i] = name in ("article", "main") and not self.out[i]
        before, shown, whole = ([0, *accumulate(x)] for x in (chars, controls, articles))
        for i in self.forms:
            within = lambda x, i=i: x[self.end[i]] - x[i]
            size = within(before)
            if not (within(whole) or size >= WRAPS * before[n] and size >= TEXT_OF_CONTROL * (within(shown) + 1)):
                self.out[i : self.end[i]] = [True] * (self.end[i] - i)

    def _ended(self, kind: int) -> None:
        if k := self.kinds[-1][kind]:
            block = self.tag[self.stack[k]] in BLOCK
            self._close(k)
            if block:
                self.items.append((self.stack[-1], None))

    def _open(self, name: str, attributes: str) -> None:
        kind = KIND.get(name)
        if name in CONTROLS and not (name == "input" and "hidden" in attributes.lower()):
            self.controls.append(self.stack[-1])
        if name in BLOCK:  # a block ends an open paragraph
            self._ended(0)
        if kind:
            self._ended(kind)
        if name in VOID or name not in BLOCK and attributes.endswith("/"):
            self.items.append((self.stack[-1], None if name == "hr" else " "))
            return
        top, in_main = self.stack[-1], self.main[-1]
        label, good, article, *out = _known(name, attributes)
        if name == "header" and not in_main and not self.named[-1]:
            out = [True, True]
        self.tag.append(name)
        self.path.append(xxhash.xxh64_intdigest(label, self.path[top]))
        self.parent.append(top)
        self.out.append(self.out[top] or out[in_main])
        self.good.append(good)
        self.end.append(0)
        place = len(self.stack)
        self.stack.append(len(self.tag) - 1)
        self.main.append(in_main or name in ("article", "main"))
        self.named.append(self.named[-1] or article)
        if name == "form" and not self.out[-1]:
            self.forms.append(len(self.tag) - 1)
        self.open[name] += 1
        kinds = self.kinds[-1]
        if name in SCOPE:
            kinds = (0, 0, 0, 0, kinds[4], 0) if name in ("td", "th") else (0,) * 6
        self.kinds.append(kinds if kind is None else (*kinds[:kind], place, *kinds[kind + 1 :]))
        if name in BLOCK:
            self.items.append((top, None))
        elif name in ("td", "th"):
            self.items.append((top, " "))

    def scores(self) -> list[tuple[float, int]]:
        """(score, element) of the containers with text, the best first; scores do not depend on the page's length."""
        n = len(self.tag)
        chars, linked, depth, in_link = [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + 1
            in_link[i] = in_link[self.parent[i]] or self.tag[i] == "a"
        for i, text in self.items:
            if text and not self.out[i]:
                size = len(text.strip())
                chars[i] += size
                if in_link[i]:
                    linked[i] += size
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
            linked[self.parent[i]] += linked[i]
        if not chars[0]:
            return []
        found = []
        for i in range(n):
            if chars[i] and not self.out[i] and (not i or self.tag[i] in CONTAINER):
                bonus = BONUS.get(self.tag[i], 1.0) * (1.5 if self.good[i] and self.tag[i] not in ("body", "html") else 1)
                found.append((chars[i] / chars[0] * (1 - linked[i] / chars[i]) * bonus * (1 + min(depth[i], 50) / 500), i))
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def votes(self) -> dict[int, int]:
        """The whole score of each path that has a container with text: that of its best one."""
        out: dict[int, int] = {}
        for s, i in self.scores():
            out.setdefault(self.path[i], round(s * 1000))
        return out

    def at_path(self, path: int) -> list[int]:
        """The elements at the path, without those inside another one or left out."""
        found, skip = [], 0
        for i in range(len(self.tag)):
            if self.path[i] == path and i >= skip and not self.out[i]:
                found.append(i)
                skip = self.end[i]
        return found

    def text(self, elements: list[int]) -> str:
        """Blocks of the elements' texts, joined by one line feed."""
        blocks, block = [], []
        inside = bytearray(len(self.tag))
        for i in elements:
            inside[i : self.end[i]] = b"\1" * (self.end[i] - i)
        for k, (i, text) in enumerate([*self.items, (0, None)]):
            if text is None or not inside[i]:
                if block and (words := "".join(block).split()):
                    blocks.append(" ".join(words))
                block = []
            elif not self.out[i]:
                block.append(entities.unescape(text) if "&" in text and k not in self.literal else text)
        return "\n".join(blocks)


def main_text(html: str, path: int | None) -> str:
    """The text at the path, or in the page's own best container."""
    page = Page(html)
    elements = (page.at_path(path) if path is not None else []) or [i for _, i in page.scores()[:1]]
    return page.text(elements) if elements else ""


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter[tuple[str, int]] = Counter()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            for path, score in Page(html.as_py()).votes().items():
                total[host, path] += score
        yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in total], pa.string()), "path": pa.array([_signed(p) for _, p in total], pa.int64()), "score": pa.array(list(total.values()), pa.int64())})


def _signed(path: int) -> int:
    return path - (path >> 63 << 64)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py(), None if p is None else p % (1 << 64)) for h, p in zip(batch.column("html"), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()), "path": batch.column("path")})


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and the path that its pages' votes make the winner. Votes are summed in each task before they move."""
    votes = with_host(pages).select("host", "html").mapInArrow(trimmed(_vote), "host string, path long, score long")
    return votes.groupBy("host", "path").agg(F.sum("score").alias("score")).groupBy("host").agg(F.max(F.struct("score", "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path that was used."""
    from millrace.llm.common import written

    winners = small_side(written(host_paths(pages), "host-paths"))
    return with_host(pages).join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(trimmed(_extract), "page_id long, url string, text string, n_chars long, path long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
