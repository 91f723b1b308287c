"""Main text of web pages by two passes of block rules.

The markup is read once into blocks: runs of text between block-level tags, with their words, how much of them is link
text, and the containers they lie in.  The first pass decides blocks that are clear by container, link density, length
and the density of stop words.  The second gives each undecided block the label of its nearest decided neighbours, in
the same article first.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.llm.common import inward, outward, place, table

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
MAX_LINKS, MAX_LINKS_IN_ARTICLE = 0.2, 0.6

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all an and any are as at be been but by can do for from had has have he her his i if in into is it its
    more my no not of on one or our out she so some than that the their them then there they this to up was we were what
    when which who will with would you your
    aber als am auch auf aus bei bis da das dem den der des die doch durch ein eine einem einen einer er es für hat ich
    im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war wenn werden wie
    wird wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas
    plus pour qu que qui sa se ses son sont sur un une vous
    al como con de del donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no o para pero
    por que se ser si sin sobre son su sus también un una y ya
    """.split()
)

# Tags that end a block; tags without content; tags whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("audio button canvas datalist head iframe noscript object script select style svg template textarea title video math map".split())
#: Of those, the ones whose content is not markup, so that only their end tag ends them.
RAW_TAGS = frozenset("iframe noscript script style textarea title".split())
BAD_TAGS = frozenset("aside dialog footer form menu nav".split())
ARTICLE_TAGS = frozenset(("article", "main"))
# Words in class, id, role or itemprop that name an article.
ARTICLE_WORDS = frozenset(("article", "post", "entry", "story", "main"))
# Words in class, id or role that name a part which is not the article.
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies"
    " copyright disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted"
    " related replies reply respond search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Those that are bad only outside an article, where they may hold its title.
PAGE_HEAD = frozenset("header masthead topbar".split())

_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_COMMENT_END = re.compile(r"--!?>")
_SPECIAL = re.compile("[>\"']")
#: Numeric references of more digits than any letter has.
_LONG_NUMBER = re.compile(r"&#(?:([xX])0*([0-9a-fA-F]*)|0*([0-9]*));?")
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|itemprop|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link: int
    container: int
    bad: bool
    article: bool
    heading: bool


@dataclass
class _Open:
    tag: str
    bad: bool
    skip: bool
    link: bool
    article: int


def _own(attributes: str) -> tuple[set[str], bool]:
    """The words of class, id, role and itemprop, and whether the element is hidden."""
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hidden = True
        elif name in ("class", "id", "role", "itemprop"):
            words.update(w.lower() for w in _NAME_PARTS.findall(value))
    return words, hidden


class _TagEnds:
    """Where tags end: at the first > outside of quotes, or, if a quote is not closed, at the first > at all.

    Every place is looked at once, however many tags begin before it, so a page without ends costs no more than its length.
    """

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def __call__(self, at: int) -> int:
        """The place of the >, or -1 if there is none from ``at`` on."""
        page, seen, to = self.page, [], -1
        k = at
        while m := _SPECIAL.search(page, k):
            k = m.start()
            if k in self.known:
                to = self.known[k]
                break
            seen.append(k)
            if page[k] == ">":
                to = k
                break
            k = page.find(page[k], k + 1) + 1
            if not k:
                break
        self.known.update(dict.fromkeys(seen, to))
        return to if to >= 0 else page.find(">", at)


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" of an end tag, name, attributes); comments and declarations have no name.

    The caller may send a place to go on from.
    """
    ends, last, at = _TagEnds(page), page.rfind(">"), 0
    while m := _START.search(page, at):
        start, after = m.start(), m.end()
        if m[1]:
            # A comment ends at -->, at --!>, or, if it is empty, at > or ->; an open one ends with the page.
            short = next((s for s in (">", "->") if page.startswith(s, after)), "")
            end = _COMMENT_END.search(page, after)
            at = after + len(short) if short else end.end() if end else len(page)
            name = attributes = ""
        elif after > last:
            at = page.find("<!--", start + 1)  # nothing closes what begins here; an open comment may follow
            if at < 0:
                return
            continue
        elif m[2]:
            at, name, attributes = page.find(">", after) + 1, "", ""
        else:
            at = ends(after) + 1
            name, attributes = m[4].lower(), page[after : at - 1]
        on = yield start, at, m[3] or "", name, attributes
        at = at if on is None else on


def _unescaped(text: str) -> str:
    if "&#" in text:
        text = _LONG_NUMBER.sub(lambda m: "\ufffd" if len(m[2] or m[3] or "") > 8 else f"&#{m[1] or ''}{m[2] or m[3] or '0'};" if m[2] or m[3] else m[0], text)
    return html.unescape(text)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; those that are never text (head, scripts, styles, form fields) are left out."""
    page = page or ""
    out: list[Block] = []
    stack = [_Open("", False, False, False, 0)]
    open_at: dict[str, list[int]] = defaultdict(list)  # where in the stack the tags of a name are
    parts: list[tuple[str, bool]] = []
    heading = False
    articles = at = 0

    def close() -> None:
        nonlocal parts
        if parts:
            words = " ".join("".join(t for t, _ in parts).split())
            if words:
                top = stack[-1]
                link = sum(len("".join(t.split())) for t, is_link in parts if is_link)
                out.append(Block(words, link, top.article, top.bad, top.article > 0, heading))
            parts = []

    def text(to: int) -> None:
        if to > at and not stack[-1].skip:
            parts.append((_unescaped(page[at:to]), stack[-1].link))

    def cut(depth: int) -> None:
        while len(stack) > depth:
            open_at[stack.pop().tag].pop()

    found = _tags(page)
    on = None
    while True:
        try:
            start, end, ends, tag, attributes = found.send(on)
        except StopIteration:
            break
        on = None
        text(start)
        at = end
        if not tag:
            continue
        if ends:
            if tag in BLOCK_TAGS:
                close()
            elif tag in ("td", "th"):
                parts.append((" ", False))
            if open_at[tag]:
                cut(open_at[tag][-1])
            continue
        if tag in BLOCK_TAGS:
            close()
            heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
            # A new block ends an open paragraph, and a new item an open item.
            if stack[-1].tag == "p" or tag == stack[-1].tag == "li":
                cut(len(stack) - 1)
        elif tag in ("br", "td", "th"):
            parts.append((" ", False))
        if tag in VOID_TAGS:
            continue
        top = stack[-1]
        words, hidden = _own(attributes) if attributes else (set(), False)
        root = tag in ("body", "html", "article", "main")
        article = top.article
        if not article and (tag in ARTICLE_TAGS or tag in BLOCK_TAGS and not root and words & ARTICLE_WORDS and not words & BAD_WORDS):
            articles += 1
            article = articles
        bad = top.bad or tag in BAD_TAGS or (tag == "header" and not top.article) or hidden
        bad = bad or not root and bool(words & BAD_WORDS or not top.article and words & PAGE_HEAD)
        if tag in RAW_TAGS:
            end_tag = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = on = page.find(">", end_tag.end()) + 1 or len(page) if end_tag else len(page)
            continue
        open_at[tag].append(len(stack))
        stack.append(_Open(tag, bad, top.skip or tag in SKIPPED_TAGS, tag == "a" or top.link and tag not in BLOCK_TAGS, article))
    text(len(page))
    close()
    return out


def first_pass(b: Block) -> tuple[str, bool]:
    """good, bad or open; and whether an open one leans to good."""
    links = b.link / max(1, len("".join(b.text.split())))
    if b.bad or links > (MAX_LINKS_IN_ARTICLE if b.article else MAX_LINKS):
        return "bad", False
    if not b.article and ("©" in b.text or "&copy" in b.text):
        return "bad", False
    words = [w.lower() for w in _WORD.findall(b.text)]
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if len(b.text) < SHORT or b.heading:
        return "open", density >= STOP_LOW
    if density >= STOP_HIGH:
        return ("good", True) if len(b.text) > LONG or b.article else ("open", True)
    if density >= STOP_LOW or b.article:
        return "open", True
    return "bad", False


def second_pass(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    firsts = [first_pass(b) for b in found]
    n = len(found)
    # The nearest decided block before and after each, of all blocks and of those of the same article that its container does not make bad.
    sides = []
    for order in (range(n), range(n - 1, -1, -1)):
        any_, own = [None] * n, [None] * n
        last = mine = run = None
        for k in order:
            if found[k].container != run:
                run, mine = found[k].container, None
            any_[k], own[k] = last, mine
            if firsts[k][0] != "open":
                last = k
                mine = mine if found[k].bad else k
        sides.append((any_, own))
    (left, left_own), (right, right_own) = sides
    keep = []
    for k, (b, (label, leans)) in enumerate(zip(found, firsts)):
        if label != "open":
            keep.append(label == "good")
            continue
        if b.article:
            # In an article: the nearest decided block of it; good if there is none.
            near = [(abs(j - k), firsts[j][0]) for j in (left_own[k], right_own[k]) if j is not None]
            keep.append(min(near)[1] == "good" if near else True)
            continue
        a, c = (firsts[j][0] if j is not None else "bad" for j in (left[k], right[k]))
        if a == c:
            keep.append(a == "good")
        else:
            da = k - left[k] if left[k] is not None else k + 1
            dc = right[k] - k if right[k] is not None else n - k
            nearer = a if da < dc else c if dc < da else "tie"
            # A heading goes with the text below it.
            keep.append(leans if nearer == "tie" else nearer == "good" or b.heading and c == "good")
    return keep


def main_text(page: str | None) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, second_pass(found)) if good)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` and ``n_chars`` added, which replace columns of those names.

    A null or empty page, and one without main text, gives an empty text.  Whole pages are read, in time that grows with
    their length; unclosed comments and scripts end with the page, and a tag that nothing closes is text.  Repeated
    rows get equal texts; an empty table gives no rows; other columns pass through, whatever their names.
    """
    inner = inward(pages)
    schema = T.StructType([*inner.schema.fields, T.StructField("text", T.StringType())])
    at = inner.columns.index(place(pages, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([main_text(t) for t in b.column(at).to_pylist()], pa.string())], names=schema.names)

    out = inner.mapInArrow(run, schema).withColumnRenamed("text", text_col).withColumn("n_chars", F.char_length(text_col).cast("long"))
    return outward(out, pages, (text_col, "n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
