"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Scripts, styles, comments and the head are no text. For each block the reader
notes its length, its share of stop words, the share of its characters inside links, whether it is in a part that is named as
furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) and which main part it is in.

A name of a class or id is a vote, not a veto: it counts for nothing where its element is or holds the page's first main part, holds
the first heading together with running text, or, on a page with neither main part nor such a heading, most of the running text.
Where a page has next to no stop words of the languages known here, length alone says what is running text.

Pass one: furniture and blocks mostly of links are out; a long block of running text is in, and so is a long block of a main
part; other blocks are undecided. Pass two: an undecided block takes the label of its nearest decided neighbours in its own
part. Where they differ, a block with stop words is in and others are out; where there are none, the part decides: main parts
are in. A page with a main part keeps nothing from outside it.

Defined results: null or empty pages have empty text; a page without any kept block has empty text; unclosed and unknown tags,
comments and pages cut off anywhere are read as far as they go; no length is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import small_batches

# Elements by what they do to text.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form head header html li main menu nav ol section table td th tr ul a button label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset head label".split())
MAIN = frozenset("article main".split())
# First parts of names that say how a page is laid out, such as has-sidebar; these mark nothing.
LAYOUT = frozenset("has have hide hides is no not show shows with without".split())
# Names of classes, ids and roles that mark furniture; a name counts as a whole or between hyphens and underscores.
NAMES = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer header menu menubar modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
# Frequent words of English, German, French and Spanish.
STOP = frozenset("""
a an and are as at be been but by can did do for from had has have he her his i if in into is it its no not of on one or our she so than that the their them then there they this to was we were what when which who will with would you
aber als am an auch auf aus bei bin bis da das dass dem den der des die dich du durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann man mein mich mir mit nach nicht noch nur ob oder sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et eux il je la le les leur lui ma mais me même mes mon ne nos nous on ou où par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos vous
al algo como con de del desde donde e el ella en entre era es esa ese esta este fue ha hasta hay la las le lo los más me mi muy nos o para pero por porque que quien se si sin sobre su sus también te tiene un una y ya yo
""".split())

LONG, SHORT = 140, 40
STOPS, LINKS, FOREIGN = 0.25, 0.5, 0.05

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    furniture: bool
    part: int  #: number of the main part that it is in, or 0
    named: tuple[int, ...] = ()  #: elements named as furniture that it is in
    heading: bool = False  #: whether it is the first heading


@dataclass(slots=True)
class _Open:
    tag: str
    furniture: bool
    part: int
    link: bool
    named: tuple[int, ...] = ()


def _named_furniture(attributes: str) -> bool:
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[-_]", name)
            if name in NAMES or (parts[0] not in LAYOUT and any(p in NAMES for p in parts)):
                return True
    return False


def _ends_itself(tag: str, attributes: str) -> bool:
    """Only drawings and formulas are over at a slash before the tag's end, unless the slash is a value's."""
    return tag in ("svg", "math") and re.search(r"(?:^|[\s\"'])/$", attributes) is not None


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [_Open("", False, 0, False)]
    pieces: list[str] = []
    linked: list[str] = []
    parts, breaks, names, heading = 0, 0, 0, 0
    main_names: tuple[int, ...] = ()  # around the first main part
    opened: dict[str, int] = {}  # open elements by tag: a closing tag without one says nothing

    def flush() -> None:
        nonlocal breaks, heading
        breaks = 0
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, len(" ".join("".join(linked).split())), stack[-1].furniture, stack[-1].part, stack[-1].named, heading == 1))
                heading *= 2
            pieces.clear()
            linked.clear()

    def say(raw: str) -> None:
        nonlocal breaks
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if stack[-1].link:
            linked.append(text)
        if breaks and not text.isspace():
            breaks = 0

    at = 0
    while at < len(page):
        low = page.find("<", at)
        if low < 0:
            say(page[at:])
            break
        if low > at:
            say(page[at:low])
        m = _TOKEN.match(page, low)
        if m is None:
            say("<")
            at = low + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag, close = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not close and not _ends_itself(tag, m[3]):
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            say(" ")
            breaks += 1
            if breaks > 1:
                flush()
            continue
        if tag in BLOCKS:
            flush()
        if tag == "h1" and not close and not heading:
            heading = 1
        if tag in VOID or tag not in CONTAINERS:
            continue
        if close:
            while opened.get(tag):
                gone = stack.pop().tag
                opened[gone] -= 1
                if gone == tag:
                    break
        else:
            top = stack[-1]
            if tag == "body":
                del stack[1:]
                opened.clear()
                top = stack[0]
            part, named = top.part, top.named
            if tag != "body" and _named_furniture(m[3]):
                names += 1
                named = (*named, names)
            opened[tag] = opened.get(tag, 0) + 1
            if tag in MAIN or re.search(r"\brole\s*=\s*[\"']?main\b", m[3], re.I):
                if not part:
                    parts += 1
                    part = parts
                    if parts == 1:
                        main_names = named
            elif not part and tag == "header":
                stack.append(_Open(tag, True, part, False, named))
                continue
            stack.append(_Open(tag, top.furniture or tag in FURNITURE, part, top.link or tag == "a", named))
    flush()
    return _voted(out, main_names)


def _voted(found: list[Block], main_names: tuple[int, ...]) -> list[Block]:
    """The blocks, furniture by name where that name counts."""
    running: dict[int, int] = {}
    total, titled = 0, set()
    for b in found:
        size = len(b.text) if not b.furniture and len(b.text) >= LONG and b.linked <= LINKS * len(b.text) else 0
        total += size
        for n in b.named:
            running[n] = running.get(n, 0) + size
            if b.heading:
                titled.add(n)
    void = set(main_names) | {n for n in titled if running[n]}
    if not void and not any(b.part and not b.furniture for b in found):
        void = {n for n, size in running.items() if 2 * size > total}
    for b in found:
        b.furniture = b.furniture or any(n not in void for n in b.named)
    return found


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    main = any(b.part and not b.furniture for b in found)
    first: list[bool | None] = []
    counts = [(sum(w in STOP for w in words), len(words)) for words in (_WORDS.findall(b.text.lower()) for b in found)]
    stops = [n / of if of else 0.0 for n, of in counts]
    long = [c for b, c in zip(found, counts, strict=True) if len(b.text) >= LONG and not b.furniture and b.linked <= LINKS * len(b.text)]
    foreign = sum(n for n, _ in long) < FOREIGN * max(1, sum(of for _, of in long))
    for b, share in zip(found, stops, strict=True):
        if b.furniture or (main and not b.part) or b.linked > LINKS * len(b.text):
            first.append(False)
        elif len(b.text) >= LONG and (b.part or foreign or share >= STOPS):
            first.append(True)
        elif len(b.text) >= LONG and not b.part:
            first.append(False if share < STOPS / 2 else None)
        else:
            first.append(None)
    before: list[bool | None] = []
    seen: dict[int, bool] = {}
    for b, x in zip(found, first, strict=True):
        before.append(seen.get(b.part))
        if x is not None and not b.furniture and not (b.part and not x):  # furniture says nothing of its neighbours
            seen[b.part] = x
    after: list[bool | None] = [None] * len(found)
    seen = {}
    for i in range(len(found) - 1, -1, -1):
        after[i] = seen.get(found[i].part)
        if first[i] is not None and not found[i].furniture and not (found[i].part and not first[i]):
            seen[found[i].part] = bool(first[i])
    out = []
    for b, x, s, p, n in zip(found, first, stops, before, after, strict=True):
        if x is None:
            near = {y for y in (p, n) if y is not None}
            x = near.pop() if len(near) == 1 else bool(b.part) if not near else s >= STOPS and len(b.text) >= SHORT
        out.append(x)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of each row."""
    small_batches(pages.sparkSession)
    rows = pages.select(id_col, url_col, F.col(html_col).alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], [*b.schema.names[:2], "text"])

    return rows.mapInArrow(run, f"{kinds}, text string")
