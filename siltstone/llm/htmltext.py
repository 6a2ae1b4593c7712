"""Operator 8: main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass classifies each block by itself: what lies in a menu,
header, footer, sidebar, notice, advert, form or comment section is out; link density, length and stop-word density make
other blocks good, bad, or leave them open (near or short).  In the second pass an open block inherits the label of its
nearest decided neighbours.  What the tags say is one input: it rules out what is certainly outside, and within an article
it moves the limits (LIMITS); a page without any such tags is judged by its text alone.
The text of math is kept; elements in DROPPED, and options, are left out whole.

Defined results: a null or empty html gives an empty text; a page cut off anywhere, unclosed tags and stray markup are
read as far as they go; a row comes back for every row, repeats included; other columns are not read, so clashing names do
no harm; an empty table gives no rows.  A page and its blocks are held in memory while it is read, a few times its size.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 70  # characters
STOP_HIGH = 0.15  # share of words


class Limits(NamedTuple):
    links: float  # share of characters in links, above which a block is bad
    least_linked: int  # characters of a block that may be bad for that
    long: int  # characters above which a block of many stop words is good
    stop_low: float  # share of stop words, below which a block is bad


#: Of blocks of unknown place, and of those in an article: there a paragraph may be mostly a link, or without stop words.
LIMITS = (Limits(0.4, 0, 200, 0.08), Limits(0.8, 21, 0, 0.0))

#: Function words of English, German, French and Spanish.
STOP = frozenset(
    """the of and to in is that it was for on are as with his they be at this have from or had by not but what all were when we there
    can an your which their if do will each about how up out them then she many some so these would into has more her him no
    you he i a der die das und ist in zu den von mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird
    bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde dem
    le la les de du des un une et est en que qui dans pour pas par sur au aux avec ce il elle sont plus ne se son sa ses ou mais comme
    el los las y del al lo que se por con una su para es no como más o pero sus le ya este sí porque esta entre cuando muy sin sobre""".split()
)
#: Elements without readable text, block-level elements, and containers that hold no article.
DROPPED = "script style noscript template iframe svg object canvas audio video textarea select button title".split()
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main blockquote pre figure figcaption header footer nav aside form fieldset legend address hr details summary body html head center menu dialog".split())
CONTAINERS = frozenset("div section article main header footer nav aside form ul ol dl table td th li blockquote figure details menu dialog fieldset body".split())
OUTSIDE = frozenset("nav footer aside form menu dialog".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|promo\w*|sponsor\w*|cookies?|consent|notices?|gdpr|pop-?up|modal|overlay|newsletters?|subscri\w+|side-?bar\w*|widgets?|menus?|nav\w*|breadcrumbs?"
    r"|paginat\w*|pager|shar(?:e|ing)\w*|social\w*|related\w*|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|footer\w*|header\w*|masthead|copyright|legal|log-?in|sign-?up|search\w*|toolbar|tags?-?cloud|skip-?links?|alert|disclaimer|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)(?:-?(?:body|content|text))?(?:$|[\s_-])", re.I)
_ROLE_BAD = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_END = r"(?=[\s/>])"  # of a tag's name: <svg-icon> is no svg
_QUOTED = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
#: An option's end tag may be left out: it ends at the next option, the end of its list, or a block.
_OPTION = rf"<(option){_END}[^>]*+>(?:[^<]++|<(?!/?(?:option|optgroup|select|datalist|" + "|".join(sorted(BLOCKS)) + rf"){_END}))*+(?:</option{_END}[^>]*+>)?"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<svg{_END}{_QUOTED}(?<=/)>|<(" + "|".join(DROPPED) + rf"){_END}[^>]*+>.*?(?:</\1{_END}[^>]*+>|$)|{_OPTION}"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*+>|</?[a-zA-Z][^>]*+$""",
    re.I | re.S,
)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters within links
    place: int  # -1 outside any article, 0 unknown, the number of its article otherwise
    label: str = ""
    open: bool = False  # after the first pass


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw else {}


def _kind(tag: str, raw: str, inside: bool) -> str:
    """bad, good or nothing, of a container by its own tag and attributes."""
    a = _attributes(raw) if "=" in raw else {}
    role = a.get("role", "").lower()
    name = f"{a.get('class', '')} {a.get('id', '')}".strip()
    hidden = re.search(r"(?:^|\s)hidden(?:\s|$)", raw, re.I) and "hidden" not in name or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I)
    if tag in OUTSIDE or role in _ROLE_BAD or hidden:
        return "bad"
    if tag in ("article", "main") or role in ("main", "article"):
        return "bad" if name and re.search(r"(?:^|[\s_-])comment", name, re.I) else "good"
    if tag == "header":
        return "" if inside else "bad"
    if name and tag != "body":
        if _BAD.search(name):
            return "bad"
        if _GOOD.search(name):
            return "good"
    return ""


def blocks(page: str) -> list[Block]:
    """The page's blocks that have a text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # tag, place of what it holds
    parts: list[str] = []
    links = linked = articles = breaks = 0

    def end() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, linked, stack[-1][1] if stack else 0))
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked, breaks
        parts.append(text)
        if text.strip():
            breaks = 0
            linked += len(text) if links else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[4] or m[7] or "").lower()
        if not tag:
            if m[2] or m[1] and m[1].lower() == "title":
                end()
            elif m[0].startswith("</") or m[1]:
                parts.append(" " if m[1] else "")
            continue
        closing, raw = bool(m[3] or m[6]), m[5] or m[8] or ""
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                end()
            continue
        if tag not in BLOCKS:
            if tag in ("img", "input", "wbr") and tag != "wbr":
                parts.append(" ")
            continue
        end()
        breaks = 0
        if tag not in CONTAINERS:
            continue
        links = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif not raw.endswith("/"):
            here = stack[-1][1] if stack else 0
            if tag in ("li", "td", "th") and stack and stack[-1][0] == tag:
                stack.pop()  # its end tag may be left out
                here = stack[-1][1] if stack else 0
            kind = _kind(tag, raw, here > 0) if here >= 0 else ""
            if kind == "good" and here == 0:
                articles += 1
                here = articles
            stack.append((tag, -1 if kind == "bad" else here))
    if at < len(page):
        say(page[at:])
    end()
    return out


def first_pass(b: Block) -> str:
    """good, bad, or open: short, or near to good.  What lies outside is bad; else link density, length and stop-word density
    decide, and whether the block lies in an article only moves the limits."""
    if b.place < 0:
        return "bad"
    n, limits = len(b.text), LIMITS[b.place > 0]
    dense = b.linked / max(1, n)
    if dense > limits.links and n >= limits.least_linked or b.text[0] == "©" and not b.place:
        return "bad"
    if n < SHORT:
        return "short"
    words = [w.lower() for w in _WORD.findall(b.text)]
    stop = sum(w in STOP for w in words) / max(1, len(words))
    if stop >= STOP_HIGH:
        return "good" if n > limits.long else "near"
    return "near" if stop >= limits.stop_low else "bad"


def classify(found: list[Block]) -> None:
    """Both passes.  An open block takes the label of its nearest decided neighbours, in an article those within it; where
    they differ, or there are none, it is good if it is near to good or lies in an article."""
    first = [first_pass(b) for b in found]
    for k, b in enumerate(found):
        b.open = first[k] not in ("good", "bad")
    before, after = _nearest(found, first, range(len(found))), _nearest(found, first, range(len(found) - 1, -1, -1))
    for k, b in enumerate(found):
        sides = {before[k], after[k]} - {""}
        b.label = first[k] if not b.open else sides.pop() if len(sides) == 1 else "good" if b.place or first[k] == "near" else "bad"


def _nearest(found: list[Block], first: list[str], order: range) -> list[str]:
    """Of each block the label of the nearest decided one before it in this order, in one pass.  An article's blocks don't
    ask beyond it; others ask the first block beyond theirs, if it is decided, and no further."""
    out, last, edge, place = [""] * len(found), "", "", None
    for k in order:
        if found[k].place != place:
            edge = first[k - order.step] if place is not None and first[k - order.step] in ("good", "bad") else ""
            place, last = found[k].place, ""
        out[k] = last or ("" if place else edge)
        if first[k] in ("good", "bad"):
            last = first[k]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")
