"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, and every line weighs as much as it has characters of text
outside links. What a page says about itself changes that: lines in a script, style, head, menu, header, footer, sidebar,
form, advert, notice or comment section weigh nothing; if there is an article or main element, lines outside weigh a tenth, and
nothing if that is below ``SURGE``. Lines of links alone weigh nothing, but in an article or main element
they weigh their text where they are paragraphs or headings or fewer than a window of them stand together.
Weights are summed over sliding windows of three lines. Text surges where a window reaches ``SURGE``, in an article or
main element ``RESUME``; it starts with the weighty lines right before that and dives where a whole window
weighs nothing, there as elsewhere. The weighty lines between are the main text, without a copyright line at its end.

Defined cases: a null or empty page has empty text; unclosed elements end with their parent; a page whose
windows never reach ``SURGE`` surges at its heaviest window, all windows of that weight alike, and an article at
a quarter of that. A null page id stays null. Markup without an end is text; the work is linear in the page. Character
references are decoded; white space in a block becomes one space. Other columns stay untouched.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
RESUME = 20
OUTSIDE = 0.1
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
RAW = ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog script style textarea noscript template iframe svg title object canvas".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Words of class or id that name what is no main text, and words that may stand beside them in one token.
ASIDE = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
BESIDE = frozenset("area bar block body bottom box buttons container form global group holder inner item items left links list main middle outer page primary right secondary section site slot top unit wrap wrapper".split())
#: Words that make a name of what readers and advertisers add, and whose it is or where it stands.
ADDED = frozenset("ad ads advert advertisement comment comments popup promo promoted related replies reply respond responses share sharing social sponsor sponsored subscribe newsletter widget".split())
OWNERS = frozenset("all article articles entry latest post posts reader readers recent stories story user users".split())
#: Elements whose links are text and no menu.
PROSE = HEADINGS | {"p", "blockquote", "figcaption", "pre"}
COPYRIGHT = re.compile(r"(?:\u00a9|\(c\)|copyright)(?:\s*(?:\u00a9|\(c\)))?\s*\d{4}\b", re.I)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())


def _names_aside(token: str) -> bool:
    parts = set(re.findall(r"[a-z]+", token))
    plain = bool(parts & ASIDE) and parts <= ASIDE | BESIDE
    return plain or token == "responses" or bool(parts & ADDED) and parts <= ADDED | BESIDE | OWNERS


def _aside(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_main:
        return True
    if tag in MAIN or tag in HEADINGS and inside_main:  # what they are called is no stronger evidence than what they are
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        tokens = (a or b or c).lower().split()
        if any(t in ROLES if name.lower() == "role" else _names_aside(t) for t in tokens):
            return True
    return False


def markup(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """Text and the tag that follows it, in order: (text, tag or "", closing, attributes); comments are left out."""
    at, last, quoted = 0, page.rfind(">"), True
    text_from, parts = 0, []
    while (at := page.find("<", at)) >= 0 and at <= last:
        end = -1
        if page.startswith("<!--", at):
            end, m = page.find("-->", at + 4), None
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end, m = page.find("]]>", at), None
            end = len(page) if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            end, m = page.find(">", at) + 1, None
        elif m := TAG.match(page, at):
            place = m.end()
            while quoted:
                stop = STOP.search(page, place)
                if stop is None:
                    quoted = False  # a quote that is never closed: from here on tags end at the next >
                elif stop[0] == ">":
                    end = stop.end()
                    break
                elif (place := page.find(stop[0], stop.end()) + 1) == 0:
                    quoted = False
            if end < 0:
                end = page.find(">", m.end()) + 1
        if end <= 0:
            at += 1
            continue
        parts.append(page[text_from:at])
        if m is not None:
            yield "".join(parts), m[2].lower(), bool(m[1]), page[m.end() : end - 1]
            parts = []
            if not m[1] and m[2].lower() in RAW:
                close = re.compile(rf"</{m[2]}\s*>", re.I).search(page, end)
                end = close.end() if close else len(page)
                yield "", m[2].lower(), True, ""
        text_from = at = end
    yield "".join([*parts, page[text_from:]]), "", False, ""


def lines_of(page: str) -> list[tuple[str, bool, bool, int, bool]]:
    """Blocks of a page in order: text, whether in an aside, in an article or main, link text's length, whether prose."""
    out: list[tuple[str, bool, bool, int, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, aside, main, link
    blocks: list[int] = []  # places of block elements in the stack
    open_: list[dict[str, int]] = [{}]  # inline elements since each of them
    count: dict[str, int] = {}  # open block elements by tag
    parts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, aside, main, _ = stack[-1] if stack else ("", False, False, False)
            out.append((text, aside, main, min(linked, len(text)), bool(blocks) and stack[blocks[-1]][0] in PROSE))
        parts.clear()
        linked = 0

    def cut(k: int) -> None:
        """Ends all elements from place ``k`` of the stack on."""
        while len(stack) > k:
            tag = stack.pop()[0]
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
                open_.pop()
                count[tag] -= 1
            else:
                open_[-1][tag] -= 1

    for text, tag, closing, attributes in markup(page):
        if text:
            parts.append(text)
            if stack and stack[-1][3]:
                linked += len(text.strip())
        if not tag:
            continue
        inline = tag in INLINE
        if not inline:
            end_block()
        if closing:
            if inline and open_[-1].get(tag) or not inline and count.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                cut(k)
        elif tag not in VOID and not attributes.endswith("/"):
            if tag == "p" and blocks and stack[blocks[-1]][0] == "p":
                cut(blocks[-1])  # a paragraph ends the one before, with what is open in it
            _, aside, main, link = stack[-1] if stack else ("", False, False, False)
            if inline:
                open_[-1][tag] = open_[-1].get(tag, 0) + 1
            else:
                blocks.append(len(stack))
                open_.append({})
                count[tag] = count.get(tag, 0) + 1
            stack.append((tag, aside or _aside(tag, attributes, main), main or tag in MAIN, link or tag == "a"))
    end_block()
    return out


def weights_of(lines: list[tuple[str, bool, bool, int, bool]]) -> list[float]:
    """Weight of each line, as the module says."""
    whole = any(main and not aside for _, aside, main, *_ in lines)
    out: list[float] = []
    alone: list[int] = []  # lines of links since the last other line of the article

    def end_links() -> None:
        for k in alone if len(alone) < WINDOW else ():
            out[k] = len(lines[k][0])
        alone.clear()

    for k, (text, aside, main, linked, prose) in enumerate(lines):
        own = max(0, len(text) - linked)
        if aside:
            out.append(0)
        elif main and not own and not prose:
            out.append(0)
            alone.append(k)
        elif main:
            end_links()
            out.append(own or len(text))
        else:
            out.append(own if not whole else own * OUTSIDE if own * OUTSIDE >= SURGE else 0)
    end_links()
    return out


def between_surge_and_dive(weights: list[float], main: list[bool] | None = None) -> list[bool]:
    """Which lines are main text, by the sums of their windows. ``main``: which lines are in an article or main element."""
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    most = max(sums, default=0)
    least, resumed = min(SURGE, most), min(RESUME, most / 4)
    kept, inside = [False] * len(weights), False
    for i, ahead in enumerate(sums):
        if ahead <= 0:
            inside = False
        elif not inside and ahead >= (resumed if main and main[i] else least):
            inside = True
            k = i - 1
            while k >= 0 and weights[k] > 0 and not kept[k]:  # what led to the surge
                kept[k] = True
                k -= 1
        kept[i] = inside and weights[i] > 0
    return kept


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    kept = between_surge_and_dive(weights_of(lines), [main for _, _, main, *_ in lines])
    texts = [text for (text, *_), keep in zip(lines, kept, strict=True) if keep]
    if len(texts) > 1 and COPYRIGHT.match(texts[-1]):
        texts.pop()
    return " ".join(texts)


def extract(pages: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``out_col`` and its code points in n_chars."""
    others = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    schema = pages.select(*others).schema.add(out_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*others, out_col])

    found = pages.select(*others, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, schema)
    return found.withColumn("n_chars", F.length(out_col).cast("long"))
