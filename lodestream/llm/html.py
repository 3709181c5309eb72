"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level elements. The first pass classifies each block by its length, the density of
stop words and of linked characters; what stands in menus, headers, footers, sidebars, notices, adverts, forms or
reader comments is out at once. Where a page has hardly any stop word of the known lists, its language has no list here,
and length and link density decide alone. Blocks that the rules can't decide are ambiguous: in the second pass they
inherit the label of their nearest decided neighbours (the preceding and the following one; where these differ, the
nearer in characters, and the preceding one on a tie). On a page without any good block the ambiguous ones are its text.
An article or main element, where the page has one, bounds what may be kept.

The step is narrow and Python on Arrow batches. A page is read once, in time and memory proportional to its size,
however deep its elements are nested.

Defined results: null or empty html gives an empty text and 0 characters; repeated rows each give their own result; an
empty table gives an empty table; a page of any length is read whole; a tag that never ends runs to the page's end, an
attribute's quote that never ends doesn't open. White space is what Unicode calls so; the separators U+001C to U+001F
aren't. Other columns, whatever their names, aren't touched.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import decoded, mapped, texts

#: Elements whose content is no text of the page.
HIDDEN = "script style noscript template iframe svg math canvas object head title select textarea button audio video datalist".split()
#: Elements of the page around its article.
AROUND = "nav header footer aside form menu dialog".split()
#: Elements that end a block.
BLOCKS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
).split()
#: Elements without content.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Words of class, id and role that mark what is not the article.
BOILERPLATE = (
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies "
    "disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination paywall popup promo promoted "
    "promotion recommended related respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget"
).split()
#: Frequent function words of some languages.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can did do for from had has have he her his i if in into is it its more no not of on one or our out she so some than that the their them there they this to up was we were what when which who will with would you your",
    "de": "als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist kann man mehr mit nach nicht noch nur oder sich sie sind so über um und von vor war was wenn werden wie wir wird zu zum zur",
    "fr": "a au aux avec ce ces cette dans de des du elle en est et être fait il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses si son sont sur un une vous y",
    "es": "a al como con de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no o para pero por que se ser si sin sobre su sus también un una y ya",
    "it": "a al alla anche che come con da dal della di e è gli ha i il in la le lo ma nel non o per più si sono su un una",
    "pt": "a ao as com como da das de do dos e é em foi mais na não no o os ou para pela pelo por que se sem ser seu sua um uma",
    "nl": "aan als bij dat de deze die door een en er het hij ik in is je maar met naar niet nog of om onder ook op over te tot uit van voor was wat we wordt zich zijn",
}
_STOP = frozenset(w for ws in STOP_WORDS.values() for w in ws.split())
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WORD = re.compile(r"[^\W\d_]+")
#: Separators that str.split takes for white space and Unicode doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Scripts that say in one character what takes others about three.
_DENSE = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_HIDDEN, _AROUND, _BLOCKS, _VOID, _BOILERPLATE = map(frozenset, (HIDDEN, AROUND, BLOCKS, VOID, BOILERPLATE))
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in ("script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "title", "textarea", "select", "button", "audio", "video", "datalist")}
#: Of these, the ones whose content is raw text to the page's end where they never end.
_RAW = frozenset(["script", "style", "textarea", "title", "iframe", "noscript"])
#: An open paragraph, item or cell ends where one of these begins.
_CLOSES = {"p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


@dataclass(frozen=True)
class Rules:
    short: int = 70
    long: int = 200
    few_stop_words: float = 0.15
    many_stop_words: float = 0.30
    link_density: float = 0.35
    #: A page with a smaller share of stop words is in a language without a list.
    no_list: float = 0.05


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    outside: bool = False
    article: bool = False
    text: str = ""

    def words(self) -> list[str]:
        return [w.lower() for w in _WORD.findall(self.text)]


def squeezed(text: str) -> str:
    """``text`` with one space for each run of white space, trimmed."""
    if _SEPARATORS.search(text):
        return _SPACE.sub(" ", text).strip(" ")
    return " ".join(text.split())


class Elements:
    """The open elements, and how many of them there are by name, outside the text, and of the article."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool]] = []
        self.names: Counter[str] = Counter()
        self.outside = self.article = 0

    def push(self, name: str, outside: bool, article: bool) -> None:
        self.open.append((name, outside, article))
        self.names[name] += 1
        self.outside += outside
        self.article += article

    def pop(self) -> str:
        name, outside, article = self.open.pop()
        self.names[name] -= 1
        self.outside -= outside
        self.article -= article
        return name

    def close(self, name: str) -> None:
        """Up to the innermost element of this name, where there is one."""
        if self.names[name]:
            while self.pop() != name:
                pass


def _boilerplate(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    for m in _NAME.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            if {p.lower() for p in _PART.findall(name)} & _BOILERPLATE:
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of text, in page order."""
    out: list[Block] = []
    elements = Elements()
    links, block, breaks = 0, Block(), 0
    endless: set[str] = set()  # elements that have no end tag further on

    def end() -> None:
        nonlocal block
        block.text = squeezed(html.unescape("".join(block.parts)))
        if block.text:
            out.append(block)
        block = Block(outside=elements.outside > 0, article=elements.article > 0)

    def say(text: str) -> None:
        nonlocal breaks
        if text:
            block.parts.append(text)
            if not text.isspace():
                breaks = 0
                if links:
                    block.linked += len("".join(html.unescape(text).split()))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        say(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag
            if name == "a":
                links = max(0, links - 1)
            elements.close(name)
            if name in _BLOCKS or name in _HIDDEN:
                end()
            continue
        if name in _RAW_END:
            stop = None if name in endless else _RAW_END[name].search(page, at)
            if stop:
                at = stop.end()
            else:
                endless.add(name)
                at = n if name in _RAW else at
            continue
        if name == "br":
            say(" ")
            breaks += 1
            if breaks > 1:
                end()
            continue
        if name in _VOID:
            if name == "hr":
                end()
            continue
        if name == "a":
            links += 1
            continue
        around = _boilerplate(m[3])
        if name in _BLOCKS or name in _HIDDEN or around:
            if elements.open and name in _CLOSES.get(elements.open[-1][0], ()):
                elements.pop()
            outside = name in _HIDDEN or (name in _AROUND and not (name == "header" and elements.article)) or (around and name not in ("html", "body", "article", "main"))
            if not m[3].endswith("/"):
                elements.push(name, outside, name in ("article", "main"))
            links = 0
            end()
    end()
    return out


def link_dense(block: Block, rules: Rules) -> bool:
    return block.linked > rules.link_density * max(1, len(block.text.replace(" ", "")))


def has_list(found: list[Block], rules: Rules = Rules()) -> bool:
    """Whether the page's own text has stop words of the known lists."""
    words = [w for b in found if not b.outside and not link_dense(b, rules) for w in b.words()]
    return sum(w in _STOP for w in words) >= rules.no_list * len(words)


def classify(block: Block, rules: Rules = Rules(), listed: bool = True) -> str:
    """First pass: good, bad or ambiguous. ``listed``: stop words of the page's language are known."""
    if block.outside or link_dense(block, rules):
        return "bad"
    n = len(block.text)
    if n < rules.short and "©" in block.text:
        return "bad"
    if not listed:
        return "good" if n + 2 * len(_DENSE.findall(block.text)) >= rules.long else "ambiguous"
    words = block.words()
    density = sum(w in _STOP for w in words) / len(words) if words else 0.0
    if n >= rules.long and density >= rules.few_stop_words or n >= rules.short and density >= rules.many_stop_words:
        return "good"
    return "ambiguous"


def inherit(labels: list[str], sizes: list[int], default: str) -> list[str]:
    """Second pass: ambiguous blocks take the label of the nearest decided ones."""
    n = len(labels)
    before: list[tuple[str | None, int]] = []
    label, far = None, 0
    for k in range(n):
        before.append((label, far))
        label, far = (labels[k], 0) if labels[k] != "ambiguous" else (label, far + sizes[k])
    out = list(labels)
    label, far = None, 0
    for k in reversed(range(n)):
        if labels[k] != "ambiguous":
            label, far = labels[k], 0
            continue
        first, gap = before[k]
        if first is None or label is None:
            out[k] = first or label or default
        else:
            out[k] = first if first == label or gap <= far else label
        far += sizes[k]
    return out


def main_text(page: str, rules: Rules = Rules()) -> str:
    """Blocks of the article, joined by one line feed."""
    found = blocks(page)
    if any(b.article and not b.outside for b in found):
        found = [b for b in found if b.article]
    # What is out for certain decides about itself alone; undecided blocks look past it.
    inside = [b for b in found if not b.outside]
    listed = has_list(inside, rules)
    labels = [classify(b, rules, listed) for b in inside]
    if "good" in labels:
        labels = inherit(labels, [len(b.text) for b in inside], "good")
    else:
        labels = ["good" if x == "ambiguous" else x for x in labels]
    return "\n".join(b.text for b, label in zip(inside, labels, strict=True) if label == "good")


def with_main_text(pages: DataFrame, keep: list[str], source: str = "html", prefix: str = "", rules: Rules = Rules()) -> DataFrame:
    """``keep`` of every page, its text and n_chars (code points)."""

    def rows(column: pa.Array) -> list[pa.Array]:
        found = [main_text(decoded(raw), rules) for raw in texts(column)]
        return [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]

    return mapped(pages, [source], keep, [(f"{prefix}text", T.StringType()), (f"{prefix}n_chars", T.LongType())], rows)
