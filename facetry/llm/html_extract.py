"""HTML extraction by tag-path ratios.

A page is cut into text blocks, each with its root-to-leaf path of block elements (their
names and classes). Per path, text length and punctuation are summed and divided by the
path's blocks; the two ratios are smoothed along the page, fused into one score, and paths
over a threshold are selected. The blocks of all selected paths are main text, with
headings below their lowest common container; the container that holds most of their text
gives its other blocks too, and an article or main element around it holds all of the main
text. Elements that can't hold it (menus, scripts ...) and hidden ones are left out before;
a class, id or role that names such an element lowers the scores below (never those of an
article or main element), a form is left out unless it holds most of the page's text, and
a block of links unless the text around it is none.

Paths are numbers in a trie and all sums go up it once, and no part of the markup is
scanned twice, so the time grows with the page's length however deep or broken it is.

Edge cases: null or empty html gives empty text and zero characters; unclosed, misnested
and cut-off markup is read as far as it goes; very long and very deep pages are read
whole; of containers that tie the deepest, then the first counts; repeated rows give
repeated results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from facetry.llm.common import arrow_map

#: Paths score as content from this share of the best path's score.
THRESHOLD = 0.1
#: A class, id or role that says no main text multiplies the scores below it by this.
MARKED = 0.02
#: Weights of a block's neighbours, nearest first, in smoothing.
SMOOTHING = (0.25, 0.1)
#: A container holds at least this share of the selected text.
MAJORITY = 0.6
#: A form that holds this share of the page's text is its frame.
FRAME = 0.8

#: A tag up to its end outside quotes; nothing in it is tried twice.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
#: A tag up to the first > where quotes don't close.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_RAW = {x: re.compile(rf"</{x}\b", re.IGNORECASE) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "html head body address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_OUT = frozenset("head nav footer aside menu dialog button select object canvas audio video map search datalist label".split())
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Words of a class, id or role that mark what is no main text.
_SAYS_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentary consent cookie cookies copyright disqus footer gdpr header login masthead menu menus modal nav navbar navigation navigations newsletter notice notices pagination pager paywall popup promo promos promoted promotion recommended related respond search share sharing shares sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags teaser toolbar topbar widget widgets alert alerts complementary contentinfo reply replies".split()
)
#: Last words of a compound name that say nothing, and first ones that make it a state.
_GENERIC = frozenset("container wrap wrapper box block list area section inner outer left right top bottom items item link links button buttons icons bar posts articles stories body content title text row col column unit slot panel group holder region zone module card cards form tile grid message cta media this toggle mobile desktop main primary secondary first last".split())
_STATE = frozenset("has no with without open closed enabled disabled allow allows supports hide show is not".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。、！？；：，¿¡]")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _hidden(attributes: str) -> bool:
    low = attributes.lower()
    return ("hidden" in low or "display" in low) and bool(_HIDDEN.search(attributes))


def _named(attributes: str) -> list[tuple[str, str]]:
    """The class, id and role with their values."""
    low = attributes.lower()
    if "class" not in low and "id" not in low and "role" not in low:
        return []
    return [(x[1].lower(), x[2] or x[3] or x[4] or "") for x in _ATTRIBUTE.finditer(attributes)]


def _marked(named: list[tuple[str, str]], inside: bool) -> bool:
    """Whether class, id or role name no main text: a name whose head word does, not one
    that tells a state (has-sidebar, comments-open). Inside an article its own header
    counts as text."""
    for _, value in named:
        for name in value.split():
            parts = [x.lower() for x in _WORD.findall(name)]
            while len(parts) > 1 and (parts[-1] in _GENERIC or parts[-1].isdigit()):
                parts.pop()
            if parts and parts[-1] in _SAYS_OUT and parts[0] not in _STATE and not (inside and parts[-1] == "header"):
                return True
    return False


class Block:
    """A text block: its path, characters inside links, marks (elements around whose names
    say no main text) and the form around it (-1: none)."""

    __slots__ = ("path", "text", "links", "marks", "form")

    def __init__(self, path: int, text: str, links: int, marks: int, form: int) -> None:
        self.path, self.text, self.links, self.marks, self.form = path, text, links, marks, form


class Paths:
    """A trie of block elements; a path is a number, larger than that of its parent."""

    def __init__(self) -> None:
        self.parent, self.name, self.depth = [-1], [""], [0]
        self.below: dict[tuple[int, str, str], int] = {}

    def step(self, path: int, name: str, called: str) -> int:
        key = (path, name, called)
        if key not in self.below:
            self.below[key] = len(self.parent)
            self.parent.append(path)
            self.name.append(name)
            self.depth.append(self.depth[path] + 1)
        return self.below[key]

    def sums(self, values: Iterable[tuple[int, int]]) -> list[int]:
        """By path, the sum of the values at it and below."""
        out = [0] * len(self.parent)
        for path, value in values:
            out[path] += value
        for path in range(len(out) - 1, 0, -1):
            out[self.parent[path]] += out[path]
        return out

    def under(self, top: int) -> list[bool]:
        """By path, whether it is ``top`` or below."""
        out = [False] * len(self.parent)
        for path in range(len(out)):
            out[path] = path == top or path > top and out[self.parent[path]]
        return out


class _Reader:
    """Reads markup into blocks."""

    def __init__(self) -> None:
        self.paths, self.out = Paths(), []
        # element, path with it, whether it or one above is left out, links around it, marks,
        # form around, whether an article or main element is around
        self.stack: list[tuple[str, int, bool, int, int, int, bool]] = [("", 0, False, 0, 0, -1, False)]
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.forms: list[int] = []  # the form around each form

    def flush(self) -> None:
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                _, path, _, _, marks, form, _ = self.stack[-1]
                self.out.append(Block(path, text, self.linked, marks, form))
            self.parts.clear()
        self.linked = 0

    def pop_to(self, k: int) -> None:
        stack = self.stack
        if any(stack[i][0] in _BLOCK for i in range(k, len(stack))) or stack[-1][4] != stack[k - 1][4]:
            self.flush()
        for entry in stack[k:]:
            self.open[entry[0]] -= 1
        del stack[k:]

    def opened(self, name: str, attributes: str) -> None:
        stack, block = self.stack, name in _BLOCK
        if block:
            self.flush()
            if self.open["p"]:  # an open paragraph ends here
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        self.pop_to(k)
                        break
                    if stack[k][0] in _BLOCK:
                        break
        if name in _CLOSES:
            ended, scope = _CLOSES[name]
            last, left = 0, sum(self.open[x] for x in ended)
            for k in range(len(stack) - 1, 0, -1) if left else ():
                if stack[k][0] in ended:
                    last, left = k, left - 1
                    if not left:
                        break
                elif stack[k][0] in scope:
                    break
            if last:
                self.pop_to(last)
        if name in _VOID:
            if name == "br":
                self.parts.append(" ")
            return
        _, path, left_out, links, marks, form, inside = stack[-1]
        own_header = name == "header" and inside
        page = name in ("html", "body")
        out_here = left_out or not own_header and (name in _OUT or name == "header" or not page and _hidden(attributes))
        named = [] if page else _named(attributes)
        says_out = bool(named) and name not in ("article", "main") and not own_header and _marked(named, inside)
        if says_out and not block:
            self.flush()
        if block:
            path = self.paths.step(path, name, next((v.lower() for k, v in named if k == "class"), ""))
        if name in ("form", "fieldset"):
            self.forms.append(form)
            form = len(self.forms) - 1
        self.open[name] += 1
        stack.append((name, path, out_here, links + (name == "a"), marks + says_out, form, inside or name in ("article", "main")))

    def closed(self, name: str) -> None:
        if not self.open[name]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                self.pop_to(k)
                return
            if self.stack[k][0] in _BLOCK and name not in _BLOCK:
                return

    def said(self, text: str) -> None:
        if text and not self.stack[-1][2]:
            self.parts.append(text)
            if self.stack[-1][3]:
                self.linked += len(text)

    def read(self, html: str) -> None:
        at, size, tag, last = 0, len(html), _TAG, html.rfind(">")
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                self.said(html[at:])
                break
            if html.startswith("<!--", mark):
                self.said(html[at:mark])
                end = html.find("-->", mark + 4)
                at = end + 3 if end >= 0 else size
                continue
            after = html[mark + 1 : mark + 2]
            if not (after.isascii() and after.isalpha() or after in ("/", "!", "?")) or not after:
                self.said(html[at : mark + 1])  # a mere sign
                at = mark + 1
                continue
            self.said(html[at:mark])
            if mark > last:  # the page ends inside this tag
                break
            found = tag.match(html, mark)
            if not found and tag is _TAG:
                if after in ("!", "?") or after == "/" and not html[mark + 2 : mark + 3].isalpha():
                    at = html.index(">", mark) + 1
                    continue
                tag = _LOOSE  # a quote is open to the end: from here on quotes don't count
                found = tag.match(html, mark)
            if not found:
                at = html.index(">", mark) + 1
                continue
            at = found.end()
            name, rest = found[2].lower(), found[3]
            if found[1]:
                self.closed(name)
            elif name in _RAW:
                if not rest.endswith("/"):
                    ended = _RAW[name].search(html, at)
                    end = html.find(">", ended.end()) if ended else -1
                    at = end + 1 if end >= 0 else size
            else:
                self.opened(name, rest)
                if rest.endswith("/") and name not in _VOID and name not in _BLOCK and len(self.stack) > 1:
                    self.pop_to(len(self.stack) - 1)
        self.flush()


def blocks(html: str) -> tuple[list[Block], Paths]:
    """The text blocks that may be main text, in page order, and their paths. Blocks in a
    form are left out unless it holds most of the page's text."""
    reader = _Reader()
    reader.read(html)
    held = [0] * len(reader.forms)
    for b in reader.out:
        if b.form >= 0:
            held[b.form] += len(b.text) - b.links
    for k in range(len(held) - 1, -1, -1):
        if reader.forms[k] >= 0:
            held[reader.forms[k]] += held[k]
    total = sum(len(b.text) - b.links for b in reader.out)
    frames: dict[int, bool] = {-1: True}
    for k, outer in enumerate(reader.forms):
        frames[k] = frames[outer] and held[k] >= FRAME * total
    return [b for b in reader.out if frames[b.form]], reader.paths


def path_scores(found: list[Block]) -> dict[int, float]:
    """The fused, smoothed length and punctuation ratio of each path."""
    totals: dict[int, list[int]] = {}
    for b in found:
        total = totals.setdefault(b.path, [0, 0, 0])
        total[0] += len(b.text)
        total[1] += len(_PUNCTUATION.findall(b.text))
        total[2] += 1
    length = [totals[b.path][0] / totals[b.path][2] for b in found]
    marks = [totals[b.path][1] / totals[b.path][2] for b in found]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i, value in enumerate(values):
            total, weight = value, 1.0
            for distance, w in enumerate(SMOOTHING, 1):
                for j in (i - distance, i + distance):
                    if 0 <= j < len(values):
                        total += w * values[j]
                        weight += w
            out.append(total / weight)
        return out

    scores: dict[int, float] = {}
    for b, x, y in zip(found, smooth(length), smooth(marks), strict=True):
        scores[b.path] = scores.get(b.path, 0.0) + x * (0.1 + y)
    return {p: s / totals[p][2] for p, s in scores.items()}


def _selected(found: list[Block]) -> set[tuple[int, int]]:
    """The ``(marks, path)`` whose score passes the threshold; marked text has no part in
    the smoothing of other text."""
    by_marks: dict[int, list[Block]] = {}
    for b in found:
        by_marks.setdefault(b.marks, []).append(b)
    scores = {(m, p): s * MARKED ** min(m, 20) for m, own in by_marks.items() for p, s in path_scores(own).items()}
    best = max(scores.values())
    return {x for x, s in scores.items() if s >= THRESHOLD * best}


def main_text(html: str | None) -> str:
    """The main text, a line for each block; empty if there is none."""
    found, paths = blocks(html or "")
    if not found:
        return ""
    selected = _selected(found)
    least = min(m for m, _ in selected)
    chosen = [(b.path, max(0, len(b.text) - 2 * b.links)) for b in found if b.marks == least and (b.marks, b.path) in selected]
    # the container of most of the text, and the lowest one of all of it
    mass, hits = paths.sums((paths.parent[p], m) for p, m in chosen if p), paths.sums((paths.parent[p], 1) for p, m in chosen if p and m)
    total, every = sum(m for _, m in chosen), sum(1 for p, m in chosen if p and m)
    holder = max((p for p in range(len(mass)) if mass[p] >= MAJORITY * total), key=lambda p: (paths.depth[p], -p), default=0)
    around = max((p for p in range(len(hits)) if every and hits[p] == every), key=lambda p: paths.depth[p], default=holder)
    semantic = _semantic(paths, holder)
    if semantic:
        around = holder = semantic
    else:
        heads = {paths.parent[b.path] for b in found if paths.name[b.path] in _HEADINGS}
        # up to the box that has the heading too
        up = holder
        while up and holder not in heads:
            up = paths.parent[up]
            if up > 0 and up in heads and paths.name[up] not in ("html", "body"):
                holder = up
    below, inside = paths.under(around), paths.under(holder)
    links, texts = paths.sums((b.path, b.links) for b in found), paths.sums((b.path, len(b.text)) for b in found)
    boxed = bool(holder) and paths.name[holder] not in ("html", "body")
    kept = []
    for b in found:
        # a block of links, where the text around it is one of links too
        box = paths.parent[b.path] if b.path else 0
        linked = b.links * 2 > len(b.text) and (links[box] * 2 > texts[box] or paths.name[box] in ("", "html", "body"))
        here = (b.marks, b.path) in selected and not linked
        if semantic:
            wanted = inside[b.path] and (b.marks <= least or here)
        elif b.marks > least:
            wanted = here
        else:
            wanted = here or (below[b.path] or inside[b.path]) and paths.name[b.path] in _HEADINGS or inside[b.path] and boxed and not linked
        if wanted:
            kept.append(b.text)
    return "\n".join(kept)


def _semantic(paths: Paths, holder: int) -> int:
    """The outermost article element around, else the outermost main element, or 0."""
    found = {"article": 0, "main": 0}
    while holder > 0:
        if paths.name[holder] in found:
            found[paths.name[holder]] = holder
        holder = paths.parent[holder]
    return found["article"] or found["main"]


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def work(batch: pa.RecordBatch) -> dict:
        found = [main_text(x) for x in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(x) for x in found]}

    return arrow_map(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
