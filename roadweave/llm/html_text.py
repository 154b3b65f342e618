"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks (stretches of text between block-level tags), each at the end of a path of tags from
the root. Per path, text length and punctuation are summed over its blocks; the two ratios (characters and punctuation
marks a block) are fused, smoothed along the page, and give every block a mass. From the root, the path that holds most
of the mass below it is followed down to the content, as long as all beside it has a far smaller mass a character, so that no
running text is passed by; paths there are kept, but for plain containers with a far smaller mass a character than the best
one, be they long or short. Headings just before the content, and its title in a container of its own, belong to it. What a
tag, role, class or id names as a menu, header, footer, sidebar, notice, advert, form or comment has no mass,
unless the page would be left with little else and no article or main part. Inside content, words that name an
article's own sections as well (related, promotion, ...) count only if none but words for lists follow them.

Defined cases: null, empty and markup-only pages give an empty text; unclosed tags, comments and truncated pages end
with the page, but unclosed buttons, lists of choices and media are taken for empty ones; a page without any tag is one block; repeated pages count each; whole pages are read, of any length.
"""

from __future__ import annotations

import html as html_names
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from roadweave.llm.common import with_results

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset(
    "script style noscript template textarea title iframe object svg canvas video audio select button datalist annotation "
    "annotation-xml".split())
TO_THE_END = frozenset("script style noscript textarea title".split())  # unclosed, these hold the rest of the page
NO_CONTENT_TAGS = frozenset("head nav footer aside form menu dialog search fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
PLAIN_TAGS = frozenset("div section center table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {  # a start tag ends these open elements, up to the given borders
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disclaimer discussion disqus feedback foot footer gdpr header login masthead menu menus modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion rail recommended related "
    "replies reply respond responses share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets".split())
# words that also name sections of articles: there they count only if no other words than those for lists and the like follow
UNSURE_NAMES = frozenset("promoted promotion rail recommended related share sharing social discussion feedback response responses skip".split())
LIST_NAMES = frozenset(
    "area article articles bar block body box button buttons by col column container content count entries for icon icons inner item items links "
    "list media news on pages panel post posts reading region section stories story this title topics with wrap wrapper you".split())
BESIDE = LIST_NAMES | UNSURE_NAMES | NO_CONTENT_NAMES
WITHOUT, STATES = frozenset("with without has no".split()), frozenset("open closed enabled disabled".split())
CONTENT_NAMES = frozenset("article articlebody content entry main post story text".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
_TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

BY_TAG, BY_NAME = 1, 2


def _named_words(value: str, within: bool) -> list[str]:
    """Words of a class or id that say what the element is: not what it has, lacks or allows."""
    words: list[str] = []
    for token in value.split():
        own = [n.lower() for n in _NAME.findall(token)]
        if len(own) > 1 and (own[0] in WITHOUT or own[-1] in STATES):
            continue
        if within and len(own) > 1:
            own = [n for i, n in enumerate(own) if n not in UNSURE_NAMES or all(o in BESIDE or o.isdigit() for o in own[i + 1 :])]
        words += own
    return words


class _Paths:
    """The tag paths of a page, numbered so that a path comes after its parent; equal labels below one parent are one path."""

    def __init__(self):
        self.known: dict[tuple[int, str], int] = {}
        self.parents, self.tags, self.labels = [0], [""], [""]

    def below(self, parent: int, tag: str, label: str) -> int:
        path = self.known.setdefault((parent, label), len(self.parents))
        if path == len(self.parents):
            self.parents.append(parent)
            self.tags.append(tag)
            self.labels.append(label)
        return path


class _Node:
    """An open element: `within`, `tagged` and `head` also hold for all that is below it."""

    __slots__ = ("tag", "path", "parent", "out", "content", "within", "tagged", "head")

    def __init__(self, tag: str, path: int, parent: "_Node | None", out: int = 0, content: bool = False, head: bool = False):
        self.tag, self.path, self.parent, self.out, self.content = tag, path, parent, out, content
        self.within = content or parent is not None and parent.within
        self.tagged = tag in CONTENT_TAGS or parent is not None and parent.tagged
        self.head = head or parent is not None and parent.head


def _node(tag: str, attributes: str, parent: _Node, paths: _Paths) -> _Node:
    """An open block-level element: its path, whether it is ruled out (a bit for each reason), whether it is named as content."""
    out, content, label = parent.out, tag in CONTENT_TAGS, tag
    if tag in NO_CONTENT_TAGS or tag == "header" and not parent.within:
        out |= BY_TAG
    head = tag == "header"
    if attributes and tag not in ("html", "body"):
        within = parent.within
        names: list[str] = []
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id"):
                label += ("." if name == "class" else "#") + value.strip().lower()
                names += _named_words(value, within)
            elif name == "role":
                content = content or value.lower() == "main"
                out |= BY_TAG * (value.lower() in NO_CONTENT_ROLES)
            elif name == "itemprop":
                content = content or value.lower() == "articlebody"
            elif name == "hidden" and not value or name == "aria-hidden" and value.lower() == "true" or (
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                out |= BY_TAG
        if tag not in CONTENT_TAGS:
            ruled = {n for n in names if n in NO_CONTENT_NAMES}
            if within and ruled == {"header"}:
                head = True
            elif ruled:
                out |= BY_NAME
            elif names and any(n in CONTENT_NAMES for n in names):
                content = True
    return _Node(tag, paths.below(parent.path, tag, label), parent, out, content, head)


def blocks_of(page: str) -> tuple[list[tuple[_Node, str]], _Paths]:
    """The page's blocks of text in order, each with the element it ends a path at, and the paths."""
    paths = _Paths()
    root = _Node("", 0, None)
    stack, found, pieces = [root], [], []
    unclosed: set[str] = set()

    def flush() -> None:
        if pieces:
            text = " ".join(pieces)
            pieces.clear()
            text = " ".join((html_names.unescape(text) if "&" in text else text).split())
            if text:
                found.append((stack[-1], text))

    glued: list[str] = []

    def add(text: str) -> None:
        glued.append(text)

    def end_run() -> None:
        if glued:
            pieces.append("".join(glued))
            glued.clear()

    at = 0
    while match := _TAG.search(page, at):
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK_TAGS:
                end_run()
                flush()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
        elif tag in RAW_TAGS:
            if not attributes.endswith("/") and tag not in unclosed:
                end = re.compile(f"</{re.escape(tag)}(?:[\\s/][^>]*)?(?:>|\\Z)", re.I).search(page, at)
                if not end and tag not in TO_THE_END:
                    unclosed.add(tag)
                else:
                    at = end.end() if end else len(page)
        elif tag == "br":
            end_run()
        elif tag in BLOCK_TAGS:
            end_run()
            flush()
            if tag in CLOSES:
                ended, borders = CLOSES[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in borders:
                        break
                    if stack[depth].tag in ended:
                        del stack[depth:]
            if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
                stack.pop()
            if tag == "body":  # what was open in the head ends here
                stack[:] = [n for n in stack if n.tag in ("", "html")]
            if tag not in VOID_TAGS:
                stack.append(_node(tag, attributes, stack[-1], paths))
    add(page[at:])
    end_run()
    flush()
    return found, paths


def _masses(blocks: list[tuple[_Node, str]]) -> list[float]:
    """Length of each block times the fused and smoothed ratios of its path, relative to the best path."""
    sums: dict[int, list[float]] = {}
    for node, text in blocks:
        own = sums.setdefault(node.path, [0, 0, 0])
        own[0] += 1
        own[1] += len(text)
        own[2] += len(PUNCTUATION.findall(text))
    fused = [(own := sums[node.path])[1] / own[0] * (0.2 + own[2] / own[0]) for node, _ in blocks]
    padded = [fused[0], *fused, fused[-1]]
    smooth = [0.25 * a + 0.5 * b + 0.25 * c for a, b, c in zip(padded, padded[1:], padded[2:])]
    by_path: dict[int, list[float]] = {}
    for (node, _), value in zip(blocks, smooth):
        by_path.setdefault(node.path, []).append(value)
    ratio = {path: sum(v) / len(v) for path, v in by_path.items()}
    best = max(ratio.values()) or 1
    return [len(text) * ratio[node.path] / best for node, text in blocks]


LEAST, RUNNING = 0.12, 0.2
_NUMBERED = re.compile(r"#[^/.#]*|\d+")


def _kept_paths(children: list[int], paths: _Paths, below: np.ndarray, length: np.ndarray, headed: set[int]) -> set[int]:
    """Of sibling containers, those whose mass a character is near that of the best, and tables with a caption or head cells.

    Paths that differ only by id or number are taken together, so that short ones stay with their like.
    """
    alike: dict[str, list[int]] = {}
    for path in children:
        alike.setdefault(_NUMBERED.sub("", paths.labels[path]), []).append(path)
    ratio = {key: sum(below[p] for p in own) / max(sum(length[p] for p in own), 1) for key, own in alike.items()}
    best = max(ratio.values(), default=0.0)
    return {p for key, own in alike.items() for p in own if ratio[key] >= LEAST * best or p in headed}


def _content(blocks: list[tuple[_Node, str]], paths: _Paths) -> list[bool]:
    """Which blocks belong to the content."""
    number = len(paths.parents)
    own_mass, own_length, headed, named, seen = np.zeros(number), np.zeros(number), set(), set(), set()
    for (node, text), mass in zip(blocks, _masses(blocks)):
        own_mass[node.path] += mass
        own_length[node.path] += len(text)
        cell, above = node.tag in ("th", "caption"), node
        while above and (above, cell) not in seen:
            seen.add((above, cell))
            if above.content:
                named.add(above.path)
            if cell and above.tag == "table":
                headed.add(above.path)
            above = above.parent
    below, length = own_mass.copy(), own_length.copy()
    children: dict[int, list[int]] = {}
    for path in range(number - 1, 0, -1):
        if length[path]:
            below[paths.parents[path]] += below[path]
            length[paths.parents[path]] += length[path]
            children.setdefault(paths.parents[path], []).append(path)
    here = 0
    while here not in named:
        # the leaves of paths are the blocks themselves, which hold no further path
        options = [c for c in children.get(here, ()) if c in children]
        contents = [c for c in options if c in named and below[c] >= 0.3 * below[here]]
        child = max(contents or options, key=lambda c: below[c], default=None)
        if child is None:
            break
        # the rest stays unless it is far from running text: short and without punctuation beside the child's
        least = RUNNING * below[child] / length[child]
        if not contents and (own_mass[here] > least * own_length[here] or any(
                below[c] > least * length[c] for c in children[here] if c != child)):
            break
        here = child
    near = _kept_paths(children.get(here, []), paths, below, length, headed)
    # for each path, whether it is `here` or below it, and then whether it is kept
    stays = [False] * number
    for path in range(here, number):
        above = paths.parents[path]
        if path == here:
            stays[path] = True
        elif above == here:
            stays[path] = here in named or paths.tags[path] not in PLAIN_TAGS or path in near
        else:
            stays[path] = stays[above]
    kept = [stays[node.path] for node, _ in blocks]
    others = np.array([0 if tag in HEADINGS else n for tag, n in zip(paths.tags, own_length)])  # characters outside headings
    for path in range(number - 1, 0, -1):
        others[paths.parents[path]] += others[path]
    titled = any(stay and node.tag == "h1" for (node, _), stay in zip(blocks, kept))
    for i in range(len(blocks) - 2, -1, -1):  # a heading belongs to what it introduces
        node, after = blocks[i][0], blocks[i + 1][0]
        if not kept[i] and kept[i + 1] and node.tag in HEADINGS:
            above = node.parent
            while not titled and above.parent and not others[above.path]:  # the title may have a container of its own
                above = above.parent
            kept[i] = any(n is above for n in _line(after))
    return kept


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by line feeds."""
    every, paths = blocks_of(page or "")
    # in the header of an article only its headings count
    every = [b for b in every if not b[0].head or b[0].tag in HEADINGS or b[0].out]
    named = [b for b in every if not b[0].out]
    blocks = [b for b in every if not b[0].out & BY_TAG]
    if any(node.tagged for node, _ in named) or (
            sum(len(t) for _, t in named) >= 0.05 * sum(len(t) for _, t in blocks)) or not blocks:
        blocks = named
    if not blocks:
        return ""
    return "\n".join(text for (_, text), kept in zip(blocks, _content(blocks, paths)) if kept)


def _line(node: _Node | None):
    while node:
        yield node
        node = node.parent


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of `pages`, its main `text` and `n_chars`, the number of its code points."""
    def work(sources: list[str | None]) -> list:
        texts = [main_text(s) for s in sources]
        return [texts, np.fromiter(map(len, texts), np.int64, len(texts))]

    return with_results(pages, [column], [StructField("text", StringType()), StructField("n_chars", LongType())], work)
