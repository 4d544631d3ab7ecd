"""Main text of web pages by two-pass block rules.

The first pass classes every block by its link density, its length and its evidence, which is its stop-word density
with the weight of where it stands added; blocks that are short or of middling evidence take, in the second pass,
the class of their nearest decided neighbours.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame

from . import _base as B

GOOD, BAD, OPEN = 1, 0, None
#: Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "the and of to in a is that it for was on with as be at by this from or an are not have but had his her they you which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec "
    "el que y los se las un por con no una su para es al lo como más o pero sus del está".split()
)
#: Elements whose text is never content, that start a block, and that frame a page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select option datalist textarea button audio video".split())
BLOCK = frozenset("address article aside blockquote body br center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
FRAME = frozenset("nav header footer aside form menu dialog fieldset label legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
HEADINGS = tuple(f"h{i}" for i in range(1, 7))
#: An element that opens any of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("br label legend summary figcaption dt dd li td th tr tbody thead tfoot col colgroup optgroup frame".split())
#: Words in class, id or role that mark parts beside the content: readers' words, such parts, and parts that may as well hold it.
MARKS = {
    2: "comments? commentlist respond discussion disqus repl(?:y|ies)",
    1: "ads? advert\\w* adsense breadcrumbs? cookies? consent gdpr copyright footer footnav menu nav navbar navigation aside related recommended sidebar sponsor\\w* pagination pager complementary contentinfo",
    0: "banner header masthead newsletter subscribe signup notice alert popup topbar login rail sticky modal overlay promo\\w* share sharing social toolbar widget search",
}
ASIDE = {kind: re.compile(rf"(?<![a-z])(?:{words.replace(' ', '|')})(?![a-z])", re.I) for kind, words in MARKS.items()}
READERS, STRONG, WEAK = 2, 1, 0
#: Framing elements that seldom hold the content.
FRAMES_STRONG = frozenset("nav footer aside menu".split())
#: Compounds that hold such a word but name the content or its layout.
NOT_ASIDE = re.compile(r"(?<![a-z])(?:(?:article|entry|post|content|story|main|page)-?(?:header|heading|head)|(?:has|with|without|no|hide)-[a-z-]+|comments?-(?:open|closed|enabled|disabled))(?![a-z])", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
#: What standing within a content element, outside one where the page has one, and within a framing or so named part adds.
WITHIN, WITHOUT = 0.12, -0.12
BESIDE = {WEAK: -0.35, STRONG: -1.0, READERS: -1.0}


def mark_of(value: str) -> int:
    """The strongest mark in a class, id or role of a part beside the content, -1 if there is none."""
    plain = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).replace("_", "-")
    plain = NOT_ASIDE.sub(" ", plain)
    return next((kind for kind, words in ASIDE.items() if words.search(plain)), -1)


class Mark:
    """A marked element: its kind, the marked one above it, and the nearest that is no weak one, itself included."""

    __slots__ = ("number", "above", "kind", "firm")

    def __init__(self, number: int, above: Mark | None, kind: int):
        self.number, self.above, self.kind = number, above, kind
        self.firm = self if kind > WEAK else above and above.firm


class Block:
    __slots__ = ("parts", "linked", "mark", "inside", "heading")

    def __init__(self, mark: Mark | None, inside: bool, heading: bool):
        self.parts: list[str] = []
        self.linked, self.mark, self.inside, self.heading = 0, mark, inside, heading


def blocks(page: str) -> list[tuple[str, int, Block]]:
    """Blocks with text in page order: text, characters in links, and where it stood.

    A content element within weakly marked ones is free of them.
    """
    stack: list[tuple[str, Mark | None, bool]] = []  # element, innermost mark, within the content
    depth_of: Counter = Counter()  # open elements by name
    out: list[Block] = [Block(None, False, False)]
    links = 0
    at = 0

    def state() -> tuple[Mark | None, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (None, False)

    def start() -> None:
        mark, inside = state()
        out.append(Block(mark, inside, any(depth_of[h] for h in HEADINGS)))

    def close(name: str) -> None:
        """Ends the innermost open element of that name and what it holds."""
        while depth_of[name]:
            own = stack.pop()[0]
            depth_of[own] -= 1
            if own == name:
                break

    def text(raw: str) -> None:
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            out[-1].parts.append(raw)
            if links:
                out[-1].linked += len(SPACE.sub("", raw))

    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not (name := m[2]):
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            close(name)
            if name in BLOCK:
                start()
            continue
        if name in SILENT:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not m[0].endswith("/>"):
                at = end.end() if end else (len(page) if name in ("script", "style", "textarea", "title") else at)
            continue
        if name == "a":
            links += 1
        if name in ENDS_P:
            close("p")
        if name not in VOID and not m[0].endswith("/>") and name in BLOCK | {"span", "a"}:
            mark, inside = state()
            kind, hidden = -1, False
            if m[3]:
                for key, value in ATTR.findall(m[3]):
                    key, value = key.lower(), value.strip("\"'")
                    hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower()
                    if key in ("class", "id", "role") and name not in CONTENT | {"body", "html"}:
                        kind = max(kind, mark_of(value))
            if name in FRAME and not (name == "header" and inside):  # an article's own head may hold its title
                kind = max(kind, STRONG if name in FRAMES_STRONG else WEAK)
            kind = READERS if hidden else kind  # never content either
            if name in CONTENT:
                mark = mark and mark.firm
            stack.append((name, Mark(m.start(), mark, kind) if kind >= 0 else mark, inside or name in CONTENT))
            depth_of[name] += 1
        if name == "br" and not out[-1].parts or name == "br" and out[-1].parts[-1] != "\n":
            out[-1].parts.append("\n")  # one break is white space, two end the block
        elif name in BLOCK:
            start()
    text(page[at:])
    found = []
    for b in out:
        whole = SPACE.sub(" ", "".join(b.parts)).strip()
        if whole:
            found.append((whole, b.linked, b))
    return found


def stop_density(text: str) -> float:
    """Share of stop words among the words of letters."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(text: str, linked: int, place: float, short: int = 70, low: float = 0.1, high: float = 0.2, links: float = 0.33) -> tuple[int | None, str]:
    """Class of a block and the rule that gave it; place: what its surroundings add to the evidence.

    A block with many characters in links is no content. A short one is open unless it stands in a part beside the
    content, whatever its words. Of the others, evidence from `high` on is content, below `low` not, else open.
    """
    if linked > links * len(text):
        return BAD, "link density"
    if len(text) < short:
        return (BAD, "place") if place <= BESIDE[WEAK] + WITHIN else (OPEN, "short")
    density = stop_density(text)
    if density + place >= high:
        return GOOD, "stop-word density"
    if density + place < low:
        return BAD, "place" if density >= low else "stop-word density"
    return OPEN, "middling density"


def pooled(first: list[tuple[int | None, str]], texts: list[str], place: list[float], short: int = 70, high: float = 0.2) -> list[tuple[int | None, str]]:
    """A run of open blocks in one place that touches no content is judged as one block.

    It is content if it is long enough together and its joint evidence suffices; else it stays open.
    """
    out, i = list(first), 0
    while i < len(out):
        if first[i][0] is not OPEN:
            i += 1
            continue
        end = i
        while end < len(out) and first[end][0] is OPEN and place[end] == place[i]:
            end += 1
        beside = [first[j][0] for j in (i - 1, end) if 0 <= j < len(out)]
        whole = " ".join(texts[i:end])
        if GOOD not in beside and len(whole) >= short and stop_density(whole) + place[i] >= high:
            out[i:end] = [(GOOD, "joint density")] * (end - i)
        i = end
    return out


def second_pass(classes: list[int | None], inside: list[bool], heading: list[bool]) -> list[int]:
    """Open blocks inherit from the nearest decided block on both sides; where these differ, the nearer one.

    At equal distance the content wins, as it does for a heading before content. Only decided blocks on
    the same side of the content element's edge count; where there are none, blocks within it are content.
    """
    before, after = [nearest(classes, inside, step) for step in (1, -1)]
    out = []
    for i, c in enumerate(classes):
        near = [(abs(j - i), classes[j]) for j in (before[i], after[i]) if j is not None]
        if c is not OPEN:
            out.append(c)
        elif not near:
            out.append(GOOD if inside[i] else BAD)
        elif heading[i] and near[-1][1] == GOOD:
            out.append(GOOD)
        else:
            out.append(min(near, key=lambda n: (n[0], -n[1]))[1])
    return out


def nearest(classes: list[int | None], inside: list[bool], step: int) -> list[int | None]:
    """For each block the last decided one before it in the direction of `step`, on its side of the content's edge."""
    out: list[int | None] = [None] * len(classes)
    last = None
    for i in range(len(classes))[::step]:
        if last is not None and inside[last] != inside[i]:
            last = None
        out[i] = last
        if classes[i] is not OPEN:
            last = i
    return out


def kinds_of(found: list[tuple[int, Block]]) -> list[int]:
    """For each block (characters outside links, block) the strongest mark above it that holds, -1 without one.

    A marked element with at least half of the page's text outside links is its frame and no part beside it, so its mark
    does not hold. Only if no content element stands outside it, and, for a strong mark, if hardly any text is
    without marks. What readers wrote and what is hidden stays marked.
    """
    marks: dict[int, Mark] = {}
    text: Counter = Counter()
    content: Counter = Counter()
    for n, b in found:
        m = b.mark
        if m:
            text[m.number] += n
        content[m.number if m else -1] += b.inside and not (m and m.firm)
        while m and m.number not in marks:
            marks[m.number], m = m, m.above
    total, every, unmarked = sum(n for n, _ in found), content.total(), sum(n for n, b in found if not b.mark)
    for k in sorted(marks, reverse=True):  # an element starts after those that hold it
        if above := marks[k].above:
            text[above.number] += text[k]
            content[above.number] += content[k]
    holds: dict[int, int] = {}
    for k, m in sorted(marks.items()):
        frame = m.kind < READERS and 2 * text[k] >= total and content[k] == every and (m.kind == WEAK or 10 * unmarked < total)
        holds[k] = max(-1 if frame else m.kind, holds[m.above.number] if m.above else -1)
    return [holds[b.mark.number] if b.mark else -1 for _, b in found]


def judged(page: str) -> list[tuple[str, bool, str]]:
    """Blocks in page order: text, whether it is content, and the first pass's rule."""
    found = blocks(page)
    marked = kinds_of([(len(t) - linked, b) for t, linked, b in found])
    told = any(b.inside and kind < 0 for (*_, b), kind in zip(found, marked))  # the page has a content element
    place = [BESIDE.get(kind, 0) + (WITHIN if b.inside else WITHOUT * told) for (*_, b), kind in zip(found, marked)]
    first = [first_pass(t, linked, x) for (t, linked, _), x in zip(found, place)]
    first = pooled(first, [t for t, *_ in found], place)
    keep = second_pass([c for c, _ in first], [b.inside for *_, b in found], [b.heading for *_, b in found])
    return [(t, k == GOOD, rule) for (t, *_), k, (_, rule) in zip(found, keep, first)]


def main_text(page: str | None) -> str:
    """The page's content blocks, two line feeds between them; empty if there are none."""
    return "\n\n".join(t for t, keep, _ in judged(page) if keep) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Rows id, the columns of `keep`, text and n_chars (code points): one for every page.

    A null or empty html gives the empty text. Rows are independent: repeated rows, null ids and urls and
    other columns change nothing. One pass without a shuffle.
    """

    def run(htmls: list[str | None]) -> tuple[None, pd.DataFrame]:
        texts = [main_text(x) for x in htmls]
        return None, pd.DataFrame({"text": texts, "n_chars": [len(x) for x in texts]})

    return B.beside(pages, [id_col, *keep], [html_col], run, "text string, n_chars long")
