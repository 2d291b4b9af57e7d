"""HTML main text by tag-path ratios.

A page is read into blocks (runs of text between block-level tags), each with its root-to-leaf
tag path. Per path, text length and punctuation are gathered and put in relation to the number
of its blocks; the two ratios are fused, smoothed over neighbouring blocks of the page, and the
blocks of paths above a threshold are content. This is done for every page. Structure that pages
state themselves weighs the ratios: paths through navigation, page header and footer, aside, forms,
scripts, styles, hidden parts and elements named as adverts, notices or comments weigh nothing;
paths inside <article> or <main> weigh double, and a path outside them has to reach half of the
best one inside. Names are whole tokens of class and id, or the first or last part of a compound one (comments-area, left-sidebar;
not no-comments, has-sidebar or post-header); what stands under a heading over readers' comments counts as named so. An element that
holds most of the page's heaviest path isn't taken out for its name, and headings in an article's <header> stay. An <article> or <main> that holds a chosen path is content as a whole (headings
and short parts go with it); one that holds none, such as a teaser, isn't.

Text: character references decoded, white space of a block turned into one space and trimmed,
blocks joined by one line feed.

Nulls: a null page is empty (empty text, 0 characters); null ids and urls are carried. Markup that
ends early or is never closed is read as far as it goes. Repeated rows are read one by one;
extra columns are ignored. Pages of any length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vigilake.llm.common import map_rows, table

#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset(
    "nav footer header aside form script style noscript template iframe button select textarea input head title svg canvas "
    "object menu dialog audio video noembed noframes option xmp".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promotion promoted "
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription paywall "
    "share sharing social related recommended recommendations comment comments commentlist disqus replies reply respond "
    "copyright legal disclaimer widget widgets login signin signup register search pagination pager skip".split()
)
#: Parts of a compound name (comments-area, site-footer, leftSidebar): as its first part, as its last one, and first parts that take that back.
CHROME_FIRST = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter overlay pager pagination paywall popup promo recommended related "
    "share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
CHROME_LAST = frozenset(
    "ad ads advert adverts alert banner breadcrumb breadcrumbs commentlist comments disclaimer footer header menu modal nav navbar navigation newsletter "
    "notice overlay pagination popup sidebar sidebars toolbar widget widgets".split()
)
NOT_CHROME = frozenset("has no not with without is article post entry content story section chapter".split())
#: Headings over what readers say.
READERS = re.compile(
    r"\W*(?:\d+\s+)?(?:comments?|reader comments|user comments|responses?|replies|leave a (?:reply|comment)|join the (?:discussion|conversation)|"
    r"kommentare?|commentaires?|comentarios?|комментарии|نظرات|تعليقات)\b.{0,20}\Z", re.I
)
CONTENT = frozenset({"article", "main"})
#: An opening of the first kind ends open elements of the second.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"}, "body": {"head"},
}
#: Elements that an implied end doesn't reach through.
SCOPE = frozenset({"table", "td", "th", "caption", "html", "template", "object", "ul", "ol", "dl", "select"})
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE, _PUNCTUATION = re.compile(r"\s+"), re.compile(r"[^\w\s]")
#: Times the spread of the fused ratios over a page's blocks that a path needs.
THRESHOLD = 0.35
#: Weight of a path inside <article> or <main>; share of the best such path that a path outside needs.
INSIDE, OUTSIDE = 2.0, 0.5
#: Characters of the heaviest path from which an element with a name of CHROME_NAMES can hold it, and what such characters weigh.
HELD, NAMED = 400, 0.1
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PARTS = re.compile(r"[-_.:]+|(?<=[a-z])(?=[A-Z])")


def _says_chrome(names: str) -> bool:
    """Whether a class or id has a token that is, begins with, or ends with a name of chrome."""
    for token in names.split():
        if token.lower() in CHROME_NAMES:
            return True
        parts = [x.lower() for x in _PARTS.split(token) if x]
        if len(parts) > 1 and parts[0] not in NOT_CHROME and (parts[0] in CHROME_FIRST or parts[-1] in CHROME_LAST):
            return True
        if len(parts) > 1 and parts[0] in ("post", "article", "entry", "story") and parts[-1] in CHROME_LAST and parts[-1] != "header":
            return True
    return False


def _is_chrome(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is chrome by what it is, and whether its class or id names it so."""
    named = False
    if tag in CHROME:
        return True, False
    if not attributes or tag in ("body", "html"):
        return False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and _says_chrome(value):
            named = True
        value = value.lower()
        if name == "role" and value.strip() in CHROME_ROLES:
            return True, named
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, named
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, named
    return False, named


Block = tuple[str, str, bool, int, tuple[int, ...]]
Named = tuple[int, ...]


def named_blocks(page: str) -> list[tuple[Block, Named]]:
    """(text, tag path, chrome, number of the outermost content element or 0, numbers of the open elements) of every block that isn't blank, and
    the numbers of those of its elements that are named as chrome."""
    out: list[tuple[Block, Named]] = []
    stack: list[tuple[str, int, int, int, Named]] = []  # tag, chrome so far (1: an article's header), outermost content element, number, named
    held: list[str] = []
    path: list = ["", False, 0, ()]
    names: Named = ()
    number = 0

    def flush():
        text = _SPACE.sub(" ", html_lib.unescape("".join(held))).strip() if held else ""
        held.clear()
        if text:
            out.append(((text, *path), names))

    def close(at: int):
        if any(t in BLOCK or c or n for t, c, _, _, n in stack[at:]):
            flush()
        del stack[at:]

    pos, n = 0, len(page)
    while pos < n:
        m = _PIECE.match(page, pos)
        pos = m.end()
        if m[4] is not None:
            if not held or held[-1].isspace():  # the block is where its first visible text is
                top = stack[-1] if stack else ("", 0, 0, 0, ())
                path[:] = ["/".join([x[0] for x in stack]), top[1] > 0, top[2], tuple([x[3] for x in stack])]
                names = top[4]
            held.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None:
                close(at)
            elif tag in BLOCK:
                flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if ended := ENDS.get(tag):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ended:
                    close(k)
                    if tag != "tr":
                        break
                elif stack[k][0] in SCOPE and stack[k][0] not in ended:
                    break
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        above = stack[-1] if stack else ("", 0, 0, 0, ())
        itself, named = _is_chrome(tag, m[3])
        header = tag == "header" and above[2] > 0 and not above[1]
        chrome = 2 if itself and not header else max(above[1], int(itself))
        if chrome == 1 and tag in HEADINGS:  # a headline
            chrome = 0
        if named or chrome and not above[1]:
            flush()
        number += 1
        stack.append((tag, chrome, above[2] or (number if tag in CONTENT else 0), number, (*above[4], number) if named else above[4]))
    flush()
    return out


def under_readers(rows: list[tuple[Block, Named]]) -> list[tuple[Block, Named]]:
    """What stands under a heading over readers' comments, up to a heading of its rank or the end of the element around it, counts as named so."""
    for i, ((text, path, chrome, _, opened), _) in enumerate(rows):
        tags = path.split("/")
        if chrome or len(text) > 60 or len(tags) < 2 or tags[-1] not in HEADINGS or not READERS.match(text):
            continue
        for j in range(i, len(rows)):
            (block, names), mine = rows[j], rows[j][0][4]
            last = block[1].split("/")[-1]
            if opened[-2] not in mine or (j > i and last in HEADINGS and last <= tags[-1]):
                break
            rows[j] = block, (*names, -1 - i)
    return rows


def blocks(page: str) -> list[Block]:
    """The blocks, with those in named elements as chrome unless the element holds most of the heaviest path."""
    rows = under_readers(named_blocks(page))
    if not any(named for _, named in rows):
        return [r for r, _ in rows]
    weight, size, held = Counter(), Counter(), {}
    for (text, path, chrome, inside, _), named in rows:
        if not chrome:
            w = len(text) * (INSIDE if inside else 1.0) * (NAMED if named else 1.0)
            weight[path] += w
            for k in named:
                size[path, k] += len(text)
                held[path, k] = held.get((path, k), 0.0) + w
    main = max(weight, key=weight.get, default="")
    free = {k for (p, k), w in held.items() if p == main and size[p, k] >= HELD and 2 * w > weight[p]}
    return [(text, path, chrome or not free.issuperset(named), inside, opened) for (text, path, chrome, inside, opened), named in rows]


def path_scores(rows: list[Block]) -> np.ndarray:
    """Fused and smoothed tag-path ratio of each block."""
    length, points, count = Counter(), Counter(), Counter()
    for text, path, *_ in rows:
        length[path] += len(text)
        points[path] += len(_PUNCTUATION.findall(text))
        count[path] += 1
    ratio = {p: length[p] / n * np.log2(2 + points[p] / n) * np.log2(1 + n) for p, n in count.items()}
    raw = np.array([0.0 if chrome else ratio[path] * (INSIDE if inside else 1.0) for _, path, chrome, inside, _ in rows])
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = np.convolve(np.pad(raw, 2), kernel / kernel.sum(), "valid")
    return np.sqrt(raw * smooth)  # of a block and its neighbours, both must be rich


def main_text(page: str | None) -> str:
    rows = blocks(page or "")
    if not rows:
        return ""
    score = path_scores(rows)
    by_path: dict[str, list[float]] = {}
    weight: Counter[str] = Counter()
    held: set[str] = set()  # paths inside content elements
    for (text, path, chrome, inside, _), s in zip(rows, score, strict=True):
        by_path.setdefault(path, []).append(s)
        if not chrome:
            weight[path] += len(text)
            if inside:
                held.add(path)
    mean = {p: float(np.mean(s)) for p, s in by_path.items()}
    bar = THRESHOLD * score.std()
    beside = max(bar, OUTSIDE * max((mean[p] for p in held), default=0.0))
    chosen = {p for p, s in mean.items() if s >= (bar if p in held else beside)}
    heaviest = max(chosen or by_path, key=lambda p: weight[p])
    # what stands beside the heaviest path, headings say, goes with it
    around = {opened[-2] for _, path, chrome, inside, opened in rows if path == heaviest and not (chrome or inside) and len(opened) > 1}
    around |= {inside for _, path, chrome, inside, _ in rows if inside and not chrome and path in chosen}
    return "\n".join(text for text, path, chrome, _, opened in rows if not chrome and (path in chosen or not around.isdisjoint(opened)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of (page_id, url, html)."""
    def make():
        def work(batch):
            texts = [main_text(h) for h in batch["html"]]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over all pages."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
