"""Main text of web pages by text-to-tag ratios over streamed parser events.

The standard library's parser streams events; block boundaries part the text into lines, and each line knows its
characters, its tags, the characters inside links, and the element that holds it. The ratio of text to tags per line is
smoothed with a Gaussian; lines above the threshold (the mean less a share of the deviation) form clusters, the content
regions. The clusters choose the element that carries the article: the smallest one with nearly all of their text. A
cluster then grows over the other lines of that element, so the statistics decide where the article is but never
drop a sentence of it. Names only exclude and never choose: elements that are no prose by their tag make no lines, and the
text of those whose class, id or role says so, and of forms, counts for nothing in the ratios unless they hold most of the
page's text.

Tags and comments that never end would make the parser search the rest of the page at each of them, so they are made text, or
the end of the page, before it sees them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import bounded_batches, table, text_runs

# Fixed values of HTML: elements without content, elements whose text isn't prose, elements that part lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog menu audio video map".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements at whose start and end a line ends; scripts, buttons and unknown elements may stand inside of one.
PARTS = BLOCKS | frozenset("head nav header footer aside form main menu dialog iframe".split())
#: A start tag of these ends an open p.
ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"} | {"form", "nav", "header", "footer", "aside", "main"}
#: A start tag ends open elements of the same kind up to the container.
ENDS_SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
CONTAINERS = frozenset({"article", "main", "section", "div", "body", "html", "td", "table", "blockquote"})
#: Words of class, id or role that mark what isn't the article, and those of them that mark what readers or links add to it.
TALK = frozenset("related recommended comment comments commentlist disqus reply replies respond discussion reactions".split())
MARKED = TALK | frozenset(
    "ad ads advert adverts advertising advertisement advertisements sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social widget toolbar pagination pager search contentinfo complementary dialog form".split()
)
#: Words that name a part or a place: what stands before them at the end of a class is what it names.
PLACES = frozenset("site page main global top bottom left right primary secondary mobile desktop container wrapper wrap box block section list area bar inner outer side item items slot unit link links button buttons icons post posts entry article message".split())
#: Words before a name that say something about the element, not what it is.
ABOUT = frozenset("has no not with without is in category cat tag type format layout".split())
#: Shares of the page's text beyond which a marked element is kept.
MOST, MOST_TALK = 0.5, 0.9
#: Parts of a line; a marked one is dropped at once.
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(4096)
def marked(names: str) -> str:
    """'talk' or 'mark' if a whole class, id or role of `names` marks what isn't the article; '' if none does. A compound is what its
    last word says, places aside: `google-ads-unit` is adverts, `social-science` and `share-prices` aren't for sharing."""
    found = ""
    for name in names.lower().split():
        words = [w for w in re.split("[-_]+", name) if w and not w[0].isdigit()]
        marks = [w for w in words if w in MARKED or w.startswith("comment")]
        if not marks or words[0] in ABOUT:
            continue
        while words[-1] in PLACES and words[-1] not in marks:
            words.pop()
        if words[-1] in marks:
            if any(w in TALK or w.startswith("comment") for w in marks):
                return "talk"
            found = "mark"
    return found


class Lines(HTMLParser):
    """Lines of a page: text, tag count, link characters, the container that holds it and the marked element around it.

    The open elements of each tag, and the open containers, are kept as stacks of places, so that no event searches them all.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, dropped, container, marked element
        self.places: dict[str, list[int]] = {}
        self.boxes: list[int] = []
        self.parents = [0]
        self.around, self.most = [0], [0.0]  # of each marked element: the one around it, the share that keeps it
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.lines.append((line, self.tags, self.linked, *(self.open[-1][2:] if self.open else (0, 0))))
            self.tags = self.linked = 0
        self.text.clear()

    def last(self, tags) -> int:
        """The place of the innermost open element of `tags`; -1 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, *rest) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in CONTAINERS:
            self.boxes.append(len(self.open))
        self.open.append((tag, *rest))

    def pop(self) -> None:
        tag, dropped = self.open[-1][:2]
        if tag in PARTS and not dropped:
            self.end_line()
        self.links -= tag == "a"
        self.open.pop()
        self.places[tag].pop()
        if tag in CONTAINERS:
            self.boxes.pop()

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append("\n")
            elif tag == "hr":
                self.end_line()
            return
        if tag in BLOCKS and tag != "html" and self.places.get("head"):
            self.pop_to(self.places["head"][0])
        above = self.open[-1] if self.open else ("", False, 0, 0)
        if above[1]:  # what lies in a dropped element ends nothing outside of it
            self.links += tag == "a"
            self.push(tag, True, *above[2:])
            return
        box = self.boxes[-1] if self.boxes else -1
        if tag in ENDS_P and (at := self.last(("p",))) > box:
            self.pop_to(at)
        elif tag in ENDS_SAME:
            same, stop = ENDS_SAME[tag]
            bound = self.last(stop)
            while (at := self.last(same)) > bound:
                self.pop_to(at)
        if tag in PARTS:
            self.end_line()
        above = self.open[-1] if self.open else ("", False, 0, 0)
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        kind = "" if tag in ("body", "html") else marked(marks)
        if kind == "mark" and (tag in ("article", "main") or any(k == "role" and v in ("article", "main") for k, v in attrs)):
            kind = ""
        if tag == "form":
            kind = kind or "mark"
        inside = tag == "header" and self.last(("article", "main")) >= 0  # an article's own header holds its title
        dropped = above[1] or (tag in DROPPED and tag != "form" and not inside) or (bool(kind) and tag in INLINE) or any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and HIDDEN.search(v) for k, v in attrs)
        mark = above[3]
        if kind and not dropped:
            self.around.append(mark)
            self.most.append(MOST_TALK if kind == "talk" else MOST)
            mark = len(self.around) - 1
        holder = above[2]
        if tag in CONTAINERS:
            self.parents.append(holder)
            holder = len(self.parents) - 1
        self.links += tag == "a"
        self.push(tag, dropped, holder, mark)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.last((tag,))
        if at < 0:
            if tag == "p":
                self.end_line()
            return
        if tag not in CONTAINERS and self.boxes and self.boxes[-1] > at:
            return
        self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        self.text.append(data)
        if self.links and (not self.open[-1][3] or data.strip()):
            self.linked += len(data)

    def prose(self) -> np.ndarray:
        """Each line's characters outside links; none within a marked element that doesn't hold most of the page's."""
        own = np.array([len(text) - min(linked, len(text)) for text, _, linked, _, _ in self.lines], float)
        if len(self.around) == 1:
            return own
        share = np.bincount([line[4] for line in self.lines], own, len(self.around))
        for i in range(len(share) - 1, 0, -1):  # an element comes after the one around it
            share[self.around[i]] += share[i]
        stays = [True]
        for i in range(1, len(share)):
            stays.append(stays[self.around[i]] and share[i] > self.most[i] * share[0])
        return np.where([stays[line[4]] for line in self.lines], own, -1)


def regions(prose: np.ndarray, tags: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines belong to content regions: smoothed text-to-tag ratios above the threshold, excluded lines never."""
    ratio = np.maximum(prose, 0) / tags
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
    return (smooth >= (smooth.mean() - 0.5 * smooth.std()) * (1 - 1e-9)) & (prose >= 0)


def closed(html: str) -> str:
    """`html` without what never ends: a comment runs to the end of the page, a `<` without a later `>` is text."""
    start = html.find("<!--", html.rfind("-->") + 1)
    if start >= 0:
        script = max(html.rfind(x, 0, start) for x in ("<script", "<style"))
        outside = script < 0 or max(html.rfind(x, script, start) for x in ("</script", "</style")) >= 0
        html = html[:start] if outside else html[:start] + html[start:].replace("<!--", "<!-")
    end = html.rfind(">") + 1
    return html[:end] + html[end:].replace("<", "&lt;")


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by empty lines; '' for none."""
    if not html:
        return ""
    page = Lines()
    page.feed(closed(html))
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    prose = page.prose()
    tags = np.maximum([line[1] for line in page.lines], 1)
    content = regions(prose, tags)
    if not content.any():
        return ""
    # The clusters' text of every element: what it holds itself and, children coming after parents, what those hold.
    boxes, parents = [line[3] for line in page.lines], page.parents
    inside = np.bincount(boxes, np.maximum(prose, 0) * content, len(parents))
    for i in range(len(parents) - 1, 0, -1):
        inside[parents[i]] += inside[i]
    # The smallest element with nearly all of the clusters' text grows over its lines. Other lines of clusters that aren't mostly
    # links stay where they lie in an element around it, such as a heading above, or have prose's ratio of their own, so that a
    # teaser beside a paragraph doesn't.
    best = int(np.flatnonzero(inside >= 0.85 * inside[0])[-1])
    chosen = [i == best for i in range(len(parents))]
    around = {0}
    while best:
        around.add(best := parents[best])
    ratio = prose / tags
    near = content & (2 * prose >= np.array([len(line[0]) for line in page.lines]))
    near &= np.array([b in around for b in boxes]) | (ratio >= 0.25 * np.median(ratio[content]))
    for i in range(1, len(parents)):
        chosen[i] = chosen[i] or chosen[parents[i]]
    return "\n\n".join(line[0] for line, p, n in zip(page.lines, prose, near) if n or (p >= 0 and chosen[line[3]]))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html).

    A null or empty page, and one without prose, has the empty text and n_chars 0. Repeated rows and null ids are
    extracted like others; other columns don't matter; an empty table gives no rows. Nothing is shuffled.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, htmls in text_runs(batches, "html"):
            found = [main_text(h) for h in htmls]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_text": op1_html_text}
