"""Main text: clusters decide, blocks stay whole, broken pages take linear time."""

import time

import numpy as np
import pytest

from docgrain.llm import html_text

PROSE = ("long prose here. " * 30).strip()


def test_the_regions_decide_on_the_tables_pages(spark, monkeypatch):
    """With every line taken for content, pages of the table come out otherwise; with article elements renamed, none does."""
    pages = [r["html"] for name in ("sf0.001", "sf0.01") for r in spark.read.parquet(f"/root/testdata/{name}/pages.parquet").select("html").collect()]
    pages += [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    want = [html_text.main_text(p) for p in pages]
    renamed = [p.replace("<article", "<div").replace("</article", "</div").replace("<main", "<div").replace("</main", "</div") for p in pages]
    assert sum(html_text.main_text(p) != w for p, w in zip(renamed, want)) <= len(pages) // 100
    monkeypatch.setattr(html_text, "regions", lambda prose, tags, sigma=1.0: prose >= 0)
    assert sum(html_text.main_text(p) != w for p, w in zip(pages, want)) > 0


def test_an_article_element_is_not_chosen_by_its_name():
    page = f"<body><article><p>A teaser of its own.</p></article><div><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p></div></body>"
    assert html_text.main_text(page).startswith("Head") and PROSE in html_text.main_text(page)


@pytest.mark.parametrize("inner", ["<script>var a = '<p>no</p>';</script>", "<style>p {}</style>", "<button>Share</button>", "<noscript><p>no</p></noscript>", "<svg><text>no</text></svg>", "<x-mark></x-mark>", "<template>no</template>"])
def test_a_paragraph_stays_one_block(inner):
    assert html_text.main_text(f"<div><p>{PROSE} and {inner} more</p><p>last</p></div>") == f"{PROSE} and more\n\nlast"


@pytest.mark.parametrize("name, kept", [("google-ads-unit", False), ("related-posts-list", False), ("cookie-message", False), ("ad_slot-2", False), ("sticky-header", False), ("social-science", True), ("notice-period", True), ("has-ads", True), ("no-sidebar", True), ("category-search", True), ("share-prices", True)])
def test_compound_names(name, kept):
    page = f"<div><p>{PROSE}</p><div class='{name}'>some other words</div><p>{PROSE}</p></div>"
    assert ("some other words" in html_text.main_text(page)) is kept


@pytest.mark.parametrize("tail", ["", ">"])
@pytest.mark.parametrize("unit", ["<a ", "<!--", "<a href='", '<a href="x> ', "<![CDATA[", "</", "<!x", "<?x", "&", "<a x='y", "<p>", "<script><!--", "</p <", "<title>"])
def test_what_never_ends_takes_linear_time(unit, tail):
    took = []
    for n in (50_000, 400_000):
        began = time.process_time()
        html_text.main_text(f"<p>{PROSE}</p>" + unit * (n // len(unit)) + tail)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_open_comments_and_tags():
    assert html_text.main_text(f"<p>{PROSE}</p><p>2 < 3<p>last <b") == f"{PROSE}\n\n2 < 3\n\nlast <b"
    assert html_text.main_text(f"<p>{PROSE}</p><!-- open <p>gone</p>") == PROSE
    assert html_text.main_text(f"<!-- a --><script><!-- x </script><p>{PROSE}</p>") == PROSE
    assert np.isfinite(len(html_text.main_text("<" * 9)))
