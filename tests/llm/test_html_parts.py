"""What belongs to an article: attributes by name, whole names, and density where no tag says it."""

import math
import os
import re
from html.parser import HTMLParser

import pytest

from floodwatch.llm import html_text
from floodwatch.llm.common import read

SAID = [f"{'long words of prose here ' * 9}{i}" for i in range(12)]
PROSE = [f"<p>{x}</p>" for x in SAID]


@pytest.mark.parametrize("part,text", [
    ('<p title="a hidden gem">{}</p>', True), ('<h2 id="related-work">{}</h2>', True), ('<section id="market-share"><p>{}</p></section>', True),
    ('<p class="notice">{}</p>', True), ('<section class="search-algorithms"><p>{}</p></section>', True), ('<p data-x="display: none">{}</p>', True),
    ('<noscript><p>{}</p></noscript>', True), ('<div class="menu-of-the-day"><p>{}</p></div>', True), ("<div title='class=\"ad\"'><p>{}</p></div>", True),
    ('<p style="color: red; display : none">{}</p>', False), ('<div hidden><p>{}</p></div>', False), ('<div aria-hidden=true><p>{}</p></div>', False),
    ('<div class="cookie-notice"><p>{}</p></div>', False), ('<section id="comments"><p>{}</p></section>', False), ('<div class="x ad-slot-3"><p>{}</p></div>', False),
    ('<p class="advert">{}</p>', False), ('<div role="complementary"><p>{}</p></div>', False), ('<ul class="related-posts"><li>{}</li></ul>', False)])
@pytest.mark.parametrize("around", ["article", "div"])
def test_names_count_whole_and_attributes_by_name(part, text, around):
    page = f"<html><body><nav><a href='/'>Home</a></nav><{around}>{''.join(PROSE[:6])}{part.format(SAID[8])}{''.join(PROSE[6:8])}</{around}></body></html>"
    if around == "div" and part.startswith("<noscript"):
        text = False          # outside an article it is a notice to browsers
    assert html_text.extract(page).split("\n\n") == [*SAID[:6], *([SAID[8]] if text else []), *SAID[6:8]]


def test_a_page_keeps_its_text_without_article_tags(spark):
    folder = next((d for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.001") if os.path.isdir(d)), None)
    if folder is None:
        pytest.skip("test tables are not here")
    pages = [r.html for r in read(spark, folder, "pages").collect()]
    assert len(pages) > 20 and all(html_text.extract(p) == html_text.extract(re.sub(r"(</?)(article|main)\b", r"\1div", p)) for p in pages if p)


class Counter(HTMLParser):
    """Characters, tags, link characters and link tags below every element, straight from the events of another parser."""

    def __init__(self):
        super().__init__()
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        for e in self.open:
            e[2] += 1
            e[4] += tag == "a"
        self.open.append([tag, 0, 0, 0, 0])
        self.found.append(self.open[-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        n, linked = len("".join(data.split())), any(e[0] == "a" for e in self.open)
        for e in self.open:
            e[1] += n
            e[3] += n if linked else 0


def test_densities_equal_those_counted_by_another_parser():
    page = ("<html><body><div><h1>Head &amp; tail</h1><p>One <b>two</b> <a href='x'>three four</a> five</p><ul><li><a href='y'>six</a></li><li>seven</li></ul></div>"
            f"<div>{''.join(PROSE[:3])}</div></body></html>")
    counter = Counter()
    counter.feed(page)
    root = html_text.parse(page)
    mine = html_text.measure(root)
    assert [n.tag for n in mine] == [e[0] for e in counter.found]
    body = counter.found[0]
    for node, (tag, c, t, l, k) in zip(mine, counter.found):
        if tag == "a":
            l = c                     # a link's own characters are all inside a link
        assert (node.chars, node.tags, node.links, node.link_tags) == (c, t, l, k)
        n = max(1, c - l)
        t, l, k = max(1, t), max(1, l), max(1, k)
        base = c / n * l + body[3] / body[1] * c + math.e
        assert math.isclose(node.density, c / t * max(0.0, math.log(max(1.0, c / l * t / k)) / math.log(math.log(base))), rel_tol=1e-9)
