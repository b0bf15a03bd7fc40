"""The density sums against a plain recursive version, exact line feeds, and time on hostile pages."""

import html as html_module
import math
import re
import time

import pandas as pd
import pytest

from stockweave.llm import html_text
from stockweave.llm.html_text import main_text

DIR = "/root/testdata/sf0.01"


def article_blocks(page):
    """The generated pages keep their text in one article: its blocks, white space made one space."""
    body = re.sub(r"<[^>]*\Z", "", (page or "").partition("<article>")[2].partition("</article>")[0])
    blocks = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section|blockquote|pre|table|tr|td)\b[^>]*>", re.sub(r"<br\b[^>]*>", " ", body))
    clean = [" ".join(html_module.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks]
    return "\n".join(x for x in clean if x)


@pytest.fixture(scope="module")
def pages():
    return pd.read_parquet(f"{DIR}/pages.parquet").html.tolist()


def test_exact_text_of_every_page(pages):
    for page in pages:
        assert main_text(page) == article_blocks(page)


def test_the_tag_is_not_needed(pages):
    """Without article tags the density sums find the same text."""
    for page in pages:
        plain = re.sub(r"(</?)article\b", r"\1div", page or "")
        assert main_text(plain) == main_text(page)


def density(node, whole):
    """(characters, tags, link characters, link tags, density, sum) by plain recursion."""
    kids = [c for c in node.children if isinstance(c, html_text.Node) and not c.dropped]
    c, t, lc, lt = node.chars, node.tags, node.link_chars, node.link_tags
    return c, t, lc, lt, sum(formula(k.chars, k.tags, k.link_chars, k.link_tags, whole) for k in kids)


def formula(c, t, lc, lt, whole):
    if not c:
        return 0.0
    ratio = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    base = math.log(c / max(c - lc, 1) * lc + whole[1] / whole[0] * c + math.e)
    if ratio <= 1 or base <= 1:
        return c / max(t, 1) * 1e-3
    return c / max(t, 1) * math.log(ratio) / math.log(base)


def test_densities_by_recursion(pages):
    for page in pages[:40]:
        root = html_text.parse(page)
        order = html_text._weigh(root)
        whole = (max(root.chars, 1), root.link_chars)
        for node in order:
            if node.suspect or any(isinstance(c, html_text.Node) and c.suspect for c in node.children):
                continue
            *_, sums = density(node, whole)
            own = 0.0 if not any(isinstance(c, str) for c in node.children) else None
            if own is not None:
                assert node.total == pytest.approx(sums)
            assert node.density == pytest.approx(formula(node.chars, node.tags, node.link_chars, node.link_tags, whole))


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "text" + "</div>" * 20_000, "<div>" * 20_000 + "<p>text" + "</section>" * 20_000, "<li>" * 20_000 + "text", "<p><b>" * 20_000 + "text", "<" * 20_000 + "text", "<div " * 5_000 + "text", "<!--" * 5_000 + "text"])
def test_hostile_pages_are_quick(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 1.5
