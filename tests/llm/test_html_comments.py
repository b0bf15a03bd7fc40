"""Reader comments, forms, newsletters and titles around and inside the text."""

import pytest

from stockweave.llm.html_text import main_text

REAL = [f"real {i} " + " ".join(["word"] * 30) for i in range(6)]
TEXT = "".join(f"<p>{x}</p>" for x in REAL)
NAV = '<nav><a href="/">home</a></nav>'
WANT = "\n".join(REAL)


def comments(n, words=20, mark='class="comments"'):
    return f"<div {mark}>" + "".join(f'<div class="comment"><p>reader {i} says ' + "much " * words + "</p></div>" for i in range(n)) + "</div>"


@pytest.mark.parametrize("n", [1, 40])
@pytest.mark.parametrize("mark", ['class="comments"', 'id="comments"', 'class="comment-list"', 'id="respond"', 'class="reader-comments section"', 'id="disqus_thread"'])
def test_comments_go(n, mark):
    block = comments(n, mark=mark)
    for page in (f"{NAV}<article>{TEXT}{block}</article>", f"{NAV}<article>{TEXT}</article>{block}", f"{NAV}<div>{TEXT}{block}</div>", f"{NAV}<div>{TEXT}</div>{block}", f"{NAV}<main><article>{TEXT}</article>{block}</main>"):
        assert main_text(f"<body>{page}</body>") == WANT


def test_long_comments_beside_a_short_text():
    short = "<article><p>All that happened today.</p></article>"
    assert main_text(f"<body>{short}{comments(50, 60)}</body>") == "All that happened today."
    posts = "".join(f'<article class="comment"><p>reader {i} says much more than that</p></article>' for i in range(30))
    assert main_text(f"<body><article>{TEXT}</article><section id='comments'>{posts}</section></body>") == WANT


def test_single_comments_inside_an_article():
    one = '<div class="comment"><p>a reader said this</p></div>'
    assert main_text(f"<body><article>{TEXT}{one}</article></body>") == WANT


def test_text_about_comments_stays():
    kept = '<p class="comment-free">Kept</p><section class="no-comments"><p>Kept</p></section>'
    assert main_text(f"<body><article>{TEXT}{kept}</article></body>") == WANT + "\nKept\nKept"


@pytest.mark.parametrize("tag", ["form", "fieldset"])
def test_wrapping_forms_stay(tag):
    login = '<form action="/in"><label>Name</label><input name="n"><button>Go</button></form>'
    wrapped = f'<body><{tag} id="aspnetForm"><input type="hidden" value="x">{NAV}<article>{TEXT}</article></{tag}></body>'
    assert main_text(wrapped) == WANT
    assert main_text(f"<body><{tag}><div>{TEXT}</div></{tag}></body>") == WANT
    for page in (f"<body>{login}<article>{TEXT}</article></body>", f"<body><article>{TEXT}{login}</article></body>", f"<body><article>{TEXT}<fieldset><p>Vote now</p></fieldset></article></body>"):
        assert main_text(page) == WANT
    assert main_text(f"<body>{login}</body>") == ""


@pytest.mark.parametrize("mark", ['id="newsletter"', 'id="cookie-banner"', 'class="newsletter-box"'])
def test_notices_inside_an_article_go(mark):
    assert main_text(f"<body><article>{TEXT}<div {mark}><p>Get our letters.</p></div></article></body>") == WANT


def test_a_title_beside_the_wrapper_stays():
    links = "<div><ul>" + "".join(f'<li><a href="/{i}">to page {i}</a></li>' for i in range(8)) + "</ul></div>"
    for page in (f"<h1>The title</h1>{links}<div>{TEXT}</div>", f"{links}<div><div><h1>The title</h1></div>{links}<article>{TEXT}</article></div>"):
        assert main_text(f"<body>{page}</body>") == "The title\n" + WANT
    assert main_text(f"<body><header><h1>Site</h1></header><article>{TEXT}</article></body>") == WANT
    assert main_text(f"<body><h1><a href='/'>Site</a></h1><div>{TEXT}</div></body>") == WANT
