"""Main text of pages without, with several and with misleading <article> tags."""

from stockweave.llm.html_text import main_text


def paragraphs(mark, n=6, words=30):
    return [f"{mark} {i} " + " ".join(["word"] * words) for i in range(n)]


def made(rows):
    return "".join(f"<p>{x}</p>" for x in rows)


REAL = paragraphs("real")
LINKS = "<div><ul>" + "".join(f'<li><a href="/{i}">to page {i}</a></li>' for i in range(8)) + "</ul></div>"


def test_without_article():
    assert main_text(f"<body>{LINKS}<div>{made(REAL)}</div>{LINKS}</body>") == "\n".join(REAL)
    nested = f"<body><div>{LINKS}<div><h1>Title</h1><div>{made(REAL)}</div></div></div></body>"
    assert main_text(nested) == "\n".join(["Title", *REAL])


def test_several_articles():
    others = [paragraphs("second", 9), paragraphs("third", 1, 3)]
    page = "<body>" + LINKS + "".join(f"<article>{made(x)}</article>" for x in (REAL, *others)) + "</body>"
    assert main_text(page) == "\n".join([*REAL, *others[0], *others[1]])


def test_misleading_article():
    teasers = '<article><h2>Teaser</h2><p>Read <a href="/x">more of it</a></p></article>', "<article><p>Short teaser.</p></article>"
    for teaser in teasers:
        assert main_text(f"<body>{teaser}<div>{made(REAL)}</div></body>") == "\n".join(REAL)


def test_tag_alone_changes_nothing():
    assert main_text(f"<body><div>{made(REAL)}</div></body>") == main_text(f"<body><article>{made(REAL)}</article></body>") == "\n".join(REAL)
    assert main_text("<body>hello world<p>some</p></body>") == "hello world\nsome"
