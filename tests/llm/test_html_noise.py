"""Real text is not taken for noise by a word in its attributes, nor swallowed by a self-closed element."""

import pytest

from stockweave.llm.html_text import main_text

REAL = [f"real {i} " + " ".join(["word"] * 30) for i in range(6)]
TEXT = "".join(f"<p>{x}</p>" for x in REAL)
AD = '<div class="ad">Buy now.</div>'
LINKS = '<ul class="social-links"><li><a href="/a">follow us here</a></li><li><a href="/b">and there</a></li></ul>'


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'class="overflow-hidden"', 'data-x="display:none"', 'class="no-sidebar"', 'class="ad"', 'id="comments"', "title='hidden'"])
def test_wrapper_of_the_text_stays(attrs):
    for page in (f"<body>{AD}<div {attrs}><article>{TEXT}</article></div></body>", f"<body>{AD}<div {attrs}>{TEXT}</div></body>"):
        assert main_text(page) == "\n".join(REAL)


@pytest.mark.parametrize("block", ['<h2 id="search">Kept</h2>', '<section id="discussion"><p>Kept</p></section>', '<p class="notice-period">Kept</p>', '<p class="notice">Kept</p>', '<section class="discussion"><p>Kept</p>' + TEXT + "</section>"])
def test_blocks_of_the_text_stay(block):
    got = main_text(f"<body><article>{TEXT}{block}{TEXT}</article></body>").split("\n")
    assert got == [*REAL, "Kept", *(REAL if len(block) > 200 else []), *REAL]


@pytest.mark.parametrize("block", [AD, LINKS, "<div hidden><p>x</p></div>", '<p style="color:red; display: none">x</p>', '<p style="visibility:hidden">x</p>', '<div role="search">x</div>'])
def test_noise_goes(block):
    for page in (f"<body>{block}<article>{TEXT}</article></body>", f"<body><article>{TEXT}{block}</article></body>", f"<body>{block}<div>{TEXT}</div></body>"):
        assert main_text(page) == "\n".join(REAL)


@pytest.mark.parametrize("raw", ["<svg/>", '<svg viewBox="0 0 1 1" />', '<iframe src="/x"/>', "<object/>", "<svg><p>x</p></svg>", "<script>var a = '<p>x</p>';</script>", "<template-x>"])
def test_self_closed(raw):
    assert main_text(f"<body><article>{raw}{TEXT}</article></body>") == "\n".join(REAL)


def test_a_noisy_block_without_rival():
    assert main_text('<body><div class="notice"><p>all there is</p></div></body>') == "all there is"
    posts = "".join(f'<div class="comment">{x * 3}</div>' for x in REAL)
    assert main_text(f"<body>{posts}</body>") == "\n".join(x * 3 for x in REAL)
