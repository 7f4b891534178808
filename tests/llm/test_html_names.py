"""Classes that name a part of the page on a block that holds the article; self-closing svg and math."""

from __future__ import annotations

import random
import time

import pytest

pytest.importorskip("tokenizers")

from paperloom.llm import html_extraction as H  # noqa: E402
from paperloom.llm.html_extraction import extract  # noqa: E402

TEXT = "The article goes on, with commas, over a line that is long enough to score well, and then it ends."
SIDE = "<div class='left-sidebar'><p>Other things, in short.</p></div>"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-ads", "sidebar"])
def test_wrapper_named_like_a_part(name):
    assert extract(f"<body><div class='{name}'><p>{TEXT}</p><p>{TEXT}</p>{SIDE}</div></body>").startswith(f"{TEXT} {TEXT}")
    if name != "sidebar":
        assert "Other things" not in extract(f"<body><div class='{name}'><p>{TEXT}</p><p>{TEXT}</p>{SIDE}</div></body>")


def test_small_blocks_still_go():
    assert extract(f"<body><div><p>{TEXT}</p><p>{TEXT}</p></div><div class='ad'><p>Buy, buy, buy, it is long enough to score well.</p></div>{SIDE}</body>") == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("tag", ["svg", "math"])
def test_self_closing(tag):
    assert extract(f"<body><div><p>One.</p><{tag} width='3'/><p>{TEXT}</p></div></body>") == f"One. {TEXT}"


@pytest.mark.parametrize("page", ["<div>text, and more words here", "<div><p>a, b", "<div class=sidebar-wrap><p>some words, here", "<span>x", "</section><li>a"])
def test_deep_pages_take_time_in_proportion(page):
    took = []
    for n in (5_000, 50_000):
        start = time.perf_counter()
        text = extract(page * n + "</section></div></b>" * n)
        took.append(time.perf_counter() - start)
    assert text.count("a, b") in (0, 50_000) and took[1] < 30 * took[0] + 2


def test_a_page_in_one_form_stays():
    article = f"<div><p>{TEXT}</p><p>{TEXT}</p></div>"
    assert extract(f"<body><form id=f><input><div>{article}</div></form></body>") == f"{TEXT} {TEXT}"
    assert extract(f"<body><form id=f>{article}</form><p>foot.</p></body>").startswith(f"{TEXT} {TEXT}")
    assert "Subscribe" not in extract(f"<body>{article}<form><p>Subscribe, now, and so on.</p></form></body>")
    assert extract("<form><label>Name</label><input></form>") == ""


@pytest.mark.parametrize("wrappers", [0, 1, 2, 4, 7, 9, 12, 40])
def test_paragraphs_wrapped_one_by_one_stay(wrappers):
    long = "w" * 10 + " six words of a long line without any sign" * 2 + " and an end here."
    block = "<div>" * wrappers + f"<p>{long}</p>" + "</div>" * wrappers
    page = f"<body><div id=x>{block * 6}</div><div><p>Buy, now, or, never, see, it, all, here, today, ok.</p></div></body>"
    assert extract(page).count(long) == 6


def test_words_in_a_sentence_stay():
    assert extract(f"<body><div><p>Press <button>OK</button> and fill in <label>your name</label>, then wait.</p><p>{TEXT}</p><button>Share</button></div></body>") == f"Press OK and fill in your name, then wait. {TEXT}"


def brute_scores(root):
    """Each element's score by looking at every paragraph below it and every step between: recursive and quadratic."""

    def below(node):
        for c in node.children:
            if isinstance(c, H.Node) and not c.drop:
                yield c
                yield from below(c)

    def points(p):
        text = H.own_text(p) if p.tag in H.PARAGRAPH else ""
        if not text:
            return 0.0
        full = 1 + text.count(",") + min(len(text) / 100, 3)
        return full * (1 - min(H.link_density(p), 1)) if p.tag in ("p", "li", "td") else full

    def arrives(p, node):
        """What of p's points gets to node."""
        share, at = 1.0, p
        while at is not node:
            if at is not p or p.tag in H.CONTAINER:
                alone = not any(isinstance(c, str) and c.strip() for c in at.children) and len([c for c in at.children if isinstance(c, H.Node) and not c.drop and "".join(H.blocks(c)).strip()]) == 1
                share *= 1 if alone else 0.5
            at = at.parent
        return share * points(p)

    return {id(x): sum(arrives(p, x) for p in [*below(x), *([x] if x.tag in H.CONTAINER else [])]) for x in [root, *below(root)]}


@pytest.mark.parametrize("seed", range(12))
def test_scores_are_those_of_all_pairs(seed):
    rng = random.Random(seed)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["some words, here ", "a, b, c, d ", "", " ", "<a href=x>link, it is</a> ", "<span>inline</span> ", "x" * 250])
        tag = rng.choice(["div", "div", "section", "p", "ul", "li", "blockquote", "article", "span", "nav", "table"])
        return f"<{tag}>" + "".join(part(depth - 1) for _ in range(rng.randint(0, 3))) + f"</{tag}>"

    root = H.parse("<body>" + "".join(part(6) for _ in range(5)) + "</body>")
    order = H.measure(root)
    H.set_scores(order)
    expected = brute_scores(root)
    for x in order:
        assert x.score == pytest.approx(expected[id(x)])
