"""Whole articles in odd wrappers, and scores against a direct formula on generated trees."""

import random

import pytest

from tidemark.llm import html_text
from tidemark.llm.html_text import main_text


def paragraph(k, n=299):
    return (f"Prose of part {k}, which goes on, and on, for a while until it is long enough to be " * 9)[:n] + "."


P = [f"<p>{paragraph(k)}</p>" for k in range(10)]
WHOLE = " ".join(paragraph(k) for k in (1, 2))


@pytest.mark.parametrize(
    "page",
    [
        f"<div>{P[1]}{P[2]}</div>",
        f'<body><form id="aspnetForm"><input type=hidden><div>{P[1]}{P[2]}</div><select><option>x</select><button>Go</button></form></body>',
        f'<body><div class="page-with-sidebar">{P[1]}{P[2]}</div></body>',
        f'<body><div class="content-sidebar"><div>{P[1]}{P[2]}</div></div></body>',
        f'<div class="ad-free">{P[1]}{P[2]}</div>',
        f"<div><div><div>{P[1]}</div></div><div><div>{P[2]}</div></div></div>",
        f'<form><div class="page-with-sidebar"><div>{P[1]}{P[2]}</div><div class="sidebar-widget">{P[3]}</div><form>{P[4]}</form></div></form>',
        f'<div><div>{P[1]}{P[2]}</div><div class="right-sidebar">{P[3]}</div><form>{P[4]}</form><div class="sidebar">{P[5]}</div></div>',
        f'<div><div>{P[1]}{P[2]}</div></div><div class="comment-list">{"".join(P[3:]) * 3}</div>',
        f'<div>{P[1]}{P[2]}</div><form class=search><p>Sign up, it is free, and we write once a week at most.</p></form>',
    ],
)
def test_whole_articles(page):
    assert main_text(page) == WHOLE


def test_parts_that_are_no_siblings():
    page = f'<div id=a><div class=r><div class=c>{P[1]}{P[2]}</div></div><h2>Between</h2><div class=r><div class=c>{P[3]}</div></div></div><div class=nav>x</div>'
    assert main_text(page) == f"{WHOLE} Between {paragraph(3)}"


def test_comments_never_come_back():
    """Even where there is nothing else."""
    assert main_text(f'<div class="post-comments">{P[3]}</div>') == "" == main_text(f"<nav>{P[1]}</nav>") == main_text(f"<footer>{P[2]}</footer>")


def test_nested_wrappers_are_tried_in_linear_time():
    assert main_text("<form><div class='page-with-sidebar'>" * 20_000 + P[1] + "</div></form>" * 20_000) == paragraph(1)


def tree(r, depth):
    """(tag, class, children or text)."""
    if depth == 0 or r.random() < 0.3:
        return ("p", "", paragraph(r.randrange(10), r.randrange(5, 250)) if r.random() < 0.8 else "short")
    return (r.choice(["div", "section", "ul", "blockquote"]), r.choice(["", "", "x", "page-with-sidebar", "sidebar-box"]), [tree(r, depth - 1) for _ in range(r.randrange(1, 4))])


def written(t):
    tag, name, inside = t
    return f'<{tag} class="{name}">{inside if isinstance(inside, str) else "".join(map(written, inside))}</{tag}>'


def listed(t, up, out):
    """Elements in page order: (element, parent's place)."""
    out.append((t, up))
    here = len(out) - 1
    for c in [] if isinstance(t[2], str) else t[2]:
        listed(c, here, out)
    return out


def test_scores_equal_a_direct_formula():
    r = random.Random(4)
    seen = 0
    for _ in range(300):
        t = ("div", "", [tree(r, 4) for _ in range(3)])
        nodes = [(("#", "", []), -1)] + [(x, up + 1) for x, up in listed(t, -1, [])]
        page = html_text._Page(written(t))
        assert page.tag == [x[0] for x, _ in nodes]
        got = html_text.tree_scores(page)
        path = lambda i: [] if i < 0 else [i, *path(nodes[i][1])]
        doubtful = [x[1] in ("page-with-sidebar", "sidebar-box") for x, _ in nodes]
        value = [1 + x[2].count(",") + min(len(x[2]) / 100, 3) if x[0] == "p" and len(x[2]) >= 25 else 0.0 for x, _ in nodes]
        # Wrappers: from the outside in, while one holds nine tenths of what it and the free text have.
        wrappers = set()
        while True:
            closed = [next((i for i in reversed(path(k)) if doubtful[i] and i not in wrappers), None) for k in range(len(nodes))]
            free = sum(v for v, c in zip(value, closed) if c is None)
            held = {c: sum(v for v, d in zip(value, closed) if d == c) for c in closed if c is not None}
            best = max(held, key=lambda c: (held[c], -c), default=None)
            if best is None or held[best] <= 0 or held[best] < 0.9 * (free + held[best]) - 1e-9:
                break
            wrappers.add(best)
        assert got.out == [c is not None for c in closed]
        seen += bool(wrappers)
        for i in range(len(nodes)):
            points = 0.0
            for k, v in enumerate(value):
                above = path(k)[1:6]
                if v and closed[k] is None and i in above:
                    level = above.index(i)
                    points += v / (1 if level == 0 else 2 if level == 1 else 3 * level)
            assert got.score[i] == pytest.approx(points)
    assert seen > 20
