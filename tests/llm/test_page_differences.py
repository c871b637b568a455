"""Every page goes through differencing, whatever its markup."""

import time

import numpy as np
import pytest

from tallywatch.llm import page_diff

PAGES = "page_id long, url string, html string"


@pytest.fixture
def ranges(spark):
    """Small ranges, so that neighbours and runs of copies lie across their edges."""
    confs = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in confs}
    for c, value in confs.items():
        spark.conf.set(c, value)
    yield
    for c, value in before.items():
        spark.conf.set(c, value)


def main_text(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    return {r.page_id: (r.text, r.n_cut) for r in page_diff.main_text(pages).collect()}


def test_pages_with_an_article_are_differenced(spark):
    own = "own words " * 9
    page = lambda i: (
        f"<nav><ul><li>Home<li>News {i}</ul></nav><article><div>Join us</div><p>{own}{i}</p>"
        f"<p>Quoted by all.</p><div>block {i}</div></article><p>Top ten</p><footer>Site</footer>"
    )
    got = main_text(spark, [(i, f"http://h.com/{i}", page(i)) for i in range(9)])
    for i in range(1, 8):
        # Home, Join us, Top ten and Site are shared; the quoted paragraph is the article's.
        assert got[i] == (f"{own}{i}\nQuoted by all.\nblock {i}", 4)
    # One neighbour is not enough against an article.
    assert got[0] == (f"Join us\n{own}0\nQuoted by all.\nblock 0", 3)


def test_one_article_without_neighbours_stays_whole(spark):
    page = "<nav>Home</nav><article><div>Join us</div><p>own</p></article>"
    assert main_text(spark, [(1, "http://h.com/1", page), (2, None, page)]) == {
        1: ("Join us\nown", 0),
        2: ("Join us\nown", 0),
    }


def test_long_templates_go(spark):
    top = "site words " * 9
    page = lambda i: f"<div>{top}</div><p>own text of number {i}</p><div>End</div>"
    got = main_text(spark, [(i, f"http://h.com/{i}", page(i)) for i in range(6)])
    assert all(got[i] == (f"own text of number {i}", 2) for i in range(1, 5))
    assert got[0][0].count("\n") == 2  # one neighbour that shares most may be a near copy


def test_beyond_copies(spark, ranges):
    page = lambda i: f"<div>Top of the site</div><p>{'own words ' * 20}{i}</p>"
    # Copies at forty places of the host, and forty that differ in their last line.
    rows = [(i, f"http://h.com/a{i:02}", page("a")) for i in range(40)]
    rows += [(100 + i, f"http://h.com/b{i:02}", page("b") + f"<p>{i}</p>") for i in range(40)]
    rows += [(200, "http://h.com/c", page("c")), (300, "http://one.com/1", page("x"))]
    rows += [(301, "http://one.com/2", page("x"))]
    got = main_text(spark, rows)
    own = "own words " * 20
    assert {got[i] for i in range(40)} == {(f"{own}a", 1)}
    assert all(got[100 + i] == (f"{own}b\n{i}", 1) for i in range(40))
    assert got[200] == (f"{own}c", 1)
    assert got[300] == got[301] == (f"Top of the site\n{own}x", 0)


def plain_main_text(rows, most=0.5, copy=0.9):
    """The operator page by page."""
    hosts, seen = {}, {}
    for _, url, html in rows:
        host, _, path = url.removeprefix("http://").partition("/")
        blocks = page_diff.page_blocks(html)
        if blocks:
            key, keys, sizes = page_diff.outline(host, "/" + path, blocks)
            seen["/" + path, key] = (keys, sizes)
            hosts.setdefault(host, set()).add(("/" + path, key))
    sides = {}
    for host, pages in hosts.items():
        for step in (-1, 1):
            order = sorted(pages)
            against = {}
            for at, page in enumerate(order):
                if 0 <= at + step < len(order):
                    beside = order[at + step]
                    against[at] = page_diff.compare(*seen[page], page[0], seen[beside][0], beside[0])
            for at, page in enumerate(order):
                found, last = against.get(at), at
                if found and found[1] > copy:
                    while last in against and against[last][1] > copy:
                        last += step
                    to = last + step
                    found = None
                    if 0 <= to < len(order):
                        found = page_diff.compare(*seen[page], page[0], seen[order[to]][0], order[to][0])
                if found and found[1] <= copy:
                    sides.setdefault((host, page), []).append((found[2], found[1], found[0]))
    out = {}
    for page_id, url, html in rows:
        host, _, path = url.removeprefix("http://").partition("/")
        blocks = page_diff.page_blocks(html)
        page = ("/" + path, page_diff.outline(host, "/" + path, blocks)[0])
        shared, both = page_diff.template(sides.get((host, page), []), most)
        kinds = page_diff.main_kinds(blocks)
        gone = {page_diff.LOOSE: shared, page_diff.BARE: both, page_diff.PROSE: ()}
        kept = [(i, line) for i, (line, kind) in enumerate(blocks) if kind in kinds and i not in gone[kind]]
        out[page_id] = ("\n".join(x for _, x in kept), len(shared - {i for i, _ in kept}))
    return out


def test_same_as_page_by_page(spark, ranges):
    rng = np.random.default_rng(8)
    tags = ["p", "div", "nav", "li", "h2", "footer"]

    def page():
        body = "".join(
            f"<{tags[t]}>{'line ' * (w + 1)}{w}</{tags[t]}>"
            for t, w in zip(rng.integers(0, 6, 7), rng.integers(0, 9, 7))
        )
        return f"<article>{body}</article><p>x" if rng.random() < 0.5 else body

    base = [page() for _ in range(60)]

    def url():
        return f"http://{'abc'[min(2, rng.integers(0, 6))]}.com/{rng.integers(0, 4)}/{rng.integers(0, 40)}"

    rows = [
        (i, url(), base[min(59, rng.integers(0, 90))] + ("" if rng.random() < 0.5 else "<p>."))
        for i in range(400)
    ]
    rows += [(400, "http://a.com/", None), (401, "http://d.com/", "<p>alone")]
    rows = [(i, u, h or "") for i, u, h in rows]
    got, want = main_text(spark, rows), plain_main_text(rows)
    assert got == want
    assert sum(n for _, n in got.values()) > 100


def test_lines_that_repeat_much():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 9, 60, 200):
        for _ in range(10):
            a, b = (rng.integers(0, 3, rng.integers(0, size + 1)).tolist() for _ in range(2))
            best = np.zeros(len(b) + 1, int)
            for x in a:
                row = best.copy()
                for j, y in enumerate(b):
                    row[j + 1] = best[j] + 1 if x == y else max(row[j], best[j + 1])
                best = row
            got = [a[i] for i in sorted(page_diff.shared_lines(a, b, pairs=0))]
            rest = iter(b)
            assert len(got) == best[-1] and all(x in rest for x in got)
    started = time.monotonic()
    assert len(page_diff.shared_lines(["-"] * 100_000, ["-"] * 90_000)) == 90_000
    a, b = (rng.integers(0, 2, 20_000).tolist() for _ in range(2))
    assert len(page_diff.shared_lines(a, b)) > 15_000
    assert time.monotonic() - started < 30


def test_what_the_markup_says():
    page = (
        "<head><title>T</title></head><div>a</div><article>b<div>c<p>d</p><b>e</b></div><ul><li><div>f</div></ul>"
        "<div class=ad>g<p>h</p></div></article><nav>i"
    )
    assert page_diff.page_blocks(page) == [
        ("T", page_diff.OUT),
        ("a", page_diff.LOOSE),
        ("b", page_diff.PROSE),
        ("c", page_diff.BARE),
        ("d", page_diff.PROSE),
        ("e", page_diff.BARE),
        ("f", page_diff.PROSE),
        ("g", page_diff.OUT),
        ("h", page_diff.OUT),
        ("i", page_diff.OUT),
    ]
