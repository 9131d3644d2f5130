import math

import pytest

from graphloom.llm import html
from graphloom.llm.html import extract, extract_pages

LONG = "A paragraph with a good many words that say something at length, so that it is dense."
CASES = {
    "<article><h1>T &amp; U</h1><p>One\n two&nbsp;three</p><p>Four<br>five</article>": "T & U\n\nOne two three\n\nFour five",
    f"<nav><ul><li><a href=1>a</a><li><a>b</a></ul></nav><div class='x'><div><p>{LONG}<p>{LONG}</div></div><footer>&copy; x</footer>": f"{LONG}\n\n{LONG}",
    f"<body class='has-sidebar'><div id=c><h2>Head</h2><div><p>{LONG}</p><p>{LONG}</p></div></div><div class=sidebar><p>{LONG}</p></div><div class='post-comments'><p>{LONG}</p></div>": f"Head\n\n{LONG}\n\n{LONG}",
    f"<main><p>{LONG}</p><form><p>{LONG}</p></form><aside>{LONG}</aside><p hidden>{LONG}</p></main>": LONG,
    "<script>var t='<p>no</p>'</script><style>p{}</style><p title='hidden a>b'>A<!-- no -->B</p>": "AB",
    "plain &lt;b&gt; text": "plain <b> text",
    f"<article><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>2</mn></math> <object>in <b>place</b></object></p></article>": f"{LONG}x=2 in place",
    "<p>a<![CDATA[bcdef": "abcdef",
    "<p>a<![CDATA[b]]>c": "abc",
    "<p><b>Open<br><p>Next</b> one": "Open\n\nNext one",
    "<div>a<b>b</div>c</b>": "ab\n\nc",
    "<p title=\"cut>still text": "still text",
    "": "",
    "<nav>only menu</nav>": "",
    "<p>end of <!-- cut": "end of",
    "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>": "deep",
}


@pytest.mark.parametrize("page", CASES, ids=range(len(CASES)))
def test_pages(page):
    assert extract(page) == CASES[page]


LINKS = "".join(f"<li><a href={i}>entry {i}</a>" for i in range(9))
#: Pages whose boilerplate no tag, role, class or id names: only densities tell.
UNNAMED = {
    f"<body><div><ul>{LINKS}</ul></div><div><h1>Head</h1><p>{LONG}<p>{LONG}</div><div><a>About us</a> <a>Jobs</a></div>": f"Head\n\n{LONG}\n\n{LONG}",
    f"<body><div>Buy now.</div><div><div>{''.join(f'<p>{LONG}' for _ in range(3))}</div><ul>{LINKS}</ul></div>": "\n\n".join([LONG] * 3),
    f"<body><p>{LONG}<ul>{LINKS}</ul><p>{LONG}<p>Short.<p>{LONG}": f"{LONG}\n\n{LONG}\n\nShort.\n\n{LONG}",
    f"<body><div>{''.join(f'<p>{LONG}' for _ in range(3))}<div>{''.join(f'<p>{LONG}' for _ in range(6))}</div></div><div>{LINKS}</div>": "\n\n".join([LONG] * 9),
}


@pytest.mark.parametrize("page", UNNAMED, ids=range(len(UNNAMED)))
def test_density_decides(page, monkeypatch):
    assert extract(page) == UNNAMED[page]
    # without the densities the same pages come out whole
    monkeypatch.setattr(html, "content", lambda nodes: nodes[:1])
    assert extract(page) != UNNAMED[page]


def counted(node):
    """(characters, tags, link characters, link tags) of a subtree, by plain recursion."""
    if node.skip:
        return 0, 0, 0, 0
    if node.tag == "":
        return len(" ".join(node.text.split())), 0, 0, 0
    c, t, lc, lt = (sum(x) for x in zip((0, 0, 0, 0), *map(counted, node.children)))
    t += sum(1 for n in node.children if n.tag and not n.skip)
    return (c, t, c, lt + 1) if node.tag == "a" else (c, t, lc, lt)


def test_densities_equal_the_formula():
    page = f"<body><div><p>{LONG} <a>link</a></p><ul>{LINKS}</ul><nav>{LINKS}</nav></div><p>{LONG}</p>"
    root, nodes = html.tree(page)
    html.densities(nodes)
    all_c, _, all_lc, _ = counted(root)
    for node in nodes:
        if node.tag == "" or node.skip or not counted(node)[0]:
            continue
        c, t, lc, lt = (max(x, 1) for x in counted(node))
        base = math.log(c / max(c - lc, 1) * lc + all_lc / all_c * c + math.e)
        assert node.density == pytest.approx(max(c / t * math.log(max(c / lc * t / lt, 1) + 1e-9, base), 0))
        assert node.total == pytest.approx(sum(n.density for n in node.children if n.tag not in html.FORMATTING))


def test_the_winner_has_the_greatest_sum():
    for page in UNNAMED:
        _, nodes = html.tree(page)
        html.densities(nodes)
        best = max(n.total for n in nodes)
        assert any(n.total == best or any(m.total == best for m in n.children) for n in html.content(nodes))


def test_table_with_nulls_and_repeats(spark):
    rows = [(1, "u", "<p>é</p>", "z"), (1, "u", "<p>é</p>", "z"), (2, None, None, None), (None, "v", "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in extract_pages(df).collect())
    assert got == [("1", "u", "é", 1), ("1", "u", "é", 1), ("2", "None", "", 0), ("None", "v", "", 0)]
    assert extract_pages(df.limit(0)).count() == 0


def test_a_very_long_page_is_read_whole():
    n = 20_000
    assert extract("<body>" + "".join(f"<p>word {i} &amp; more" for i in range(n))).count("\n\n") == n - 1
