import math
import random

import pytest

from helixframe.llm import html_text
from helixframe.llm.html_text import extract_text, main_text

LONG = "This is a paragraph with quite a few words, and it goes on for a while so that it is dense. "
CASES = {
    "article": ("<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class=ad>Buy</div><article><h1>Head</h1><p><b>One.<br><p>Two &amp; three&nbsp;x</p></article><footer>&copy; me</footer></body></html>", "Head\nOne.\nTwo & three x"),
    "cut off": ("<body><nav><a>m</a></nav><article><h1>H</h1><p>Text &am", "H\nText &am"),
    "cut tag": ("<article><p>Text<a hre", "Text"),
    "comments": (f"<body><main><p>{LONG}</p><section id='comments'><p>Nice post {LONG}</p></section><form><p>Your name</p></form></main><aside>Side</aside></body>", LONG.strip()),
    "plain divisions": (f"<body><div class=header>Site</div><div><div><p>{LONG}</p><p>{LONG}</p></div><div><p>Short end here.</p></div></div><div><a href=1>one</a> <a href=2>two</a></div></body>", f"{LONG.strip()}\n{LONG.strip()}\nShort end here."),
    "white space": ("<article><p>a\n  b\t c</p><ul><li>d<li>e</ul><table><tr><td>f<td>g</table><pre>h\n i</pre></article>", "a b c\nd\ne\nf\ng\nh i"),
    "cookie notice": (f"<body><div class='cookie-notice'><p>We use cookies. {LONG}</p></div><article class='post'><header><h1>T</h1></header><p>Body</p></article></body>", "T\nBody"),
    "wrapper named after a sidebar": (f"<body><div class='has-sidebar'><h1>T</h1><p>{LONG}</p></div></body>", f"T\n{LONG.strip()}"),
    "no markup": ("just text &lt;3", "just text <3"),
    "only boilerplate": ("<body><nav>x</nav><script>y</script></body>", ""),
    "hidden comment": ("<article><!-- secret <p>no</p> --><p>yes</p></article>", "yes"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, expected = CASES[name]
    assert main_text(page) == expected


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").split("\n")) == 3000


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "mine"), (2, "", None), (3, "<p>é</p>", "x"), (3, "<p>é</p>", "x")], "page_id long, html string, Text string")
    got = extract_text(df).collect()
    assert [(r["text_"], r.n_chars) for r in got] == [("", 0), ("", 0), ("é", 1), ("é", 1)] and got[0]["Text"] == "mine"
    assert extract_text(df.limit(0)).count() == 0


def test_neutral_names_leave_the_choice_to_density():
    page = f"<body><div id=wrap><div>Welcome to the site of ours</div><div><p>{LONG}</p><p>{LONG * 2}</p><p>{LONG}</p></div><div>Copyright, all rights reserved</div></div></body>"
    assert main_text(page) == "\n".join(x.strip() for x in (LONG, LONG * 2, LONG))
    comments = f"<body><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div id=comments>" + f"<div class=comment><p>{LONG}</p></div>" * 6 + "</div></body>"
    assert main_text(comments) == f"T\n{LONG.strip()}\n{LONG.strip()}"
    articles = f"<body><article><p>{LONG}</p><p>{LONG}</p></article><div><a href=1>one</a> <a href=2>two</a></div><article><p>{LONG}</p></article></body>"
    assert main_text(articles).count(LONG.strip()) == 3 and "one" not in main_text(articles)


def test_names_with_words_of_a_subject_cut_nothing():
    for part in ("<p class='share-price'>The price fell.</p>", "<section id='widget-design'><p>How to draw them.</p></section>", "<section class='html-tags'><p>They are many.</p></section>"):
        inner = html_text.TreeBuilder()
        inner.feed(part)
        inner.close()
        words = "".join(x for y in html_text._below(inner.root) for x in y.items if isinstance(x, str))
        assert main_text(f"<body><nav>x</nav><article><h1>T</h1><p>{LONG}</p>{part}<p>{LONG}</p></article></body>") == f"T\n{LONG.strip()}\n{words}\n{LONG.strip()}"
    for name in ("post-comments", "commentList", "cookie-notice js", "ad-300x250", "related-posts"):
        assert main_text(f"<body><article><h1>T</h1><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article></body>") == f"T\n{LONG.strip()}"
    # Beside the chosen part such a name is a weight: the same words stay or go with their density.
    for name, kept in (("market-share", False), ("market", True)):
        page = f"<body><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='{name}'><p>{LONG[:40]}</p></div></body>"
        assert (LONG[:40].strip() in main_text(page).split("\n")) == kept


def test_short_paragraphs_beside_the_text_are_asked_for_their_density():
    text = f"<h1>T</h1><p>{LONG * 3}</p><p>{LONG * 2}</p>"
    replies = "".join(f"<p>{x}</p>" for x in ("Nice post!", "Me too.", "First", "Thanks a lot"))
    page = f"<body><div class=c1>{text}</div><div class=c2>{replies}</div></body>"
    assert main_text(page) == f"T\n{(LONG * 3).strip()}\n{(LONG * 2).strip()}"
    assert main_text(page.replace(replies, f"<p>{LONG * 3}</p><p>{LONG * 3}</p>")).count(LONG.strip()) == 11
    assert main_text(page.replace(replies, "<p>An end.</p>")).endswith("\nAn end.")


def brute_counts(x, linked=False):
    """Characters, tags, link characters and link tags of a subtree."""
    if isinstance(x, str):
        n = len(x.replace(" ", "").replace("\n", ""))
        return n, 0, n if linked else 0, 0
    linked = linked or x.tag == "a"
    parts = [brute_counts(y, linked) for y in x.items if isinstance(y, str) or not y.dropped]
    c, t, lc, lt = (sum(p[k] for p in parts) for k in range(4))
    inner = [y for y in x.items if isinstance(y, html_text.Node) and not y.dropped]
    return c, t + len(inner), lc, lt + sum(y.tag == "a" for y in inner)


def brute_density(item, body):
    """Composite density straight from the definition, walking each subtree anew."""
    def inside_link(x):
        return x is not None and (x.tag == "a" or inside_link(x.parent))

    c, t, lc, lt = brute_counts(item, inside_link(item.parent))
    bc, _, blc, _ = brute_counts(body)
    if not c:
        return 0.0
    t, lc1, lt, rest = t or 1, lc or 1, lt or 1, (c - lc) or 1
    base = math.log(c / rest * lc1 + blc / max(bc, 1) * c + math.e)
    weight, up = 1.0, item
    while up is not None:
        weight *= 0.2 if up.marked or up.hinted else 1
        up = up.parent
    return weight * c / t * math.log(max(c / lc1 * t / lt, 1.0), base)


def random_page(rng, tags):
    def tree(depth):
        tag = rng.choice(tags)
        inner = "".join(rng.choice(["words of text " * rng.randint(1, 9), tree(depth - 1) if depth else ""]) for _ in range(rng.randint(1, 5)))
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    return "".join(tree(4) for _ in range(3))


def parsed(page):
    builder = html_text.TreeBuilder()
    builder.feed(page)
    builder.close()
    return builder.root


TAGS = ["div", "div", "section", "p", "a", "span", "nav", "div class=sidebar", "div class=share-price"]


def test_densities_and_choice_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        root = parsed(random_page(rng, TAGS))
        nodes = list(html_text._below(root))
        expected = [brute_density(x, root) for x in nodes]
        sums = [sum(brute_density(y, root) for y in x.items if isinstance(y, html_text.Node) and not y.dropped) for x in nodes]
        chosen = html_text._content(root)
        assert [x.density for x in nodes] == pytest.approx(expected)
        if max(sums) > 0:
            best = nodes[max(range(len(nodes)), key=lambda i: sums[i])]
            assert id(best) in chosen


def paragraphs_of(x):
    """The paragraphs that hold a part's text, or None where some stands outside of them or below a doubtful name."""
    if isinstance(x, str):
        return None if x.strip() else []
    if x.dropped or x.marked:
        return []
    if x.hinted:
        return None
    if x.tag in html_text.PROSE:
        return [x]
    inner = [paragraphs_of(y) for y in x.items]
    return None if None in inner else sum(inner, [])


def brute_text(page):
    """The whole output from the rules as the module states them, by recursion over the tree as parsed."""
    root = parsed(page)

    def elements(x):
        return [y for y in x.items if isinstance(y, html_text.Node) and not y.dropped]

    def below(x):
        return [x] + [z for y in elements(x) for z in below(y)]

    def above(x):
        return [] if x is None else [x, *above(x.parent)]

    def total(x):
        return sum(density[id(y)] for y in elements(x))

    every = below(root)
    density = {id(x): brute_density(x, root) for x in every}
    counts = {id(x): brute_counts(x, any(y.tag == "a" for y in above(x))) for x in every}
    best = max(every, key=total)
    path, taken = [], [root]
    if total(best) > 0:
        path = above(best)
        threshold = min(density[id(x)] for x in path)
        for x in every:
            c, _, lc, lt = counts[id(x)]
            x.dropped = lt >= 2 and lc >= 0.6 * c and x not in path and not any(y.main for y in above(x.parent))
        top = next((x for x in reversed(path) if x.main), best)
        taken = [top]
        for x in path[path.index(top) + 1 :]:
            for y in x.items:
                if isinstance(y, str):
                    n, ratio = len(y.replace(" ", "").replace("\n", "")), counts[id(root)][2] / counts[id(root)][0]
                    if n and n * math.log(n, math.log(1 + ratio * n + math.e)) >= threshold:
                        taken.append(y)
                elif y not in path and not y.dropped and not y.marked:
                    own, inner = max(below(y), key=total), paragraphs_of(y) or []
                    c, _, lc, _ = counts[id(y)]
                    if c and lc < 0.6 * c and (sum(counts[id(z)][0] > 0 for z in inner) == 1 or any(z.tag == "h1" for z in inner)):
                        taken.append(y)
                    elif density[id(y)] >= threshold:
                        taken.append(own if total(own) > 0 else y)
    lines = [""]

    def show(x, inside):
        inside = inside or any(x is y for y in taken)
        if isinstance(x, str):
            lines[-1] += x if inside else ""
        elif not x.dropped and (not x.marked or x in path):
            block = [""] if x.tag in html_text.BLOCKS else []
            lines.extend(block)
            for y in x.items:
                show(y, inside)
            lines.extend(block)

    show(root, False)
    return "\n".join(" ".join(x.split()) for x in lines if x.strip())


def test_whole_output_against_brute_force():
    rng = random.Random(8)
    seen = set()
    for i in range(300):
        page = random_page(rng, TAGS + ["article", "h1", "ul", "div class=post-comments"] if i % 2 else TAGS)
        got = main_text(page)
        assert got == brute_text(page), page
        seen.add(len(got) * 4 // (len(page) + 1))
    assert len(seen) >= 3  # little and much was kept
