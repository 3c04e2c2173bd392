import random

from verdancy.llm import html
from verdancy.llm.html import _Host, _packed, _unpacked, aligned, article_rule, extract, folded, main_text, page_nodes

PAGES = "page_id long, url string, html string, host string, wrapper string, text string, rule string, part long"


def page(n, body, foot="<footer>&copy; x</footer>"):
    items = "".join(f"<li><a href='/{k}'>item {k}</a></li>" for k in range(n))
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul>{items}</ul></nav><div class='ad'>buy</div><article><h1>Head</h1>{body}</article><div id='comments'><p>nice</p></div>{foot}</body></html>"


def keys(nodes):
    return [k for k, _ in nodes]


def table(spark, pages, hosts="http://a.b/"):
    return spark.createDataFrame([(i, f"{hosts}{i}", p, "h", "w", "t", "r", 1) for i, p in enumerate(pages)], PAGES)


def test_repeats_fold_and_streams_align():
    assert keys(folded([(k, None) for k in "ababc"])) == [("+", ("a", "b")), "c"]
    one, many = "<p>x</p>", "<p>x</p><p>y</p><p>z</p>"
    wrapper = aligned(page_nodes(page(1, one)), page_nodes(page(5, many)))
    form = keys(wrapper)
    wrapper = aligned(wrapper, page_nodes(page(1, one)))
    assert keys(wrapper) == form == keys(aligned(wrapper, page_nodes(page(5, many))))
    assert any(k[0] == "+" for k in form if not isinstance(k, str))
    optional = aligned(wrapper, page_nodes(page(2, "<blockquote>q</blockquote>")))
    assert any(k[0] == "?" for k in keys(optional) if not isinstance(k, str))
    assert all("article" in s for s in article_rule(optional, 4))


def test_texts_that_differ_make_slots():
    wrapper = aligned(page_nodes("<div><b>same</b><p>one</p></div>"), page_nodes("<div><b>same</b><p>two</p></div>"))
    texts = {k[1:]: sorted(n for n, _ in x.seen.values()) for k, x in wrapper if k[0] == "#"}
    assert texts == {"div>b": [2], "div>p": [1, 1]}
    back, pages = _unpacked(_packed(wrapper, 2))
    assert pages == 2 and keys(back) == keys(wrapper) and _packed(back, 2) == _packed(wrapper, 2)


def test_text_of_pages(spark):
    rows = [
        (1, "http://a.b/1", page(3, "<p>One  &amp;\n two&nbsp;x<br>three</p><p>vier <b>fett</b>er</p>")),
        (2, "http://a.b/2", page(1, "<p>open<p>next<aside>no</aside><form>no</form>")),
        (3, None, None),
        (4, "http://c.d/", "<div class='menu'>m</div><div><p>plain</p> text &lt;b&gt;</div>"),
        (5, "http://a.b/5", ""),
        (6, "http://a.b/6", "<article><p>cut off <b"),
        (1, "http://a.b/1", page(3, "<p>again</p>")),
    ]
    got = sorted((r.page_id, r.text) for r in extract(spark.createDataFrame([(*r, "", None, "", None, 0) for r in rows], PAGES)).collect())
    assert got == [(1, "Head\nOne & two x\nthree\nvier fetter"), (1, "Head\nagain"), (2, "Head\nopen\nnext"), (3, ""), (4, "plain\ntext <b>"), (5, ""), (6, "cut off <b")]


def bare(r, k):
    """A page whose parts have no telling names: notice, menu and legal lines in plain elements, the article between."""
    words = [f"w{r.randrange(9999)}" for _ in range(60)]
    links = "".join(f"<li><a href='/{r.randrange(99)}'>to {r.choice(words)}</a></li>" for _ in range(r.randrange(4, 9)))
    article = [" ".join(r.choices(words, k=25)) for _ in range(r.randrange(2, 6))]
    extra = "<div><p>Only now: half price</p></div>" if k % 10 < 7 else ""
    body = "".join(f"<p>{x}</p>" for x in article)
    return f"<body><div><p>We keep small files on your device</p></div><ul>{links}</ul><div>{extra}<h2>{words[0]}</h2>{body}</div><div><p>All rights are ours</p></div></body>", "\n".join([words[0], *article])


def test_template_without_telling_names_goes(spark):
    """Constants of a host and repeated groups of links go by the wrapper alone; without it they stay."""
    r = random.Random(5)
    made = [bare(r, k) for k in range(60)]
    got = {x.page_id: x.text for x in extract(table(spark, [m[0] for m in made]).repartition(7)).collect()}
    assert got == {i: m[1] for i, m in enumerate(made)}
    assert all("We keep small files" in main_text(m[0], None) for m in made)


def test_copies_are_no_template(spark):
    """A host whose pages are mostly copies of one article loses none of it."""
    one = "<body><div><h1>A</h1><p>the very same words</p><p>twice</p></div></body>"
    other = "<body><div><h1>B</h1><p>some other words</p></div></body>"
    got = [x.text for x in extract(table(spark, [one] * 20 + [other] * 5)).collect()]
    assert got.count("A\nthe very same words\ntwice") == 20 and got.count("B\nsome other words") == 5


def test_names_of_elements_around_the_article_void_nothing():
    for around in ("<body class='no-sidebar has-comments'><article class='with-header'>{}</article></body>", "<body class='comments-open'><form><div>{}</div></form><div class='ad'>buy</div></body>"):
        assert main_text(around.format("<p>text of the page, a long one</p>"), None) == "text of the page, a long one"


def test_wrappers_of_many_partitions_meet(spark, monkeypatch):
    """The same rules whether a host is in one partition or its wrappers meet in several rounds."""
    r = random.Random(8)
    made = [bare(r, k) for k in range(40)]
    monkeypatch.setattr(html, "FAN", 3)
    got = {x.page_id: x.text for x in extract(table(spark, [m[0] for m in made]).repartition(13)).collect()}
    assert got == {i: m[1] for i, m in enumerate(made)}


def test_many_forms_and_long_streams(monkeypatch):
    monkeypatch.setattr(html, "HELD_STREAMS", 4)
    monkeypatch.setattr(html, "LONG", 60)
    r, host = random.Random(2), _Host()
    for _ in range(40):
        body = "".join(f"<{t}>{r.randrange(10**6)}</{t}>" for t in r.choices(["p", "h2", "h3", "pre", "blockquote", "dl"], k=r.randrange(3, 40)))
        host.add(page_nodes(f"<body><div><i>fixed</i></div><div>{body}</div></body>"), 1)
    rule = article_rule(host.wrapper(), host.pages)
    assert {p.rsplit(">", 1)[1] for p in rule} == {"p", "h2", "h3", "pre", "blockquote", "dl", "i"}
    assert [len(h) for p, h in rule.items() if p.endswith(">i")] == [1]


def test_counts_and_empty_table(spark):
    r = extract(table(spark, ["<p>é\U0001f600</p>"])).first()
    assert (r.text, r.n_chars) == ("é\U0001f600", 2)
    assert extract(spark.createDataFrame([], PAGES)).collect() == []


def test_very_long_page():
    text = "<article>" + "<p>abc def</p>" * 20_000 + "</article>"
    assert main_text(text, None).count("\n") == 19_999


def ruled(pages):
    host = _Host()
    for p in pages:
        host.add(page_nodes(p), 1)
    rule = {p: frozenset(h) for p, h in article_rule(host.wrapper(), host.pages).items()}
    return [main_text(p, rule) for p in pages]


def test_headings_and_lists_of_links_of_an_article_stay():
    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(9999)}" for _ in range(n))
    made = [(words(20), words(20), [words(2) for _ in range(5)]) for _ in range(12)]
    links = lambda some: "".join(f"<li><a href='/{k}'>{x}</a></li>" for k, x in enumerate(some))
    pages = [f"<body><nav><ul>{links(['a', 'b', 'c'])}</ul></nav><article><h2>Ingredients</h2><p>{a}</p><h2>Method</h2><p>{b}</p><ul>{links(c)}</ul></article></body>" for a, b, c in made]
    assert ruled(pages) == ["\n".join(["Ingredients", a, "Method", b, *c]) for a, b, c in made]
    pages = [f"<body><div><p>{a}</p><h2>Summary</h2><p>{b}</p></div><div><p>Legal line</p></div></body>" for a, b, _ in made[:3]]
    assert ruled(pages) == [f"{a}\nSummary\n{b}" for a, b, _ in made[:3]]
    pages = [f"<body><h1>My site</h1><div><h2>Summary</h2><p>{a}</p><p>{b}</p></div></body>" for a, b, _ in made[:6]]
    assert ruled(pages) == [f"Summary\n{a}\n{b}" for a, b, _ in made[:6]]


def test_class_names_that_change_by_page_take_linear_time():
    import time

    r = random.Random(4)
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(7))

    def made(n):
        return [f"<body><div class='{name()} x-{name()}'><p class={name()}>Sign up now</p></div><div class='{name()}'><h1 class={name()}>{name()}</h1>" + "".join(f"<p class='c{name()}'>{name()} {name()}</p>" for _ in range(r.randrange(3, 30))) + "</div></body>" for _ in range(n)]

    sizes, took = [], []
    for n in (100, 800):
        pages, began, host = made(n), time.time(), _Host()
        for p in pages:
            host.add(page_nodes(p), 1)
        sizes.append(len(_packed([(k, None if k[0] != "#" else x) for k, x in host.wrapper() if isinstance(k, str)], n)))
        took.append(time.time() - began)
    assert sizes[1] < 2 * sizes[0] + 60_000 and took[1] < 30 * max(took[0], 0.05)
    text = ruled(made(50))
    assert all("Sign up" not in x for x in text)


def test_menus_of_long_pages_and_long_units_go(monkeypatch):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"

    def made(n):
        body = "".join(f"<{t}>{word()} {word()} {word()}</{t}>" for t in r.choices(["p", "h3", "pre", "blockquote", "dl", "address"], k=n))
        return f"<body><ul>{''.join(f'<li><a href=/x>to {k}</a></li>' for k in range(8))}</ul><div>{body}</div></body>"

    for n in (50, 900):
        assert all("to 3" not in text for text in ruled([made(n) for _ in range(4)]))
    unit = "".join(f"<{t}>x{k}</{t}>" for k, t in enumerate(["p", "h2", "pre", "h3", "dl", "h4", "address", "h5", "ul", "h6", "p", "h1", "pre", "dl", "blockquote"] * 2))
    assert [k[0] for k in keys(page_nodes(f"<section>{unit}</section>" * 4)) if not isinstance(k, str)] == ["+"]


def test_long_pages_are_aligned_node_by_node(monkeypatch):
    """A menu that has a single link on one page goes from pages of any length."""

    def made(n, links):
        r = random.Random(n + links)
        body = "".join(f"<{t}>w{r.randrange(10**6)} and more</{t}>" for t in r.choices(["p", "h3", "pre", "blockquote", "dl", "address"], k=n))
        return f"<body><ul>{''.join(f'<li><a href=/x>to {n + links + k}</a></li>' for k in range(links))}</ul><div>{body}</div></body>"

    for n in (40, 1500):
        got = ruled([made(n, k) for k in (8, 1, 6, 9)])
        assert all("to " not in text and text.count("and more") == n for text in got)

    one = [html.matched([r.choice("abcd") for _ in range(50)], list("abdc" * 9)) for r in [random.Random(k) for k in range(9)]]
    monkeypatch.setattr(html, "LONG", 7)
    assert one == [html.matched([r.choice("abcd") for _ in range(50)], list("abdc" * 9)) for r in [random.Random(k) for k in range(9)]]
