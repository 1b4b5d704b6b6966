"""Extraction: accuracy on held-out pages, parsing rules, edge cases."""

import random

from vellum.llm import html_text

SCHEMA = "page_id long, url string, html string, text string"


def test_held_out_pages():
    field, rnd = html_text.trained(), random.Random(4711)
    right = exact = total = 0
    for _ in range(80):
        page, y = html_text.labelled(*html_text.made_page(rnd))
        got = field.decode(page)
        right += sum(a == b for a, b in zip(got, y, strict=True))
        exact += got == y
        total += len(y)
    assert right / total > 0.98 and exact >= 74


def test_viterbi_finds_the_best_path():
    import itertools

    field = html_text.trained()
    page, _ = html_text.labelled(*html_text.made_page(random.Random(3)))
    page = page[:8]
    s = field.scores(field.rows(page))
    worth = lambda y: field.start[y[0]] + sum(s[i][k] for i, k in enumerate(y)) + sum(field.pair[a][b] for a, b in zip(y, y[1:]))
    assert abs(worth(field.decode(page)) - max(map(worth, itertools.product((0, 1), repeat=len(page))))) < 1e-9


def test_blocks_follow_the_page():
    html = "<nav>a</nav><script>if (a<b) '</p>'</script><article><h1>T &amp; é</h1><p><b>one<br>two<p>three <i>x\n\t y</i><ul><li>l1<li>l2</ul>tail<!-- <p>no</p> --> 1 < 2</article>&copy; end"
    assert [b.text for b in html_text.blocks(html)] == ["a", "T & é", "one two", "three x y", "l1", "l2", "tail 1 < 2", "© end"]
    assert html_text.blocks(None) == [] and html_text.blocks("<p") == [] or html_text.blocks("<p")[0].text == "<p"
    assert [b.text for b in html_text.blocks("<p>a<!-- open")] == ["a"]


def test_only_hidden_elements_are_silent():
    texts = lambda html: [b.text for b in html_text.blocks(html)]
    for tag in ('style="overflow-x:hidden"', "class=overflow-hidden", 'aria-hidden="false"', 'title="a hidden cost"', 'data-hidden="1"', 'style="display:none;display:block"', 'data-style="display:none"'):
        assert texts(f"<body {tag}><p>text</p></body>") == ["text"], tag
    assert texts('<p>the <a href="/the-hidden-cost" title="hidden">hidden cost</a> of it</p>') == ["the hidden cost of it"]
    for tag in ("hidden", 'hidden=""', "HIDDEN", "aria-hidden=true", "aria-hidden = 'TRUE'", 'style="color:red; Display : none"', "style=display:none", 'style="display:none!important;display:block"'):
        assert texts(f"<div {tag}><p>no</p></div><p>text</p>") == ["text"], tag


def test_a_head_ends_without_its_end_tag():
    texts = lambda html: [b.text for b in html_text.blocks(html)]
    head = "<html><head><title>t</title><meta name=a><noscript><img src=x></noscript><style>p{}</style>"
    for rest in ("<body><p>text</p></body>", "<p>text</p>", "<div>text</div>", "\n text", "<noscript>no<body>text", "</head><body>text</body>"):
        assert texts(head + rest) == ["text"], rest


def test_svg_and_math_inside_text():
    texts = lambda html: [b.text for b in html_text.blocks(html)]
    assert texts('<p><svg/>text</p>') == texts('<p><svg class="i" />text</p>') == texts("<p><svg><title/><path d='M0'/><g></g></svg>text</p>") == ["text"]
    assert texts("<p>a <svg width=1/>no</svg>b</p>") == ["a b"] and texts("<div><svg><path d=x><p>text</p></div>") == ["text"]
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x = 1</annotation></math> then</p>") == ["if x=1 then"]


def test_extract(spark):
    body = "".join(f"<p>Sentence number {i}, with a comma and an end.</p>" for i in range(2000))
    rows = [(1, "u", f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title</h1>{body}</article><div class='comments'><p>I agree, nice.</p></div><footer>&copy; me</footer>", "x"), (2, None, None, ""), (3, "v", "", ""), (3, "v", "", "")]
    got = sorted(html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.page_id)
    assert got[0].text == "Title\n" + "\n".join(f"Sentence number {i}, with a comma and an end." for i in range(2000))
    assert [(r.text, r.n_chars) for r in got[1:]] == [("", 0)] * 3 and got[0].n_chars == len(got[0].text)
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_and_broken_markup_ends(spark):
    for html in ("<div>" * 5000 + "x" + "</div>" * 100, "<" * 5000, "<p a='" * 2000, "</p>" * 5000, "&#x110000; &bogus; &lt;"):
        html_text.main_text(html, html_text.trained())


def test_names_of_attributes_count_only_whole():
    body = "<h1>Title of it</h1>" + "".join(f"<p>Sentence number {i}, with a comma and an end.</p>" for i in range(9))
    for tag in ('style="overflow:hidden"', 'class="hidden-print"', 'data-state="not hidden"', "title='display:none'"):
        got = html_text.main_text(f"<html><body><nav><a href=x>Home</a></nav><article {tag}>{body}</article></body></html>", html_text.trained())
        assert got == "Title of it\n" + "\n".join(f"Sentence number {i}, with a comma and an end." for i in range(9)), tag


def test_time_and_memory_grow_with_the_page():
    import time
    import tracemalloc

    field, size = html_text.trained(), 1_000_000
    hard = ["<div>", "<b>", "<div><b>x", "<p a='", '<p a="', "</p>", "<a></b>", "<li><i>", "<!-", "<!", "<", "<x", "<p>a", "<svg><g>", "<table><tr><td>", "<template><body>", "</a", "<a b=c ='/>", "=", "<script>", "<div hidden><p>", "&amp", "<svg ====/>"]
    for piece in hard:
        began = time.time()
        html_text.main_text(piece * (size // len(piece)), field)
        assert time.time() - began < 20, piece
    tracemalloc.start()
    html_text.blocks("<div>" * (size // 5) + "x")
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_unclosed_quotes_lose_no_text():
    texts = lambda html: [b.text for b in html_text.blocks(html)]
    assert texts('<p>one</p><p class="x>two</p><p>three</p>') == ["one", "two", "three"]
    assert texts("<p title='a>b'>one</p>") == ["one"] and texts("a <b") == ["a <b"]
