import numpy as np
import pytest

from codefacts.llm import html_main_text as html

SCHEMA = "page_id long, url string, html string, text string, k0 string, n_chars string"


@pytest.fixture(scope="module")
def model():
    return html.train([])


@pytest.fixture(scope="module")
def given_model(spark):
    return html.train_from(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("pages", "documents")))


def test_kinds_of_furniture(model):
    """Other pages of the taught kinds than those it was trained on."""
    pages = html.taught_pages(4, seed=99)
    found = html.main_texts([p for p, _ in pages], model)
    assert sum(f == t for f, (_, t) in zip(found, pages)) >= 0.9 * len(pages)


STORY = "A story that somebody wrote at some length, so that there is enough of it to read."


@pytest.mark.parametrize("page, text", [
    ("<body><p>Only one short paragraph here.</p></body>", "Only one short paragraph here."),
    ("Just text without any markup at all.", "Just text without any markup at all."),
    (f"<table><tr><td>{STORY} {STORY} {STORY}</td></tr></table><footer>Imprint and terms</footer>", f"{STORY} {STORY} {STORY}"),
    (f"<div>{STORY}</div><div>{STORY}</div>", f"{STORY} {STORY}"),
    (f"<body><p>{STORY}</p><p>{STORY}</p><div class='sidebar'>Links and more links</div></body>", f"{STORY} {STORY}"),
    (f"<article><header><h1>Article title</h1></header><p>{STORY}</p></article>", f"Article title {STORY}"),
    ("<article><p>A <b>bold</b>word and <a>a link</a>, done.</p></article>", "A boldword and a link, done."),
    ("<ul><li>one</li><li>two</li></ul>", "one two"), ("<p>x</p>", "x"),
])
def test_articles_of_every_shape(model, given_model, page, text):
    """Neither the taught model nor one that has seen the given pages asks for a wrapper."""
    assert html.main_texts([page, page], model) == [text] * 2
    assert html.main_texts([page], given_model) == [text]


def test_share_of_exact_texts_per_template(model, given_model):
    for template in html.TEMPLATES:
        pages = html.taught_pages(20, seed=41, templates=(template,))
        for m, least in ((model, 12), (given_model, 10)):
            found = html.main_texts([p for p, _ in pages], m)
            assert sum(f == t for f, (_, t) in zip(found, pages)) >= least, template


def test_blocks_and_references():
    tree = html.Tree("<p>a &amp;  b<br>c <b>d</b>e<p>f&nbsp;g<script>x<p>y</script><style>p{}</style><!-- no --><div>h</div>i")
    assert html.blocks(tree.root) == ["a & b c de", "f g", "h", "i"]
    assert html.blocks(html.Tree("").root) == [] and html.blocks(html.Tree("plain &lt;text&gt;").root) == ["plain <text>"]
    assert html.blocks(html.Tree("<div>cut off <a href='").root) == ["cut off"]


def test_missing_ends_of_silent_elements(model):
    assert html.blocks(html.Tree("<head><title>x</title><body><p>a</p>").root) == ["a"]
    assert html.blocks(html.Tree("<html><head><meta charset=x><title>x</title><script>y</script><p>a<p>b").root) == ["a", "b"]
    assert html.blocks(html.Tree("<head><title>x</title> bare <head>text</head>").root) == ["bare text"]
    form = "<form><select><option>A<option>B</select></form>"
    assert html.blocks(html.Tree(f"{form}<p>a</p>{form}b").root) == ["a", "b"]
    assert html.blocks(html.Tree("<form><select><option>A<optgroup><option>B</form>a").root) == ["a"]
    assert html.blocks(html.Tree("<form><select><option>A<select><option>B</select>a<input>b</form>").root) == ["ab"]
    assert html.blocks(html.Tree("<datalist><option>A<option>B</datalist>a<div><button>C</div>b<svg><g>D<p>c").root) == ["a", "b", "c"]
    assert html.blocks(html.Tree("<div>a<noscript>x</div><p>y</noscript>b</div></option></script>c").root) == ["ab", "c"]
    page, text = html.taught_pages()[2]
    for head in ("<html><head><title>x</title><body>", form):
        assert html.main_texts([head + page], model) == [text]


def test_deep_and_wide_pages(model):
    deep = "<div>" * 5000 + "The bottom of a very deep page is still text." + "</div>" * 5000
    assert html.blocks(html.Tree(deep).root) == ["The bottom of a very deep page is still text."]
    body = [f"Paragraph number {i} of a very long article that somebody wrote." for i in range(3000)]
    wide = "<nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"
    assert html.main_texts([wide], model) == [" ".join(body)]


def test_nothing_is_lost_behind_open_elements(model):
    deep = html.Tree("<div>" * 600 + "<p>a</p><p>b</p><footer>c</footer>")
    assert html.blocks(deep.root) == ["a", "b", "c"] and [n.tag for n in deep.order[-3:]] == ["p", "p", "footer"]
    text = "This is one of the many cells that somebody wrote into the table of an article."
    for cells, end in (("<tr><td>{}<td>{}", "</table>"), ("<dt>{}<dd>{}", "</dl>"), ("<tbody><tr><th>{}<tr><td>{}", "</table>")):
        page = f"<article>{'<dl>' if 'dl' in end else '<table>'}{cells.format('x', 'y') * 600}{end}</article><footer><p>z</p></footer>"
        tree = html.Tree(page)
        assert html.blocks(tree.root) == ["x", "y"] * 600 + ["z"]
        assert [n.tag for n in tree.root.children] == ["article", "footer"] and max(n.depth for n in tree.order) <= 5
    page = "<div>" * 600 + f"<article><p>{text}</p><p>{text}</p></article><footer><p>{text}</p></footer><div class='comments'><p>{text}</p></div>"
    assert html.main_texts([page], model) == [f"{text} {text}"]
    nested = "<table><tr><td>a<table><tr><td>b<td>c</table>d<td>e</table>f<ruby>g<rt>h<rt>i</ruby>"
    assert html.blocks(html.Tree(nested).root) == ["a", "b", "c", "d", "e", "fghi"]


def test_labels_of_deep_pages():
    """As by the texts of each node by itself, in a time that does not grow with the square of the depth."""
    text = "Words of the article that are known, and more of them than chance explains."
    for page in ["<div>" * 9 + f"<p>{text}</p><div>{text}<b>more</b>" + "</div>" * 9 + "<p>no</p>", f"<div><span>{text}</span></div><p></p>", "<div><p>a<p>b</div>"]:
        for known in (f"{text} {text}more", "a b", ""):
            tree, y = html.Tree(page), {}
            for node in tree.order:
                own = html.blocks(node)
                found = bool(own) and all(t in known for t in own) and (max(map(len, own)) >= html.TELLING or bool(known) and known in " ".join(own))
                y[id(node)] = found or y.get(id(node.parent), False)
            assert html.labelled_nodes(page, known)[1].tolist() == [y[id(n)] for n in tree.order]
    assert html.labelled_nodes(f"<p>{text}</p>" + "<div>qq" * 20000 + "</x>" * 20000, text)[1].sum() == 1


def test_bare_text_around_furniture(model):
    a, b, c = ("The first part of an article whose author does without paragraphs.", "The second part goes on where the first one ended, after a break.",
               "The last part follows an advert that stands in the middle of the text.")
    page = f"<nav><a href='/'>Home</a></nav><article>{a}<br>{b}<div class='ad'>Buy one of these now, while they last.</div>{c}</article><footer>Imprint</footer>"
    assert html.main_texts([page], model) == [f"{a} {b} {c}"]
    tree = html.Tree("<div>ab<i>x</i>c<p>d<b>e</b>f</p><br>g<p>h</p></div>")

    def decoded(**odds):
        return html.decoded(tree, np.array([odds.get(n.tag, 0.0) for n in tree.order]))

    assert decoded(div=1.0, i=-9.0, p=-9.0, b=1.0) == ["ab c", "g"]  # no element stays without its line
    assert decoded(div=1.0, i=-9.0, p=-1.0, b=9.0) == ["ab c", "def", "g"]
    assert decoded(div=1.0, i=-0.5, p=-9.0, b=-1.0) == ["abxc", "g"]
    assert decoded(div=-1.0, i=-1.0, p=1.0, b=-0.5) == ["def", "h"]
    assert html.decoded(tree, np.full(len(tree.order), 1.0)) == html.blocks(tree.root)


def test_decoding_has_no_contradictions(model):
    trees = [html.Tree(p) for p, _ in html.taught_pages()]
    for tree in trees:
        chosen = html.decode(tree, model.log_odds(html.node_features(tree)))
        for node in chosen:
            above = node.parent
            while above is not None:
                assert all(above is not c for c in chosen)
                above = above.parent


def test_extract(spark, model):
    page, text = html.taught_pages()[0]
    rows = [(1, "u", page, "x", "y", "z"), (1, "u", page, None, "y", "z"), (None, None, None, None, None, None), (2, "v", "", None, None, None)]
    out = html.extract(spark.createDataFrame(rows, SCHEMA), model)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(
        [(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr
    )
    assert html.extract(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_held_out_accuracy(spark):
    """Trained on some pages of the given table, right on the others: the article without what surrounds it."""
    import re

    folder = "/root/testdata/sf0.01"
    pages, docs = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("pages", "documents"))
    model = html.train_from(pages, docs, sample=60)
    known = {r.doc_id: html.plain(r.text) for r in docs.select("doc_id", "text").collect() if r.text}
    right = total = 0
    for r in html.extract(pages, model, keep=("page_id", "url", "html")).collect():
        number = re.match(r"^[a-z]+://[^/]+/[^/]+/([0-9]+)", r.url)
        if number and int(number[1]) in known:
            total += 1
            right += r.text.endswith(known[int(number[1])]) and "middot" not in r.html.split("</article>")[0]
    assert total > 200 and right / total > 0.95
