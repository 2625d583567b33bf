"""Tree construction and serialisation."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.kernel import dom
from weftline.kernel import html as H
from weftline.kernel.dom import Page
from weftline.kernel.links import LinkRules
from weftline.kernel.html import Node, number, number_last, number_post, parse


def shape(n: Node) -> str:
    if n.tag == "#text":
        return repr(n.data)
    return n.tag + ("(" + " ".join(map(shape, n.kids)) + ")" if n.kids else "")


def body(html: str) -> str:
    root = parse(html)
    html_node = next(k for k in root.kids if k.tag == "html")
    return " ".join(map(shape, next(k for k in html_node.kids if k.tag == "body").kids))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # Formatting elements left open come back in later blocks, at most three alike.
        ("<article><h1>T</h1><p><b>A<br><p>B</p><p>C</p></article><footer>X</footer>", "article(h1('T') p(b('A' br)) p(b('B')) p(b('C'))) footer(b('X'))"),
        ("<p><b><b><b><b>x<p>y", "p(b(b(b(b('x'))))) p(b(b(b('y'))))"),
        # Misnested formatting.
        ("<p>1<b>2<i>3</b>4</i>5</p>", "p('1' b('2' i('3')) i('4') '5')"),
        ("<b>1<p>2</b>3</p>", "b('1') p(b('2') '3')"),
        ("<a href=1>x<a href=2>y", "a('x') a('y')"),
        # Tables: implied parts and foster parents.
        ("<table><tr><td>a<td>b<tr>c</table>d", "'c' table(tbody(tr(td('a') td('b')) tr)) 'd'"),
        ("<!doctype html><p>a<table><td>1</table>", "p('a') table(tbody(tr(td('1'))))"),
        ("<table><caption>c</caption><col><tbody><tr><th>h</table>", "table(caption('c') colgroup(col) tbody(tr(th('h'))))"),
        # Lists, options, headings.
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "ul(li('a') li('b' ul(li('c'))) li('d'))"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dl(dt('a') dd('b') dt('c'))"),
        ("<select><option>a<option>b</select>x", "select(option('a') option('b')) 'x'"),
        ("<h1>a<h2>b</h1>c", "h1('a') h2('b') 'c'"),
        # Raw text, entities, odd tags.
        ("<script>if(a<b)'</p>'</script>x", "'x'"),
        ("<div><script>a</p></script>x</div>", "div(script('a</p>') 'x')"),
        ("<div>&amp; &copy &notit; &#x41;</div>", "div('& © ¬it; A')"),
        ("<textarea>\na&lt;<b></textarea>", "textarea('a<<b>')"),
        ("x</br>y<br/>", "'x' br 'y' br"),
        ("<a 'foo'>t</a>", "a('t')"),
        ("<svg><path d=1/><g/></svg>t", "svg(path(g)) 't'"),
        ("a<3 b</3>c", "'a<3 b' #comment 'c'"),
    ],
)
def test_tree(html, want):
    assert body(html) == want


def test_attributes():
    p = dom.Page("<p x='1' x=2 Y=\"&amp;a&ltb &lt=\" z A=q/>q")
    assert p.select("p")[0].attrs == {"x": "1", "y": "&a&ltb &lt=", "z": "", "a": "q/"}


def test_head_and_doctype():
    assert shape(parse("<!DOCTYPE HTML><title>a&lt;b</title><p>x")) == "#document(#doctype html(head(title('a<b')) body(p('x'))))"
    assert shape(parse(None)) == shape(parse("")) == "#document(html(head body))"


def test_serialisation_round_trip():
    html = '<div a="x &amp; &quot;"><br><p>a &lt; b&nbsp;</p><!--c--><script>1 < 2</script></div>'
    p = dom.Page(html)
    assert dom.outer_html(p.select("div")[0]) == html
    assert dom.inner_html(p.select("p")[0]) == "a &lt; b&nbsp;"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<b>", "</b>", "<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<i>", "</i>", "<a>", "</a>", "<li>", "<ul>", "</ul>", "<div>", "</div>", "x", " ", "<select>", "<option>", "</select>", "<svg>", "</svg>", "<form>", "</form>", "<h1>", "</h1>", "<template>", "</template>", "<button>", "<br>", "<caption>", "<col>", "</body>", "<head>", "<style>", "</style>", "<"]), max_size=25))
def test_any_tag_soup_gives_a_sound_tree(parts):
    root = parse("".join(parts))
    order = number(root)
    number_post(order)
    number_last(order)
    assert [n.pre for n in order] == list(range(len(order)))

    def walk(n):
        return [x for k in n.kids for x in walk(k)] + [n]

    after = walk(root)
    assert [n.post for n in after] == list(range(len(order))) and all(n.last == max(x.pre for x in walk(n)) for n in order)
    for n in order:
        for k in n.kids:
            assert k.parent is n
    # No text is lost or doubled outside of raw text and select.
    if not {"<style>", "<select>", "<", "<head>", "<template>", "<col>", "<table>"} & set(parts):
        assert sum(n.data.count("x") for n in order) == parts.count("x")


def test_long_and_deep():
    assert len(dom.Page("<div>" * 3000 + "x").select("div")) == 3000
    assert dom.all_text(parse("<p>" + "a b " * 200000)) == "a b " * 200000


TAGS = "a b i p div span li ul ol table tr td th tbody h1 h2 form select option button svg title textarea script style pre template br img math nobr em strong body html head dd dt dl applet object caption col noscript frameset plaintext label font center mi foreignObject DIV P x-y input hr ruby rt iframe".split()
PIECES = ["text", "&amp;", "&lt", "\0", "\n", " ", "<!-- c -->", "<!-->", "<!doctype html>", "<!DOCTYPE>", "<?x y?>", "</>", "</ x>", "<![CDATA[ab]]>", "a<b", "<", "<x", "&notit;", "\r\n", "</p", "<a b='", "\"", "'>"]
ATTRS = ["", "", " class=x", ' id="a b"', " href=/u&amp;v", " /", " a=1 a=2", " color=red", ' HREF="/q"']


def odd_pages(seed, n, tags=TAGS):
    rng = random.Random(seed)
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 40)):
            r = rng.random()
            parts.append(f"<{rng.choice(tags)}{rng.choice(ATTRS)}{rng.choice(['>', '>', '>', '/>'])}" if r < 0.5 else f"</{rng.choice(tags)}>" if r < 0.8 else rng.choice(PIECES))
        yield "".join(parts)


def dumped(root):
    out, stack = [], [(root, 0)]
    while stack:
        x, depth = stack.pop()
        out.append((depth, x.tag, tuple(x.attrs.items()), x.data, x.foreign))
        assert all(k.parent is x for k in x.kids)
        stack += [(k, depth + 1) for k in reversed(x.kids)]
    return out


def test_cut_text_gives_the_tree_of_one_token_after_another():
    for page in odd_pages(3, 4000):
        b, whole = H.Builder(), page.replace("\r\n", "\n")
        H._go_on(b, whole, 0)
        b._to_body()
        assert dumped(H.parse(page)) == dumped(b.root), page


def test_links_of_a_text_are_those_of_its_tree():
    rules = LinkRules(deny_extensions=frozenset())
    for page in [*odd_pages(4, 3000), *odd_pages(5, 3000, [t for t in TAGS if t not in "table select svg math template frameset plaintext".split()] + ["a"] * 9)]:
        assert rules.extract_text(page, "http://a.test/") == rules.extract(Page(page, "http://a.test/")), page


@pytest.mark.parametrize("page", ["<div>" * 20_000, "<p><b>" + "<div>x" * 20_000, "<li>" + "<div>" * 20_000 + "<li>" * 3, "<span>" * 20_000 + "</span>" * 20_000, "<div><p>x" * 20_000], ids=["divs", "formatting", "items", "spans", "paragraphs"])
def test_time_is_linear_in_depth(page):
    began = time.process_time()
    H.parse(page)
    assert time.process_time() - began < 1.5


def test_a_foreign_template_takes_nothing_with_it():
    root = H.parse("<ul><math><template></template></math><p>x")
    assert any(n.tag == "p" for n in H.number(root))
