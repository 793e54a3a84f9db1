"""The tree builder against the HTML standard, on cases that the pages have or may have."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelift.sources.html import decode_attribute, has_explicit_body, parse, parse_fragment, serialize


def body(markup):
    out = serialize([parse(markup)])
    return out[out.index("<body>") + 6 : out.rindex("</body>")]


@pytest.mark.parametrize(
    "markup, want",
    [
        ("<p>1<p>2", "<p>1</p><p>2</p>"),
        ("<!doctype html><p><b>a<br><p>b</p>c", "<p><b>a<br/></b></p><p><b>b</b></p><b>c</b>"),
        ("<p>1<div>2</p>3", "<p>1</p><div>2<p></p>3</div>"),
        ("<p><b><i>x</b>y</i>", "<p><b><i>x</i></b><i>y</i></p>"),
        ("<a href=x>1<a href=y>2</a>", '<a href="x">1</a><a href="y">2</a>'),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<table>foo<b>bar<tr><td>1</table>", "foo<b>bar</b><table><tbody><tr><td>1</td></tr></tbody></table>"),
        ("<table><tr><td>x<td>y</table>z", "<table><tbody><tr><td>x</td><td>y</td></tr></tbody></table>z"),
        ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<body><script>var t='</p>';</script>x", "<script>var t='</p>';</script>x"),
        ("<body><noscript><img src=a></noscript>", "<noscript><img src=a></noscript>"),
        ("<p>&quot;&copy &amp; it's &#x41;&am", "<p>&#34;© &amp; it&#39;s A&amp;am</p>"),
        ("<body>a < b <3", "a &lt; b &lt;3"),
        ("<svg><path d=x /><foreignObject><p>x</svg>y", '<svg><path d="x"></path><foreignObject><p>xy</p></foreignObject></svg>'),
        ("<svg><g>x</svg>y", "<svg><g>x</g></svg>y"),
        ("<svg><p>x", "<svg></svg><p>x</p>"),
        ("<pre>\n\nx</pre>", "<pre>\n\nx</pre>"),
        ("<textarea>\n<b></textarea>", "<textarea>&lt;b&gt;</textarea>"),
        ("<body><!-- c --><?x?>y", "<!-- c --><!--?x?-->y"),
        ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
        ("<select><option>a<option>b</select>c", "<select><option>a</option><option>b</option></select>c"),
        ("<b><b><b><b>x<p>y", "<b><b><b><b>x<p>y</p></b></b></b></b>"),
        ("<p a=1 A=2 b='x y' c>z", '<p a="1" b="x y" c="">z</p>'),
        ("x</body></html><p>y", "x<p>y</p>"),
        ("<body></p>", "<p></p>"),
        ("</p>", ""),
        ("<title>x", ""),
        ("<form><form>x</form>", "<form>x</form>"),
    ],
)
def test_trees(markup, want):
    assert body(markup) == want


def test_formatting_is_opened_again_three_times_at_most():
    assert body("<p><b><b><b><b>x<p>y").count("<b>") == 7


def test_deep_pages_do_not_recurse():
    doc = parse("<div>" * 3_000 + "x")
    assert sum(1 for _ in doc.walk()) > 3_000
    assert doc.clone() is not doc and len(serialize([doc])) > 30_000


def test_head_and_fragments():
    assert serialize([parse("<title>a &amp; b</title>x")]) == "<html><head><title>a &amp; b</title></head><body>x</body></html>"
    assert serialize(parse_fragment("<img src=x> y")) == '<img src="x"/> y'
    assert has_explicit_body("<html><head></head></html>") == (True, True, False)
    assert has_explicit_body('<html><head><title><body></title></head><header class="<body">') == (True, True, False)


def test_attribute_references():
    assert decode_attribute("a&amp;b&copy=1&copy;&#65;") == "a&b&copy=1©A"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i>", "</i>", "<table>", "<tr>", "<td>", "</table>", "<a>", "</a>", "<div>", "</div>", "<li>", "<ul>", "</ul>", "x", " ", "<br>", "<svg>", "</svg>", "<select>", "<option>", "</select>", "<caption>", "<template>", "</template>", "<h1>", "</h1>", "<button>", "<form>", "</form>", "<!--c-->", "<textarea>", "<frameset>", "<col>", "<nobr>", "<math>", "<mi>", "</math>"]), max_size=25))
def test_any_markup_gives_a_sound_tree(parts):
    doc = parse("".join(parts))
    for n in doc.walk():
        for c in n.children:
            assert c.parent is n
    assert any(n.tag in ("body", "frameset") for n in doc.walk())
