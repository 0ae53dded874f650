"""Text that the layout of tables and the list of hidden elements must not lose."""

import pytest

from tapeline.llm import html_text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"), ("<table><tr><a>x</a><td>c</table>", "x\nc"), ("<table><tr>text<td>c</tr></table>", "text\nc"),
        ("<table><tr><div>d</div></tr></table>", "d"), ("<table><tr><form>f<td>c</td><i hidden>no</i></form></tr></table>", "f\nc"), ("<table><input type=submit value=Go><tr><td>c</table>", "Go\nc"),
        ("<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math>", "x+1"), ("a<svg><title>no</title><defs><text>no</text></defs><path d='z'/><clipPath/><text>one</text><g><text>two</text></g></svg>b", "a one two b"),
        ("<textarea>\nx &amp; y\nz</textarea>", "x & y\nz"), ("<select><option>p<option>q<optgroup label=g><option>r</select>", "p\nq\ng\nr"), ("<map><a>m</a><area></map>", "m"), ("<object><p>o</p></object>", "o"),
        ("<noscript>no</noscript><canvas>no</canvas>y", "y"), ("<div>" * 149 + "<div hidden><p>no</p><div>no</div>no</div>yes", "yes"), ("<div>" * 200 + "<div hidden><b>no</b>no<div>no</div>no</div>yes", "yes"),
        ("<p style='visibility:hidden'>no<b style='visibility:visible'>yes<i>too</i></b>no</p>", "yestoo"), ("<p style='background:url(display:none)'>a</p><p style='display:none;display:block'>b</p>", "a\n\nb"),
        ("<p style='display:none!important;display:block'>no</p><p style='/*display:none*/ DISPLAY : NONE '>no</p>c", "c"), ("<p style=\"content:';display:none'\">a</p>", "a"), ("<ul style='visibility:collapse'><li>no<li style='visibility:visible'>b</ul>", "- b"),
        ("<input value=v><input type=password value=no><input placeholder=h><input type=checkbox value=no>", "vh"), ("<meter value=2>no</meter>of<progress>no</progress>", "of"), ("a</br>b", "a\nb"), ("<body hidden>no", ""), ("<body style='visibility:hidden'>no<p style='visibility:visible'>b", "b"),
        ("<table><tr><td colspan=1000>a<td>b<tr><td>c<td>d</table>", "a     b\nc  d"), ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"), ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本  x\nabc   y"),
    ],
)
def test_visible(page, text):
    assert html_text.render(page) == text


def test_spans_lists_and_broken_quotes():
    table = "<table><tr><td colspan=2>long header text here<td>x<tr><td>a<td>b<td>c</table>"
    assert html_text.render(table).split("\n") == ["long header text here  x", "a  b" + " " * 19 + "c"]
    assert html_text.render("<ol reversed><li>a<li value=7>b<li>c</ol>").split("\n") == ["3. a", "7. b", "6. c"]
    assert html_text.render("<ol start=4><li>a<li value=x>b</ol>").split("\n") == ["4. a", "5. b"]
    assert html_text.render('<a title="x>text</a> more') == "text more" and html_text.render("<p class='a>b'>in</p>") == "in"
    assert html_text.render("<b " + 'x="' * 20001 + ">end") == "end"


@pytest.mark.parametrize("seed", range(40))
def test_random_trees(seed):
    """The words of random trees that the rules let be seen, in order, and no others."""
    import random

    rng = random.Random(seed)
    words = iter(f"w{i}" for i in range(100_000))
    tags = ["div", "p", "b", "span", "ul", "li", "section", "q", "blockquote", "pre", "h2", "script", "template", "video", "meter", "noscript"]

    def tree(depth, shown, drawn):
        """Markup, and the words of it that are to be seen."""
        if depth == 0 or rng.random() < 0.3:
            word = next(words)
            return f" {word} ", [word] if shown and drawn else []
        tag = rng.choice(tags)
        style, kept, seen = [], shown and tag not in ("script", "template", "video", "meter", "noscript"), drawn
        if rng.random() < 0.3:
            value = rng.choice(["none", "block", "inline"])
            style.append(f"display:{value}")
            kept = kept and value != "none"
        if rng.random() < 0.3:
            value = rng.choice(["hidden", "visible", "collapse", "inherit"])
            style.append(f"visibility: {value.upper()}")
            seen = {"visible": True, "inherit": drawn}.get(value, False)
        more = ""
        if rng.random() < 0.1:
            more, kept = rng.choice([" hidden", " aria-hidden=true", " hidden=''"]), False
        if tag == "script":
            return f"<script{more}> {next(words)} </script>", []
        parts = [tree(depth - 1, kept, seen) for _ in range(rng.randint(1, 4))]
        rng.shuffle(style)
        # inline elements hold no paragraphs, so that no implied end tag moves words
        inside = "".join(f"<div>{m}</div>" if tag == "ul" else m for m, _ in parts)
        tag = "div" if tag in ("p", "li", "h2") and "<" in inside else tag
        return f'<{tag}{more} style="{";".join(style)}">{inside}</{tag}>', [w for _, own in parts for w in own]

    page, want = "", []
    for _ in range(30):
        markup, own = tree(5, True, True)
        page, want = page + markup, want + own
    text = html_text.render(f"<html><head><title>no</title></head><body>{page}</body></html>")
    import re

    assert re.findall(r"w\d+", text) == want
