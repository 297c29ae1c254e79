"""Markdown and Org mode: each rule on small texts, and whatever text comes, HTML that the cleaning leaves well formed."""

import random
import re

import pytest

from forgeframe.functions import html as H
from forgeframe.functions import markup as M

MARKDOWN = [
    ("# One\nTwo\n===\nThree\n---\n###### Six ##", "<h1>One</h1>\n<h1>Two</h1>\n<h2>Three</h2>\n<h6>Six</h6>"),
    ("a\nb\n\nc  \nd\\\ne", "<p>a\nb</p>\n<p>c<br />\nd<br />\ne</p>"),
    ("*a* __b__ ***c*** ~~d~~ snake_case_name 2*3*4", "<p><em>a</em> <strong>b</strong> <strong><em>c</em></strong> <del>d</del> snake_case_name 2*3*4</p>"),
    ("`a*b*` ``x ` y`` \\*no\\*", "<p><code>a*b*</code> <code>x ` y</code> *no*</p>"),
    ("[t](http://x/a_b_c \"T\") [r](doc/x.md) [h](#top) ![i](p.png)", '<p><a href="http://x/a_b_c" title="T">t</a> <a href="/u/r/doc/x.md">r</a> <a href="#top">h</a> <img src="p.png" alt="i" /></p>'),
    ("[a *b* [c]](x(y))", '<p><a href="/u/r/x(y)">a <em>b</em> [c]</a></p>'),
    ("<http://x/y> <me@x.org> http://z/w.", '<p><a href="http://x/y">http://x/y</a> <a href="mailto:me@x.org">me@x.org</a> <a href="http://z/w">http://z/w</a>.</p>'),
    ("https://g/u/r/issues/7 https://g/u/s/issues/8#x https://g/u/r/commit/0123456789abcdef", '<p><a href="https://g/u/r/issues/7">#7</a> <a href="https://g/u/s/issues/8#x">u/s#8</a>  <code><a href="https://g/u/r/commit/0123456789abcdef">0123456789</a></code></p>'),
    ("- a\n- b\n  - c\n  - d\n- e", "<ul><li>a</li><li>b\n<ul><li>c</li><li>d</li></ul></li><li>e</li></ul>"),
    ("1. a\n2. b\n\n7) c", '<ol><li>a</li><li>b</li></ol>\n<ol start="7"><li>c</li></ol>'),
    ("- [ ] a\n- [x] *b*\n- [y] c", '<ul><li><input type="checkbox" disabled="" /> a</li><li><input type="checkbox" disabled="" checked="" /> <em>b</em></li><li>[y] c</li></ul>'),
    ("- a\n\n  more\n- b", "<ul><li><p>a</p>\n<p>more</p></li><li>b</li></ul>"),
    ("- a\n\n- b", "<ul><li><p>a</p></li><li><p>b</p></li></ul>"),
    ("> a\nb\n> > c\n\nd", "<blockquote><p>a\nb</p>\n<blockquote><p>c</p></blockquote></blockquote>\n<p>d</p>"),
    ("```go\na < b\n\n# no\n```\nafter", '<pre><code class="language-go">a &lt; b\n\n# no\n</code></pre>\n<p>after</p>'),
    ("~~~\nopen", "<pre><code>open\n</code></pre>"),
    ("    a\n\n    b\nc", "<pre><code>a\n\nb\n</code></pre>\n<p>c</p>"),
    ("| a | b |\n|:--|--:|\n| 1 | x \\| y |\n| 2 |\n\nend", '<table><thead><tr><th align="left">a</th><th align="right">b</th></tr></thead><tbody><tr><td align="left">1</td><td align="right">x | y</td></tr><tr><td align="left">2</td><td align="right"></td></tr></tbody></table>\n<p>end</p>'),
    ("a\n***\nb\n\n- - -", "<p>a</p>\n<hr />\n<p>b</p>\n<hr />"),
    ("<div>\n*raw*\n</div>\n\n&amp; & < 3", "<div>\n*raw*\n</div>\n<p>&amp; &amp; &lt; 3</p>"),
    ("", ""),
    ("\n \n", ""),
]


@pytest.mark.parametrize(("text", "want"), MARKDOWN)
def test_markdown(text, want):
    assert M.raw_markdown(text, "/u/r", "https://g/") == want


def test_hard_breaks():
    assert M.raw_markdown("a\nb", hard=True) == "<p>a<br />\nb</p>"


ORG = [
    ("#+TITLE: T\n# note\n* One :tag:\n** TODO Two", "<h1>T</h1>\n<h2>One</h2>\n<h3>Two</h3>"),
    ("*b* /i/ _u_ +d+ =c*d*= ~e~ a/b/c", "<p><strong>b</strong> <em>i</em> <u>u</u> <del>d</del> <code>c*d*</code> <code>e</code> a/b/c</p>"),
    ("[[http://x][y <z>]] [[doc.org]] [[p.png]]", '<p><a href="http://x">y &lt;z&gt;</a> <a href="/u/r/doc.org">doc.org</a> <img src="p.png" alt="p.png" /></p>'),
    ("- a\n  - b\n- [X] c\n1. d", '<ul><li>a<ul><li>b</li></ul></li><li><input type="checkbox" disabled="" checked="" /> c</li></ul>\n<ol><li>d</li></ol>'),
    ("#+BEGIN_SRC go\na < b\n#+END_SRC\n#+begin_quote\nq\n#+end_quote", '<pre><code class="language-go">a &lt; b\n</code></pre>\n<blockquote><p>q</p></blockquote>'),
    ("| a | b |\n|---+---|\n| 1 | 2 |", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"),
    ("a\nb\n-----\n", "<p>a\nb\n-----</p>"),
    ("", ""),
]


@pytest.mark.parametrize(("text", "want"), ORG)
def test_org_mode(text, want):
    assert M.raw_org(text, "/u/r", "https://g/") == want


def test_links_and_cleaning_follow():
    out = H.markdown("# Fix #3\n\nby @ann, see `#4` and [#5](x)\n\n<script>alert(1)</script> <b onclick=x>ok</b>\n\n![i](p.png)", "/u/r", "/u/r", "https://g/")
    assert '<h1>Fix <a href="/u/r/issues/3" rel="nofollow">#3</a></h1>' in out and '<a href="/ann" rel="nofollow">@ann</a>' in out
    assert "<code>#4</code>" in out and '<a href="/u/r/x" rel="nofollow">#5</a>' in out and "alert" not in out and "<b>ok</b>" in out and "onclick" not in out
    assert '<h2>x</h2>' in H.org_mode("* x")


@pytest.mark.parametrize("seed", range(6))
def test_any_text_is_read(seed):
    draw = random.Random(seed)
    parts = ["#", "# ", "* ", "- ", "1. ", "> ", "`", "```", "**", "_", "~~", "[", "](", ")", "|", "|-|-|", "<b>", "</b>", "\n", "\n\n", "    ", "a", "b c", "http://x", "\\", "&", "<", "[ ] ", "=====", "---", "\x00", "\x01"]
    for _ in range(400):
        text = "".join(draw.choices(parts, k=draw.randrange(1, 30)))
        for out in (H.markdown(text), H.org_mode(text)):
            assert "\x00" not in out and "\x01" not in out
            opened = []
            for end, tag in re.findall(r"<(/?)(table|thead|tbody|tr|ul|ol|pre|blockquote)\b[^>]*>", out):
                opened.append(tag) if not end else opened and opened.pop()
            assert not opened, (text, out)


CLEANED = [
    ('<p id="a.b" class="x" dir="rtl" lang="en" title="T (1)">x</p>', '<p id="a.b" dir="rtl" lang="en" title="T (1)">x</p>'),
    ('<p id="a b" dir="up" title="<x>">x</p>', "<p>x</p>"),
    ('<details open><summary>s</summary>d</details>', '<details open=""><summary>s</summary>d</details>'),
    ('<table width="50%" height="x"><tr align="left"><td colspan="2" rowspan="y" valign="top">1</td></tr></table>', '<table width="50%"><tr align="left"><td colspan="2" valign="top">1</td></tr></table>'),
    ('<ol start="3" type="i"><li value="4">a</ol>', '<ol start="3" type="i"><li value="4">a</ol>'),
    ('<blockquote cite="javascript:x"><del datetime="2024-01-02T03:04:05Z">a</del></blockquote>', '<blockquote><del datetime="2024-01-02T03:04:05Z">a</del></blockquote>'),
    ('<a href="JaVaScRiPt:alert(1)">x</a><a href=" java\nscript:x">y</a><a href="/rel?x=1&amp;y=2">z</a>', 'xy<a href="/rel?x=1&amp;y=2" rel="nofollow">z</a>'),
    ('<mark>m</mark><ruby>r<rt>t</rt></ruby><time datetime="x">n</time><meter value="0.5" max="a">', '<mark>m</mark><ruby>r<rt>t</rt></ruby><time>n</time><meter value="0.5">'),
    ('<iframe src="x">a</iframe><object>b</object><form><input type="text"><button>c</button></form>', "c"),
    ('<svg onload="x"><b>d</b></svg><!-- c --><style>e</style>f', "<b>d</b>f"),
]


@pytest.mark.parametrize(("text", "want"), CLEANED)
def test_cleaning(text, want):
    assert H.sanitised(text) == want


def test_custom_schemes():
    assert H.sanitised('<a href="magnet:x">m</a>', {"magnet"}) == '<a href="magnet:x" rel="nofollow">m</a>' and "href" not in H.sanitised('<a href="magnet:x">m</a>')
