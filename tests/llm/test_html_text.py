"""Layout and visibility of pages, and time that grows with the page alone."""

import time

import pytest

from repoaudit.llm.html_text import page_text


@pytest.mark.parametrize(
    "html,text",
    [
        # Cells that reach down or across move what stands beside and below them.
        ("<table><tr><td rowspan=2>R<td>a<tr><td>b<tr><td>c<td>d</table>", "R  a\n   b\nc  d"),
        ("<table><tr><td colspan=2>wide<td>z<tr><td>1<td>2<td>3</table>", "wide  z\n1  2  3"),
        ("<table><tr><td rowspan=0>x<td>a<tr><td>b<tr><td>c</table>", "x  a\n   b\n   c"),
        ("<table><tr><td colspan=0>x<td colspan=oops>a<td rowspan=-1>b</table>", "x  a  b"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>B<td>c<tr><td>d<td>e</table>", "a  B  c\nd     e"),
        ("<table><tr><td><td>b<tr><td>long one<td>d</table>", "          b\nlong one  d"),
        # Visibility is inherited and can be taken back; what is not displayed is gone for good.
        ('<div style="visibility:hidden">no <b style="visibility:visible">yes</b> no<img alt=x></div>', "yes"),
        ('<div style="display:none">no <b style="visibility:visible">no</b></div>end', "end"),
        ('<p style="color:red; visibility: Hidden !important">no<p>yes', "yes"),
        ('<ul style="visibility:collapse"><li>no<li style="visibility:visible">yes</ul>', "- yes"),
        ('<table style="visibility:hidden"><tr><td>no<td style="visibility:visible">yes</table>', "  yes"),
        ('<pre style="visibility:hidden">no <i style="visibility:visible">y  es</i></pre>', "y  es"),
        ("<svg><title>no</title><desc>no</desc><text>drawn</text></svg> <math><mi>x</mi></math>", "drawn x"),
        ("<details><summary>more</summary>no</details><details open><summary>s</summary>yes</details>", "more\ns\nyes"),
        ("a <video>no</video><audio>no</audio><canvas>no</canvas>b", "a b"),
        ("<pre>a <b>b</b>\n c</pre>", "a b\n c"),
        ("<p>one<br><br>two", "one\n\ntwo"),
    ],
)
def test_pages(html, text):
    assert page_text(html) == text


@pytest.mark.parametrize(
    "part,times",
    [
        ("<div>", 100_000),
        ("<b>", 100_000),
        ("x<b>y</b>", 100_000),
        ("<table><td>", 10_000),
        ("<p>a<p>", 50_000),
        ("<td colspan=1000 rowspan=3>", 1_000),
    ],
)
def test_time_grows_with_the_page(part, times):
    def seconds(n):
        begin = time.perf_counter()
        page_text("<table><tr>" * part.startswith("<td") + part * n + "</i>" * n)
        return time.perf_counter() - begin

    few, many = seconds(times // 4), seconds(times)
    assert many < 12 * few + 1, (few, many)
