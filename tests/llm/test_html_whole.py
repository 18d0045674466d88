"""Text beside the best container."""

import pytest

from lumenframe.llm import html_extract

LONG = "".join(f"<p>{'Long text, of many words, and more, and yet more. ' * 6}</p>" for _ in range(10))
REST = "<div><p>A closing paragraph.</p></div><ul><li>point</li></ul><table><tr><td>cell</td></tr></table>Bare <b>text</b>.<p>See <a href=x>this</a> for more of it.</p>"
WANT = ["A closing paragraph.", "point", "cell", "Bare text.", "See this for more of it."]


@pytest.mark.parametrize("page", ["<article><div>{0}</div>{1}</article>", "<main><section><div>{0}</div></section>{1}</main>", "<div><div>{0}</div>{1}</div>", "<div><div><div>{0}</div></div>{1}</div>"])
def test_html_keeps_what_stands_beside_the_best(page):
    links = "<div><ul>" + "<li><a href=x>some words</a></li>" * 9 + "</ul></div>"
    lines = html_extract.extract(f"<body>{links}{page.format(LONG, REST)}</body>").split("\n")
    assert len(lines) == 10 + len(WANT) and lines[10:] == WANT
