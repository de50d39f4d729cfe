"""The page parser's short ways (remembered start tags, plain end tags) against the standard parser's own."""

import random
from html.parser import HTMLParser

from tidemill.llm import wrapper

PIECES = ["<a", "<p>", "</p>", '<P CLASS="x">', "</P >", "</p", "<div class='a>b'>", '<div class="a>b">', " | ", "|", "\n»\t", "<br/>", "<script>", "</script>", "</style>", "<style>",
          '<html lang="EN">', "<html>", "<!--", "-->", "<!x>", "<?", "<", ">", '"', "'", "=", "&amp;", "&am", "x y", " ", "<li>", "<ul>", "</ul>", '<td a="&quot;" class="k&amp;l">', "<title>", "</title>", "</>", "\x00", '<p class="q"class="z">', '<p\n class="q"\n>']


class _Plain(wrapper._Tree):
    updatepos, parse_starttag, parse_endtag = HTMLParser.updatepos, HTMLParser.parse_starttag, HTMLParser.parse_endtag


def test_trees_are_those_of_the_standard_parser():
    rng = random.Random(7)
    for _ in range(5000):
        html = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        plain = _Plain()
        plain.feed(html)
        plain.close()
        own = wrapper._read(html)
        assert (own.label, own.parent, own.text, own.lang) == (plain.label, plain.parent, plain.text, plain.lang), html
