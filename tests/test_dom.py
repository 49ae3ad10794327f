"""The short way of reading plain markup against the parser's."""

import random

from gridleaf.functions import dom

PARTS = ["<td>", "</td>", "<tr>", "</tr>", "<TABLE>", "</table>", '<td colspan="2">', '<input type="checkbox" checked>', '<input name="[A]"/>', "<br/>", "<br />", "<div/>", "x &amp; y", "&lt", "&", "&#65;", " ", "\n", "", "a&b", "[N]", "<textarea>", "</textarea>", "<textarea>n1</textarea>", "<textarea>a&amp;b</textarea>",
         "<select><option selected>B</option></select>", "<!-- c -->", "<", ">", "<x", "</ td>", "</td >", "<td a=b>", "<td a='b'>", '<td A="1" a="2">', "<script>1<2</script>", "<style>p{}</style>", "<title>t</title>", "<p", "<!DOCTYPE html>", "<?x?>", '<a href="x&amp;y">', '<a b="">', "</br>", "</p>", "&copy", "é", "<td  class=\"col x\"  id=\"i\">", "<b\n>", "<td/>", '<a b="c"d>', "<a-b>", "<h1>"]


def flat(node):
    return [c if isinstance(c, str) else (c.name, c.attrs, c.parent is node, flat(c)) for c in node.children]


def test_plain_markup_reads_as_by_the_parser():
    rand = random.Random(7)
    plain = 0
    for i in range(20_000):
        some = PARTS if i % 2 else PARTS[:26]
        html = "".join(rand.choice(some) for _ in range(rand.randint(0, 9)))
        found = dom._plain(html)
        plain += found is not None
        if found is not None:
            assert flat(found) == flat(dom._parsed(html)), html
        assert flat(dom.parse(html)) == flat(dom._parsed(html))
    assert plain > 4_000


def test_forms_are_plain_markup():
    for html in ('<table><tr><td>L</td><td><input value="A"><input type="Checkbox" checked><select><option value="A">x</option><option selected>B</option></select><textarea>n3</textarea></td></tr></table>', '<div class="a form-container"><div class="row"><div class="col-half">L &amp; M</div></div></div>'):
        assert flat(dom._plain(html)) == flat(dom._parsed(html))
