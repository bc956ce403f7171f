import pytest

from shopfront.functions import html
from tests.brute_html import facts

ODD = [
    "",
    "plain text only",
    "<META NAME='Description' CONTENT=' Caf&eacute; &amp;amp; bar '><meta name=description content=last>",
    '<meta name="viewport"><meta name=\'description\'><html lang="FR-ca"><HTML LANG=ar>',
    "<a href=/contact/>Contact us</a><a href=x />after</a><a href='y'/>z</a>",
    '<a href="/one">one <a href="/two">two</a> tail</a><a name=n>no</a><a href="">empty</a>',
    '<a href="/x?a=1&amp;b=2&copy=3&notit;">a <b>bold</b>\n\t text&nbsp;</a>',
    '<a title="a > b" href="/gt">gt</a><a title=" href=/wrong " href=/right>r</a>',
    '<a href="/dup1" href="/dup2">dup</a><a HREF = "/sp" >sp</a>',
    '<a href="/open">before <a name="inner">inside</a> after',
    "<a href=/s>see <script>var x = '<b>';</script> more</a>",
    "<title>One</title><svg><title>Two &lt;x&gt;</title></svg><title>open ended <p>rest",
    "<title/>x<title>a<title>b</title>",
    "<noscript>hidden <a href='/n'>n</a><form><textarea></textarea></form></noscript>shown",
    "<noscript>a<noscript>b</noscript>c</noscript>d</noscript>e</style>f",
    "a < b and c <3 d &lt; e <> f",
    "<!-- comment <a href=/no>no</a> --><p>x</p><!-- open",
    "<script>if (a < b) { '<!--' }</script>tail<style>p{}</style>",
    "<script type='Application/LD+JSON'>{\"@type\":\"Spa\"}</script><script type=application/ld+json></script>",
    "<script src=x />text<script>unclosed <a href=/no>",
    "<SCRIPT>var a = '</div>';</SCRIPT ><STYLE>a{}</STYLE>visible",
    '<form role="search"><input name=q><input name=r></form>',
    '<form role=search><textarea></textarea></form>',
    "<form><input type=hidden><input type=submit><input></form>",
    "<form><input type=HIDDEN><input type=email><select></select></form>",
    "<form><input><form><input></form><input></form>",
    "<input><textarea></textarea><form/><input><input>",
    "</form><form><input type=''><input type></form>",
    "&#65;&#x42;&#128;&#0;&#xD800;&#x110000;&#99999999999;&#1;&#x1F600; &bogus; &ampx &AMP &NotEqualTilde;&#; & <p>",
    "\x1c  spaced \xa0　<b>\x85x​</b>",
    "<!DOCTYPE html><?php echo 1 ?><p>x</p></p foo></ p>",
    "<p class=a b='c' d=\"e\"f>text</p><x:y-z>u</x:y-z>",
]


@pytest.fixture(scope="module")
def odd_facts(spark):
    table = spark.createDataFrame(list(enumerate(ODD)), "id int, html string")
    rows = html.with_page_facts(table).collect()
    return {r["id"]: r.asDict(recursive=True) for r in rows}


@pytest.mark.parametrize("case", range(len(ODD)))
def test_odd_markup(odd_facts, case):
    expected, got = facts(ODD[case]), odd_facts[case]
    got["anchors"] = [(a["href"], a["text"]) for a in got["anchors"]]
    assert {k: got[k] for k in expected} == expected


def test_real_pages_with_injected_markup(spark, sf_check):
    snippets = [s.replace("'", "\\'").replace("\\x", "x") for s in ODD[:28] if s and "\\" not in s]
    cases = " ".join(
        f"WHEN page_id % {len(snippets)} = {i} THEN '{s}'" for i, s in enumerate(snippets)
    )
    pages = spark.read.parquet(f"{sf_check}/pages.parquet").selectExpr(
        "page_id", f"replace(html, '</article>', CASE {cases} END || '</article>') AS html"
    )
    rows = html.with_page_facts(pages).collect()
    assert len(rows) == 250
    for row in rows:
        got = row.asDict(recursive=True)
        got["anchors"] = [(a["href"], a["text"]) for a in got["anchors"]]
        expected = facts(got["html"])
        assert {k: got[k] for k in expected} == expected, row["page_id"]


def test_long_attributes_and_text_do_not_exhaust_the_stack(spark):
    page = "<p " + " ".join(f"a{i}='{i}'" for i in range(200_000)) + ">" + "x &amp; " * 50_000
    page += "<img src='data:" + "A" * 2_000_000 + "'><a href=/end>end</a>"
    row = html.with_page_facts(
        spark.createDataFrame([(page,)], "html string"), "links", "visible_chars"
    ).first()
    assert row["links"] == ["/end"]
    assert row["visible_chars"] == len("x & " * 50_000) - 1 + 3


def test_long_unquoted_values(spark):
    """A slash that ends an unquoted value does not close the element, however long the value is."""
    value = "v" * 3000
    page = f'<script type=application/ld+json data-x={value}/>{{"a": 1}}</script><p>x</p>'
    closed = f'<script data-x={value} /><p>seen</p>'
    table = spark.createDataFrame([(1, page), (2, closed)], "n int, html string")
    got = {r["n"]: r for r in html.with_page_facts(table, "ldjson_blobs", "visible_chars").collect()}
    assert got[1]["ldjson_blobs"] == ['{"a": 1}'] and got[2]["visible_chars"] == 4
