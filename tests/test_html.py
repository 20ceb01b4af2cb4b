"""The parser on awkward markup."""

from crawlsight.functions.html import excerpt, parse_page
from crawlsight.functions.robots import LongestRules, rules_for
from crawlsight.schemas import EXCERPT_CHARS, TRUNCATED

URL = "https://s.example/dir/page"


def test_unclosed_and_nested():
    page, marks = parse_page(URL, "<title> A &amp; B </title><p>one<p>two<b>three</p><H1>x <i>y</i></H1><a href='../z#f'>l<b>m</b></a>")
    assert page["title"] == "A & B" and page["h1"] == "x y"
    assert page["links"] == ["https://s.example/z"] and page["internal_links"] == 1
    assert marks["anchors"][0]["absolute"] == "https://s.example/z#f" and marks["anchors"][0]["text"] == "lm"


def test_script_with_markup_inside():
    page, marks = parse_page(URL, '<script>var t="</p><a href=x>";</script><style>p{}</style><p>a&amp;b &copy;</p><!-- no -->')
    assert page["content_text"] == "a&b ©" and marks["anchors"] == [] and page["word_count"] == 2


def test_attributes():
    page, marks = parse_page(URL, "<HTML LANG=EN><IMG SRC=a.png ALT=''><img src='' width=1 height=2 loading=lazy><link rel='a  b' href=/x>")
    assert marks["lang"] == "en" and [i["alt"] for i in marks["images"]] == ["", None]
    assert [i["sized"] for i in marks["images"]] == [False, True] and marks["rels"][0]["rel"] == "a b"
    assert page["image_urls"] == ["https://s.example/dir/a.png"]


def test_noscript_is_text_but_not_body():
    _, marks = parse_page(URL, "<noscript>off</noscript><p>on</p>")
    assert marks["text"] == "off on" and marks["body_text"] == "on"


def test_excerpt():
    html = "<p>" + "x" * EXCERPT_CHARS + "</p><h1>late</h1>"
    page, marks = parse_page(URL, html)
    assert excerpt(html).endswith(TRUNCATED) and page["h1"] == "late" and marks["levels"] == []


def test_structured_data():
    page, marks = parse_page(URL, '<script type="application/ld+json">[{"@type":["A","B"]},{"type":"C"},3]</script>')
    assert page["schema"] == "A, B, C" and not marks["jsonld_invalid"]
    assert [n["types"] for n in marks["nodes"]] == [["A", "B"], ["None"]]


def test_content_types():
    kind = lambda url, html="": parse_page(url, html)[0]["content_type"]
    assert kind("https://s.example/Blog/x") == "Blog / Article" and kind("https://s.example/x", "<article>") == "Blog / Article"
    assert kind("https://s.example/shop/x") == "Product" and kind("https://s.example/about") == "Landing Page"
    assert kind("https://s.example/x", '<meta property="og:type" content="product">') == "Product"
    assert kind("https://s.example/x", '<meta property="og:type">') == "Other"


def test_empty_page():
    page, marks = parse_page(URL, "")
    assert page["word_count"] == 0 and page["link_to_word_ratio"] == 0.0 and marks["n_tags"] == 0


def test_robots_rules():
    text = "User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: *\nDisallow:\nAllow: /"
    assert rules_for(text, "b") == [("/x", False)] and rules_for(text) == [("/", True)]
    rules = LongestRules(text, "b")
    assert rules.blocks("https://s.example/xy") and not rules.blocks("https://s.example/y")
    assert not LongestRules("", "b").blocks("https://s.example/x")
