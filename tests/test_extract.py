from pagewright.operators.extract import extract_fields

HTML = """<html><body><div id="main" class="a b"><section id="article-content-1"><p>One &amp; two<p>Three</section>
<div class="x"><span>s1</span><span>s2</span></div></div><div class="gap-x-[46px] w">esc</div>
<script>var t="</p>";</script></body></html>"""


def sel(selector, base="body", multiple=True):
    spec = {"baseSelector": base, "fields": [{"name": "v", "selector": selector, "type": "text", "multiple": multiple}]}
    return extract_fields(HTML, spec)["v"]


def test_selectors():
    assert sel("#main > section[id^='article-content-']") == "One & twoThree"
    assert sel("div.a.b > div.x > span:nth-child(2)") == "s2"
    assert sel("div.x span:nth-child(n)") == "s1\ns2"
    assert sel(r"div.gap-x-\[46px\]") == "esc"
    assert sel("section p", multiple=False) == "One & two"
    assert sel("article") is None


def test_selector_forms():
    import pytest
    from pagewright.operators.extract import check_spec, extract_fields
    page = ("<ul id=l><li class='a b'>1</li><li data-x='pre-fix'>2<b>in</b></li><li lang=en-US>3</li><li>4</li></ul>"
            "<p class='x'>p1</p><p class='x y'>p2</p><h1>h</h1><h2>k</h2>")

    page = f"<body>{page}</body>"

    def texts(s):
        return extract_fields(page, {"baseSelector": "body", "fields": [{"name": "f", "selector": s, "multiple": True}]})["f"]

    assert texts("li:nth-child(2n+1)") == "1\n3" and texts("li:nth-child(even)") == "2in\n4"
    assert texts("li:nth-child(2)") == "2in" and texts("li:first-child, li:last-child") == "1\n4"
    assert texts("p[class='x']") == "p1" and texts("p[class~=y]") == "p2" and texts("p.x.y") == "p2"
    assert texts("li[data-x$=fix]") == "2in" and texts("li[data-x*='e-f']") == "2in" and texts("[lang|=en]") == "3"
    assert texts("h1, h2") == "h\nk" and texts("ul > li b") == "in" and texts("#l > b") is None
    with pytest.raises(ValueError):
        check_spec({"fields": [{"name": "f", "selector": "li:hover"}]})
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert extract_fields(deep, {"baseSelector": "div", "fields": [{"name": "f", "selector": "div", "multiple": False}]})["f"] == "x"
