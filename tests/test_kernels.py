"""Kernels on the fixtures of FIXTURES.md, and properties of all similarities."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinweave.functions import css, html, js, tree
from twinweave.functions.similarity import ratio
from twinweave.operators.css import plain_value, similarity_of_texts
from twinweave.operators.jslogic import best_matches, documented_scores


def compare(a, b, parse=html.parse_fragment):
    e = tree.compare_trees(parse(a), parse(b))
    kinds = [x[0] for x in e]
    return (sum(x[2] for x in e) / len(e) if e else 0.0, *(kinds.count(k) for k in ("match", "different", "missing", "extra")))


# Fragments and results that the compared behaviour fixes.
@pytest.mark.parametrize("a,b,want", [
    ("<div><span>Hi</span></div>", "<div><span>Hi</span></div>", (1.0, 2, 0, 0, 0)),
    ("<div><span>Hi</span></div>", "<div></div>", (0.5, 1, 0, 1, 0)),
    ("<div></div>", "<div><span>Hi</span></div>", (0.5, 1, 0, 0, 1)),
    ('<div class="a"></div>', '<div class="b"></div>', (0.5, 0, 1, 0, 0)),
    ("<div>foo</div>", "<div>bar</div>", (0.5, 0, 1, 0, 0)),
    ("<div><ul><li><span>1</span></li></ul></div>", "<div><ul><li><span>1</span></li></ul></div>", (1.0, 4, 0, 0, 0)),
    ('<div><img src="a.png" /><br/></div>', '<div><img src="a.png" /><br/></div>', (1.0, 3, 0, 0, 0)),
    ("<div><!-- comment --><span>Hi</span></div>", "<div><span>Hi</span></div>", (2 / 3, 2, 0, 1, 0)),
    ("<div>   <span>Hi</span> </div>", "<div><span>Hi</span></div>", (1.0, 2, 0, 0, 0)),
    ('<div id="a" class="b"></div>', '<div class="b" id="a"></div>', (1.0, 1, 0, 0, 0)),
    ("<div><ul><li><span>1</span></li></ul></div>", "<div><ul><li>1</li></ul></div>", (0.6, 3, 0, 1, 1)),
    ("<div><script>var a=1;</script><style>.a{}</style><span>Hi</span></div>", "<div><span>Hi</span></div>", (0.5, 2, 0, 2, 0)),
    ("", "", (0.0, 0, 0, 0, 0)), ("", "<p>x</p>", (0.0, 0, 0, 0, 1)), ("<p>x</p>", "", (0.0, 0, 0, 1, 0)),
])
def test_html(a, b, want):
    assert compare(a, b) == pytest.approx(want)


def test_html_recovery():
    nodes = html.parse_html("<html><head><title>t</title></head><body><p class=' a  b '>x<br>y</p></div><p style='a:b:c; d : e'>z")
    assert nodes[0][2] == "body" and [n[2] for n in nodes if n[1] == "element"] == ["body", "p", "br", "p"]
    assert nodes[1][3] == {"class": "a b"} and nodes[-2][3] == {"style": "a: b:c; d: e;"}
    deep = "<div>" * 5000
    assert len(tree.compare_trees(html.parse_html(deep), html.parse_html(deep))) == 5001


def test_comments_can_be_left_out():
    parse = lambda t: html.parse_fragment(t, comments=False)
    assert compare("<div><!-- c --><span>Hi</span></div>", "<div><span>Hi</span></div>", parse)[0] == 1.0


def test_attributes():
    d = tree.attribute_diff({"class": "a b", "id": "x", "data-q": "1"}, {"class": "b a", "id": "y", "href": "z"}, ("data-*",))
    assert d == {"matching": ["class"], "different": ["id"], "missing": [], "extra": ["href"], "similarity": 1 / 3}


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.sampled_from(["x", "y"]), lambda c: st.builds(lambda t, k: f"<{t}>" + "".join(k) + f"</{t}>", st.sampled_from(["div", "p", "b"]), st.lists(c, max_size=4)), max_leaves=20))
def test_html_identity(text):
    s = compare(text, text, html.parse_html)
    assert s[0] == 1.0 and sum(s[2:]) == 0


# Stylesheets and results that the compared behaviour fixes.
@pytest.mark.parametrize("a,b,want", [
    (".foo { color: #fff; }", ".foo { color: #ffffff; }", 1.0), (".foo { color: #fff; } .bar { margin: 0; }", ".foo { color: #fff; }", 0.5),
    (".foo { color: #fff; margin: 0; }", ".foo { color: #fff; padding: 1rem; }", 0.33), ("", ".foo { }", 1.0), (".A{x:1}", ".a{x:1}", 1.0),
    ("@media (x) { .foo { color: red; } }", "@media (x) { .foo { color: red; } }", 1.0), (".foo{color:#fff;}", ".foo { color: #fff; } /* c */", 1.0),
    ("@import url('a;}.css'); .foo { color: #fff; }", ".foo { color: #fff; }", 1.0), (".a{content:'}'} .b{c:d}", ".a{content:'}'} .b{c:d}", 1.0)])
def test_css(a, b, want):
    assert similarity_of_texts(a, b) == want


def test_css_scopes():
    rows = css.parse_css("@media (a) { @supports (b) { .x { p: q !important } } } @keyframes k { 0% { l: 0 } } :root { --v: 1px } .broken { x }")
    assert {(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows} == {
        ("media", "(a)", ".x", "p", "q", True), ("supports", "(b)", ".x", "p", "q", True), ("keyframes", "k", "0%", "l", "0", False),
        ("rule", "", ":root", "--v", "1px", False), ("var", "", ":root", "--v", "1px", False)}
    assert css.resolve_vars("a var(--x, 1px) var(--y) var(--z)", {"--y": "var(--y2)", "--y2": "9", "--z": "var(--z)"}) == "a 1px 9 var(--z)"
    assert plain_value(" #ABC; ") == "#aabbcc" and plain_value("10px") == "10.0" and plain_value("1px 2px") == "1px 2px"


CODE = """
import React, { useState as state } from 'react'; export { a, b as c } from "./m";
function f(a, b) { g(a); if (a > 1) { h.k(b); } return a / 2 / b; }
const z = (x) => { f(x); }; const r = /[/"]+/g.test(s);
class A extends B { m(x) { for (const q of x) { this.n(q); } } static async s(): Promise<void> { while (true) { } } }
export default function App({ p, q }) { const [n, set] = state(0); return <div className="x"><span>{n.map(i => <p key={i}>{i}</p>)}</span></div>; }
"""


def test_js_outline():
    o = js.parse_js(CODE)
    assert o["error"] is None
    assert [(f["name"], f["kind"], f["parameters"]) for f in o["functions"]] == [
        ("f", "function_declaration", 2), ("z", "arrow_function", 1), ("m", "method_definition", 1), ("s", "method_definition", 0),
        ("App", "function_declaration", 1), ("anon_func_0", "arrow_function", 1)]
    assert o["classes"] == [{"name": "A", "methods": ["m", "s"]}]
    assert o["imports"] == [{"source": "react", "specifiers": ["React", "state"]}, {"source": "./m", "specifiers": ["a", "c"]}]
    assert [f["type"] for f in o["flow"]] == ["if_statement", "for_statement", "while_statement"]
    assert {(e["caller"], e["callee"]) for e in o["edges"]} >= {("f", "g"), ("f", "k"), ("z", "f"), ("m", "n"), ("App", "map")}
    assert js.parse_js("function (")["error"] and js.parse_js(None)["error"] is None
    renamed = js.parse_js(CODE.replace("(a, b)", "(u, v)").replace("g(a)", "g(u)"))
    assert [n["type"] for n in renamed["nodes"]] == [n["type"] for n in o["nodes"]]


def test_js_scores():
    o = js.parse_js(CODE)
    same = documented_scores(o, o)
    assert all(v == 1.0 for k, v in same.items() if k != "counts") and same["counts"]["missing"] == 0
    score, counts = best_matches(["f", "g"], ["f", "h"], lambda x, y: 1.0 if x == y else 0.7)
    assert score == pytest.approx(0.85) and counts == {"matching": 1, "different": 1, "missing": 0, "extra": 1}
    assert tree.subtree_similarity([(-1, "a", None), (0, "b", "1")], [(-1, "a", None), (0, "b", None)]) == 0.8


def test_config_literal():
    v = js.object_literal("// c\nmodule.exports = { theme: { extend: { colors: { p: '#fff', 'x-y': fn(1, 2) } } }, a: [1, 2.5, true, null], s }")
    assert v == {"theme": {"extend": {"colors": {"p": "#fff", "x-y": "fn(1,2)"}}}, "a": [1, 2.5, True, None], "s": "s"}
    assert js.object_literal("export default {") is None and js.object_literal("x = 1") is None


def test_ratio():
    assert ratio("Button.jsx", "Buttons.jsx") == pytest.approx(20 / 21) and ratio("", None) == 1.0
