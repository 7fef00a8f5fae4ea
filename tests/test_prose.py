"""Hygiene rules on cases worked out by hand."""

import pytest

from inkstone.operators import prose

CASES = {
    "yaml_front_matter": ("---\ntitle: x\ndate: y\n---\nBody text.", "Body text.", 6),
    "html_block": ("One <!-- a comment --> two <script src='x'>var a = 1;</script> three.", "One\n two\n three.", 9),
    "fenced_code": ("Before.\n```python\nx = 1\n```\nAfter.", "Before.\n\nAfter.", 5),
    "indented_code": ("Text.\n    a = 1\n    b = 2\n    c = 3\nMore.", "Text.\n\nMore.", 9),
    "inline_code": ("Call `f(x)` now.", "Call\n now.", 1),
    "css_at_rule": ("@import url(x.css);\nText.", "Text.", 2),
    "css_rule_block": (".note { color: red; margin: 0 }\nText.", "Text.", 7),
    "html_tag": ("A <b>bold</b> word and <https://x.y>.", "A\nbold\n word and <https://x.y>.", 2),
    "json_block": ('{\n "a": 1,\n "b": 2\n}\nText.', "Text.", 6),
    "ascii_table": ("| a | b |\n|---|---|\n| 1 | 2 |\nText.", "Text.", 11),
}
KEPT = [
    "Published on {date:%Y-%m-%d} by {name: x}.",  # placeholders are no style sheet
    "Status {server: prod} is fine.",
    "Issue #123 {color: red} stays, as no selector ends in a digit.",
    "    one\n    two\nthree",  # two indented lines
    '{\n "a": 1\n}',  # one key
    "a | b\nc | d\ne | f",  # no table
    "I love you <3 and a < b > c?",
]


@pytest.mark.parametrize("rule", CASES)
def test_rule(rule):
    text, left, words = CASES[rule]
    got, taken = prose.clean(text)
    assert got == left and taken == {rule: words}


@pytest.mark.parametrize("text", KEPT)
def test_prose_is_kept(text):
    assert prose.clean(text) == (text.strip(), {})


def test_order_and_space():
    # a table inside a fence is the fence's; three line ends become two
    got, taken = prose.clean("A  \n\n\n\nB\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n`x` C")
    assert got == "A\n\nB\n\n\n C".replace("\n\n\n", "\n\n") and list(taken) == ["fenced_code", "inline_code"]


def test_aggressive_rules():
    text = "![pic](http://a/b.png)\nSee [the site](https://a.b) and <https://c.d> or https://e.f now[^1] (Smith and Jones, 2019)."
    got, taken = prose.clean(text, aggressive=True)
    assert "the site" in got and "http" not in got and "Smith" not in got and "[^1]" not in got and "pic" not in got
    assert taken["markdown_link_url"] == 1 and set(taken) == {"markdown_image", "markdown_link_url", "autolink_url", "bare_url", "footnote_marker", "inline_citation"}


def test_masking_profiles():
    text = "# Title\n\nBody says 42 U.S.C. § 1983 holds.\n\n> quoted line\n> more\n\nShe said “" + "word " * 12 + "end” then.\n\nI hope this helps!"
    body, taken = prose.clean(text, profile="prose_body_only")
    assert set(taken) == {"markdown_heading", "block_quote", "long_inline_quotation", "statutory_citation"} and "helps" in body
    assert set(prose.clean(text, profile="prose_strict")[1]) == set(taken) | {"llm_wrapper_phrase"}
    assert set(prose.clean(text, profile="exclude_headings")[1]) == {"markdown_heading"}
    assert "# Title" in prose.clean(text, profile="exclude_quotations")[0]


def test_status_and_rollup(spark, tmp_path):
    texts = ["word " * 99 + "`x`", "word " * 199 + "`x`", "word " * 15 + "`x`", "clean words only", "", None]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.status, r.dominant_rule, r.stripped, r.text) for r in prose.QUERIES["prose_hygiene"](spark, str(tmp_path)).collect()}
    assert got[0][:3] == ("warning", "inline_code", 1) and got[1][:3] == ("clean", "inline_code", 1) and got[2][:3] == ("fail", "inline_code", 1)  # 0.01 and 0.05
    assert got[3] == ("clean", None, 0, "clean words only") and got[4] == ("clean", None, 0, "") and got[5] == ("clean", None, 0, None)
    by = prose.QUERIES["strip_rollup"](spark, str(tmp_path)).collect()
    assert [(r.rule, r.stripped, r.files) for r in by] == [("inline_code", 3, 3)]
    assert {(r.status, r.n) for r in prose.QUERIES["hygiene_status"](spark, str(tmp_path)).collect()} >= {("warning", 1), ("fail", 1)}
