"""Wiki storage XML and ADF to Markdown."""

import json

from millrace.sources.markup import adf_markdown, from_adf, from_storage, storage_markdown


def test_storage():
    xml = (
        '<h2>Run &amp; fix</h2><p>See <strong>this</strong>, <em>that</em> and <code>x</code>.</p><ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><ol><li>a</li><li>b</li></ol>'
        '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[if a < b:\n    go()]]></ac:plain-text-body></ac:structured-macro>'
        '<ac:structured-macro ac:name="warning"><ac:parameter ac:name="title">Mind</ac:parameter><ac:rich-text-body><p>the gap</p></ac:rich-text-body></ac:structured-macro>'
        '<ac:structured-macro ac:name="toc"><ac:parameter ac:name="maxLevel">3</ac:parameter></ac:structured-macro>'
        '<table><tbody><tr><th>k</th><th>v|w</th></tr><tr><td><p>1</p></td><td>2</td></tr></tbody></table><hr/>'
        '<ac:task-list><ac:task><ac:task-status>complete</ac:task-status><ac:task-body>done</ac:task-body></ac:task><ac:task><ac:task-status>incomplete</ac:task-status><ac:task-body>open</ac:task-body></ac:task></ac:task-list>'
        '<p>to <ac:link><ri:page ri:content-title="Other page" /></ac:link> or <ac:link><ri:page ri:content-title="X" /><ac:plain-text-link-body><![CDATA[here]]></ac:plain-text-link-body></ac:link> or <a href="https://e.org">e</a><br/>end <ac:structured-macro ac:name="status"><ac:parameter ac:name="title">OK</ac:parameter></ac:structured-macro></p>'
    )
    assert from_storage(xml).split("\n\n") == [
        "## Run & fix", "See **this**, *that* and `x`.", "- one\n  - in\n- two", "1. a\n2. b", "```py\nif a < b:\n    go()\n```", "> **Mind**\n>\n> the gap".replace("\n\n", "\n"),
        "| k | v\\|w |\n| --- | --- |\n| 1 | 2 |", "---", "- [x] done\n- [ ] open", "to Other page or here or [e](https://e.org)\nend OK",
    ]
    assert from_storage("") == "" and from_storage("plain <b>bold") == "plain **bold**"
    assert from_storage("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>x</p>").startswith("deep")


def test_adf():
    text = lambda t, *marks: {"type": "text", "text": t, "marks": [{"type": m} if isinstance(m, str) else m for m in marks]}
    p = lambda *k: {"type": "paragraph", "content": list(k)}
    doc = {"type": "doc", "content": [
        {"type": "heading", "attrs": {"level": 3}, "content": [text("Title")]}, p(text("a "), text("b", "strong"), text(" "), text("site", {"type": "link", "attrs": {"href": "https://x.org"}}), {"type": "hardBreak"}, {"type": "mention", "attrs": {"text": "@jo"}}),
        {"type": "bulletList", "content": [{"type": "listItem", "content": [p(text("one")), {"type": "orderedList", "content": [{"type": "listItem", "content": [p(text("deep"))]}]}]}]},
        {"type": "codeBlock", "attrs": {"language": "go"}, "content": [text("x := 1")]}, {"type": "panel", "content": [p(text("note"))]}, {"type": "rule"},
        {"type": "table", "content": [{"type": "tableRow", "content": [{"type": "tableHeader", "content": [p(text("h"))]}]}, {"type": "tableRow", "content": [{"type": "tableCell", "content": [p(text("c"))]}]}]},
        {"type": "taskList", "content": [{"type": "taskItem", "attrs": {"state": "DONE"}, "content": [text("t")]}]},
    ]}
    assert from_adf(json.dumps(doc)).split("\n\n") == ["### Title", "a **b** [site](https://x.org)\n@jo", "- one\n  1. deep", "```go\nx := 1\n```", "> note", "---", "| h |\n| --- |\n| c |", "- [x] t"]
    assert from_adf("no json") == "no json" and from_adf('"a string"') == "a string" and from_adf("[1]") == ""


def test_as_columns(spark):
    df = spark.createDataFrame([("<p>a</p>", '{"type": "doc", "content": []}'), (None, None)], "xml string, adf string")
    assert [tuple(r) for r in df.select(storage_markdown("xml"), adf_markdown("adf")).collect()] == [("a", ""), (None, None)]
