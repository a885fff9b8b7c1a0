"""Wiki storage XML and issue-tracker JSON (ADF) to Markdown: both are read into one small tree, which is written out once."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass
class Node:
    """kind: para, heading, list, item, code, quote, table, row, cell, rule, group (blocks) or text, strong, em, mono, strike, link, break, span (inline)."""

    kind: str
    kids: list[Node] = field(default_factory=list)
    text: str = ""
    level: int = 0
    note: str = ""


#: Levels of nesting that are told apart; what lies deeper is taken as if it lay there.
DEPTH = 100
MARKS = {"strong": "**", "em": "*", "mono": "`", "strike": "~~"}
INLINE = {"text", "link", "break", "span", *MARKS}


def inline(n: Node) -> str:
    if n.kind == "text":
        return n.text
    if n.kind == "break":
        return "\n"
    inner = "".join(map(inline, n.kids))
    if n.kind in MARKS:
        own = inner.strip()
        return inner.replace(own, f"{MARKS[n.kind]}{own}{MARKS[n.kind]}", 1) if own else inner
    if n.kind == "link" and n.note:
        return f"[{inner.strip() or n.note}]({n.note})"
    return inner


def line(nodes: list[Node]) -> str:
    return "\n".join(" ".join(x.split()) for x in "".join(map(inline, nodes)).strip().split("\n")).strip()


def plain(n: Node) -> str:
    return n.text + "".join(map(plain, n.kids))


def indented(text: str, first: str, rest: str) -> str:
    return "\n".join((first if i == 0 else rest if x else "") + x for i, x in enumerate(text.split("\n")))


def block(n: Node) -> str:
    if n.kind == "heading":
        text = line(n.kids).replace("\n", " ")
        return f"{'#' * n.level} {text}" if text else ""
    if n.kind == "code":
        return f"```{n.note}\n{plain(n).strip(chr(10))}\n```"
    if n.kind == "quote":
        inner = blocks(n.kids)
        return "\n".join(f"> {x}".rstrip() for x in inner.split("\n")) if inner else ""
    if n.kind == "rule":
        return "---"
    if n.kind == "list":
        items = [x for x in n.kids if x.kind == "item"]
        return "\n".join(indented(blocks(x.kids, "\n"), (f"{i}. " if n.note == "ordered" else "- ") + x.note, "   " if n.note == "ordered" else "  ") for i, x in enumerate(items, 1))
    if n.kind == "table":
        rows = [[line_of_cell(c) for c in r.kids if c.kind == "cell"] for r in rows_of(n)]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        wide = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
        return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])
    return blocks(n.kids)


def rows_of(n: Node) -> list[Node]:
    return [r for k in n.kids for r in ([k] if k.kind == "row" else rows_of(k) if k.kind == "group" else [])]


def line_of_cell(c: Node) -> str:
    return " ".join(blocks(c.kids).split()).replace("|", "\\|")


def blocks(nodes: list[Node], between: str = "\n\n") -> str:
    """Blocks apart; inline nodes between them make paragraphs."""
    out, open_ = [], []
    for n in nodes:
        if n.kind in INLINE:
            open_.append(n)
            continue
        out += [x for x in (line(open_), block(n)) if x.strip()]
        open_ = []
    return between.join([*out, *filter(None, [line(open_)])])


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# What wiki elements and macros stand for.
ELEMENTS = {"p": "para", "div": "group", "section": "group", "ul": "list", "ol": "list", "li": "item", "pre": "code", "blockquote": "quote", "table": "table", "tr": "row", "td": "cell", "th": "cell", "tbody": "group", "thead": "group", "hr": "rule", "strong": "strong", "b": "strong", "em": "em", "i": "em", "code": "mono", "del": "strike", "s": "strike", "a": "link", "br": "break", "ac:task-list": "list", "ac:task": "item", "ac:layout": "group", "ac:layout-section": "group", "ac:layout-cell": "group", "ac:rich-text-body": "group"}
VOID = {"br", "hr", "img", "col", "ri:page", "ri:user", "ri:url", "ri:attachment", "ri:space"}
QUOTES = {"info", "note", "tip", "warning", "panel", "expand", "details"}
DROPPED = {"toc", "children", "pagetree", "recently-updated", "contentbylabel", "attachments", "livesearch"}


class Storage(HTMLParser):
    """Wiki storage XML as a tree of Nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("group")
        self.stack: list[tuple[str, Node]] = [("", self.root)]

    def handle_starttag(self, tag, attrs):
        a, top = {k: v or "" for k, v in attrs}, self.stack[-1][1]
        n = Node(ELEMENTS.get(tag, "span"))
        if re.match("h[1-6]$", tag):
            n = Node("heading", level=int(tag[1]))
        elif tag == "ol":
            n.note = "ordered"
        elif tag == "a":
            n.note = a.get("href", "")
        elif tag in ("ac:structured-macro", "ac:macro"):
            name = a.get("ac:name", "")
            n = Node("code" if name in ("code", "noformat") else "quote" if name in QUOTES else "dropped" if name in DROPPED else "span" if name in ("status", "jira", "anchor") else "group", text="", note="")
        elif tag == "ac:parameter":
            n = Node("parameter", text=a.get("ac:name", ""))
        elif tag in ("ac:task-status", "ac:task-id", "ac:task-uuid"):
            n = Node("parameter", text=tag)
        elif tag == "ri:page":
            n = Node("text", text=a.get("ri:content-title", ""))
        if n.kind == "dropped":
            self.stack.append((tag, n))  # its content hangs on nothing
            return
        top.kids.append(n)
        if tag not in VOID:
            self.stack.append((tag, n if len(self.stack) < DEPTH else top))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID or all(t != tag for t, _ in self.stack):
            return
        while len(self.stack) > 1:
            t, n = self.stack.pop()
            self.closed(t, n)
            if t == tag:
                break

    def closed(self, tag: str, n: Node) -> None:
        """Parameters become part of what they belong to: a code's language, a status's title, a task's box."""
        held = {k.text: plain(Node("span", k.kids)).strip() for k in n.kids if k.kind == "parameter"}
        n.kids = [k for k in n.kids if k.kind != "parameter"] if tag != "ac:parameter" else n.kids
        if n.kind == "code":
            n.note = held.get("language", "")
        elif tag == "ac:task":
            n.note = "[x] " if held.get("ac:task-status") == "complete" else "[ ] "
        elif tag in ("ac:structured-macro", "ac:macro") and held.get("title", held.get("key")) and n.kind in ("span", "quote"):
            text = Node("text", text=held.get("title", held.get("key", "")))
            n.kids.insert(0, Node("para", [Node("strong", [text])]) if n.kind == "quote" else text)
        elif tag == "ac:link" and any(k.kind != "text" for k in n.kids):
            n.kids = [k for k in n.kids if k.kind != "text"]  # the link's own words instead of the page's title

    def handle_data(self, data):
        self.stack[-1][1].kids.append(Node("text", text=data))

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def from_storage(xml: str) -> str:
    p = Storage()
    p.feed(xml)
    p.close()
    while len(p.stack) > 1:
        p.closed(*p.stack.pop())
    return tidy(blocks(p.root.kids))


# What ADF node and mark types stand for.
ADF = {"paragraph": "para", "bulletList": "list", "orderedList": "list", "taskList": "list", "listItem": "item", "taskItem": "item", "blockquote": "quote", "panel": "quote", "expand": "quote", "codeBlock": "code", "rule": "rule", "table": "table", "tableRow": "row", "tableCell": "cell", "tableHeader": "cell", "hardBreak": "break"}
ADF_MARKS = {"strong": "strong", "em": "em", "code": "mono", "strike": "strike"}


def adf_node(v: dict, depth: int = 0) -> Node:
    kind, a = v.get("type", ""), v.get("attrs") or {}
    kids = [adf_node(k, depth + 1) for k in v.get("content") or []] if depth < DEPTH else []
    if kind == "text":
        n = Node("text", text=v.get("text", ""))
        for m in v.get("marks") or []:
            if m.get("type") in ADF_MARKS:
                n = Node(ADF_MARKS[m["type"]], [n])
            elif m.get("type") == "link":
                n = Node("link", [n], note=(m.get("attrs") or {}).get("href", ""))
        return n
    if kind == "heading":
        return Node("heading", kids, level=min(6, max(1, int(a.get("level", 1)))))
    if kind in ("mention", "status", "emoji"):
        return Node("text", text=str(a.get("text") or a.get("shortName") or ""))
    if kind in ("inlineCard", "blockCard"):
        return Node("link", note=a.get("url", "")) if kind == "inlineCard" else Node("para", [Node("link", note=a.get("url", ""))])
    note = {"orderedList": "ordered", "codeBlock": a.get("language") or "", "taskItem": "[x] " if a.get("state") == "DONE" else "[ ] "}.get(kind, "")
    return Node(ADF.get(kind, "group"), kids, note=note)


def from_adf(value: str) -> str:
    """Markdown of an ADF document; what is no JSON object stays as it is, a JSON string gives its text."""
    try:
        v = json.loads(value)
    except (ValueError, RecursionError):
        return tidy(value)
    return tidy(v) if isinstance(v, str) else tidy(blocks([adf_node(v)])) if isinstance(v, dict) else ""


@F.pandas_udf(StringType())
def storage_markdown(xml: pd.Series) -> pd.Series:
    """Markdown of wiki storage XML; null for null."""
    return xml.map(lambda x: None if x is None else from_storage(x))


@F.pandas_udf(StringType())
def adf_markdown(value: pd.Series) -> pd.Series:
    """Markdown of ADF JSON; null for null."""
    return value.map(lambda x: None if x is None else from_adf(x))
