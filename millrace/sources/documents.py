"""Uploaded documents: HTML to Markdown, Markdown sections as chunks, dependency manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DROPPED = {"script", "style", "nav", "footer", "noscript", "svg"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "tr", "pre", "hr", "ul", "ol"}
MAX_TOKENS, OVERLAP = 900, 50


class Markdown(HTMLParser):
    """The common structure of a page: headings, paragraphs, lists, quotes, tables, code, links, emphasis."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.text: list[str] = []
        self.cells: list[str] = []
        self.lists: list[str] = []
        self.skip = self.pre = 0
        self.title, self.in_title, self.in_head = "", False, False
        self.block, self.link = "", ""

    def flush(self) -> None:
        text = "".join(self.text)
        self.text = []
        if self.pre:
            return
        text = " ".join(text.split())
        if not text:
            return
        if self.block[:1] == "h" and self.block[1:].isdigit():
            self.out.append(f"\n{'#' * int(self.block[1:])} {text}\n\n")
        elif self.block == "li":
            depth = max(len(self.lists) - 1, 0)
            self.out.append(f"{'  ' * depth}{'1.' if self.lists and self.lists[-1] == 'ol' else '-'} {text}\n")
        elif self.block == "blockquote":
            self.out.append(f"> {text}\n\n")
        elif self.block == "tr":
            self.cells.append(text.replace("|", "\\|"))
        else:
            self.out.append(f"{text}\n\n")

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skip += 1
        elif tag == "head":
            self.in_head = True
        elif tag == "title":
            self.in_title = True
        elif tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.link = dict(attrs).get("href") or ""
            self.text.append("[" if self.link else "")
        elif tag in ("strong", "b"):
            self.text.append("**")
        elif tag in ("em", "i"):
            self.text.append("*")
        elif tag == "code" and not self.pre:
            self.text.append("`")
        elif tag in ("td", "th"):
            self.text, self.block = [], "tr"
        elif tag in BLOCKS:
            self.flush()
            if tag in ("ul", "ol"):
                self.lists.append(tag)
            elif tag == "pre":
                self.pre += 1
            elif tag == "hr":
                self.out.append("\n---\n\n")
            elif tag == "tr":
                self.cells = []
            if tag not in ("ul", "ol", "hr", "pre"):
                self.block = tag

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "head":
            self.in_head = False
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.link:
            self.text.append(f"]({self.link})")
            self.link = ""
        elif tag in ("strong", "b"):
            self.text.append("**")
        elif tag in ("em", "i"):
            self.text.append("*")
        elif tag == "code" and not self.pre:
            self.text.append("`")
        elif tag in ("td", "th"):
            self.cells.append(" ".join("".join(self.text).split()).replace("|", "\\|"))
            self.text = []
        elif tag == "tr":
            self.out.append(f"| {' | '.join(self.cells)} |\n")
            self.cells, self.block = [], ""
        elif tag == "pre" and self.pre:
            self.out.append("\n```\n" + "".join(self.text).strip("\n") + "\n```\n\n")
            self.text, self.pre = [], self.pre - 1
        elif tag in BLOCKS:
            self.flush()
            self.block = ""
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip and not self.in_head:
            self.text.append(data)


def from_html(html: str) -> tuple[str, str]:
    p = Markdown()
    p.feed(html)
    p.close()
    p.flush()
    return p.title.strip(), re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


_PAGE = StructType([StructField("title", StringType()), StructField("markdown", StringType())])


@F.pandas_udf(_PAGE)
def page_markdown(html: pd.Series) -> pd.DataFrame:
    """Title and Markdown of HTML; null for null."""
    done = [(None, None) if h is None else from_html(h) for h in html]
    return pd.DataFrame(done, columns=["title", "markdown"])


HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(```|~~~)")


def slug(heading: str) -> str:
    return re.sub(r"[\W_]+", "-", heading.lower()).strip("-")


def sections(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(symbol, body, first line, last line) of each second or third level section outside fences; what comes first is __intro__."""
    symbol, body, first, above, fenced = "__intro__", [], 1, "", False
    lines = text.replace("\r\n", "\n").split("\n")
    for no, line in enumerate(lines, 1):
        fenced ^= bool(FENCE.match(line))
        m = None if fenced else HEADING.match(line)
        if m and len(m[1]) in (2, 3):
            yield symbol, "\n".join(body), first, no - 1
            own = slug(m[2])
            above = own if len(m[1]) == 2 else above
            symbol, body, first = own if len(m[1]) == 2 or not above else f"{above}/{own}", [], no
        body.append(line)
    yield symbol, "\n".join(body), first, len(lines)


def tail(text: str, overlap: int) -> str:
    """About overlap tokens from the end of a part, from a word's start."""
    return re.sub(r"^\S*\s", "", text[-overlap * 4 :], count=1) if len(text) > overlap * 4 else text


def parts(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """A section in parts of at most most tokens (a quarter of the bytes), cut between paragraphs, words if need be; a part repeats the end of the one before."""
    if (len(text.encode()) + 3) // 4 <= most:
        return [text]
    pieces = []
    for paragraph in re.split(r"(?<=\n\n)", text):
        while len(paragraph) > most * 4:
            cut = max(paragraph.rfind(" ", 0, most * 4), paragraph.rfind("\n", 0, most * 4))
            cut = cut if cut > 0 else most * 4
            pieces.append(paragraph[:cut])
            paragraph = paragraph[cut:]
        pieces.append(paragraph)
    out, current, fresh = [], "", False
    for piece in pieces:
        if fresh and len(current) + len(piece) > most * 4:
            out.append(current.strip())
            current, fresh = tail(current, overlap), False
        current, fresh = current + piece, fresh or bool(piece.strip())
    return out + [current.strip()] if fresh and current.strip() else out


CHUNK = "symbol string, content string, start_line int, end_line int"


def markdown_chunks(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row per chunk of each document: the columns in keep, symbol, content, lines. Repeated headings get #2, #3; parts of a long section #part2, #part3. Empty and null documents have none."""
    keep = keep or ["path"]
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                seen: dict[str, int] = {}
                for symbol, body, first, last in sections(row[-1] or ""):
                    if not body.strip():
                        continue
                    seen[symbol] = seen.get(symbol, 0) + 1
                    own = symbol if seen[symbol] == 1 else f"{symbol}#{seen[symbol]}"
                    rows += [(*row[:-1], own if i == 0 else f"{own}#part{i + 1}", part, first, last) for i, part in enumerate(parts(body.strip()))]
            yield pd.DataFrame(rows, columns=[*keep, *names])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [CHUNK])
    return docs.select(*keep, docs[text].alias("__text")).mapInPandas(run, ddl)


#: Bytes of a plain-text chunk at most, and bytes in which a NUL makes a file binary.
PLAIN_BYTES, LOOK = 16 * 1024, 8000


def is_binary(content: Column) -> Column:
    """Whether a file's bytes look binary: a NUL near the start."""
    return F.locate("\x00", F.decode(F.substring(content, 1, LOOK), "ISO-8859-1")) > 0


def plain_chunks(files: DataFrame) -> DataFrame:
    """One chunk per text file without a grammar: path, symbol (the path), language, content (its first PLAIN_BYTES bytes), start_line, end_line.

    files: path, content (binary). Binary, empty, blank and null files have none. The bound is the rule itself: it keeps a huge file from being one chunk.
    """
    text = F.decode(F.substring("content", 1, PLAIN_BYTES), "UTF-8")
    kept = files.where(F.col("content").isNotNull() & ~is_binary(F.col("content")) & F.decode("content", "ISO-8859-1").rlike(r"[^\s]"))
    return kept.select("path", F.col("path").alias("symbol"), F.lit("text").alias("language"), text.alias("content"), F.lit(1).alias("start_line"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("end_line"))


def with_ids(chunks: DataFrame, scope: str, path: str) -> DataFrame:
    """chunks with chunk_id (of scope, path and symbol) and content_hash."""
    return chunks.withColumn("chunk_id", F.left(F.sha2(F.concat_ws("::", scope, path, "symbol"), 256), F.lit(16))).withColumn("content_hash", F.sha2("content", 256))
