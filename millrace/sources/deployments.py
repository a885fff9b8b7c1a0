"""Deployment files: multi-document YAML read into rows, and the services that a repository is deployed as."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of objects that run something, and files and folders that hold them.
RUNNING = ("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job", "Rollout")
COMPOSE = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
SERVERLESS = ("serverless.yml", "serverless.yaml")
FOLDERS = ("k8s", "kubernetes", "manifests", "deploy", "helm")
LABEL = r"(?mi)^LABEL\s+.*(?:service|app|org\.opencontainers\.image\.title)=[\"']?([A-Za-z0-9.\-_]+)"
NAME = r"[A-Za-z0-9.\-_]+"

CONTAINER = "kind string, name string, container string, image string, env array<string>, ports array<int>"
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\-?:,\[\]{}&*!|>'"%@`][^#]*?|-[^\s#][^#]*?|\{\{.*?\}\}[^#:]*?)\s*:(?=\s|$)""")


def bare(text: str) -> str:
    """A line without the remark at its end; a mark within quotes is none."""
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and (i == 0 or text[i - 1] in " \t[{,:-(" or text[i - 1] == c):
            quote = c  # also where a doubled quote goes on
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.rstrip()


def scalar(text: str):
    """The value of what stands on one line: a text, or a list or map in brackets. Anchors and tags fall away."""
    text = re.sub(r"^(?:[&!]\S*\s*)+", "", text.strip())
    if text[:1] == '"' and text.endswith('"') and len(text) > 1:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if text[:1] == "'" and text.endswith("'") and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[:1] == "[" and text.endswith("]"):
        return [scalar(x) for x in split(text[1:-1])]
    if text[:1] == "{" and text.endswith("}") and not text.startswith("{{"):
        return {str(scalar(k)): scalar(v) for k, _, v in (x.partition(":") for x in split(text[1:-1]))}
    return None if text in ("", "~", "null") else text


def split(text: str) -> list[str]:
    """Parts between commas that stand in no brackets or quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x for x in [*out, text[start:]] if x.strip()]


class Lines:
    """The lines of one document, of which each has its indentation; a dash that opens an item leaves the rest of its line indented behind it."""

    def __init__(self, text: str):
        self.rows = [(len(line) - len(line.lstrip(" ")), line) for line in text.expandtabs(4).split("\n")]
        self.at = 0

    def next(self) -> tuple[int, str] | None:
        while self.at < len(self.rows):
            indent, line = self.rows[self.at]
            text = bare(line.strip())
            if text:
                return indent, text
            self.at += 1
        return None

    def node(self, least: int):
        """The value that begins at the next line, if that is indented by least or more. What makes no sense is passed over."""
        row = self.next()
        if row is None or row[0] < least:
            return None
        indent, text = row
        if text == "-" or text.startswith("- "):
            return self.items(indent)
        if KEY.match(text):
            return self.pairs(indent)
        self.at += 1
        return scalar(text)

    def items(self, indent: int) -> list:
        out = []
        while (row := self.next()) and row[0] == indent and (row[1] == "-" or row[1].startswith("- ")):
            rest = row[1][1:].lstrip()
            if not rest:
                self.at += 1
                out.append(self.node(indent + 1))
            elif KEY.match(rest) or rest == "-" or rest.startswith("- "):
                deeper = indent + len(row[1]) - len(rest)
                self.rows[self.at] = (deeper, " " * deeper + rest)
                out.append(self.node(deeper))
            else:
                self.at += 1
                out.append(self.block(rest, indent) if rest[0] in "|>" else scalar(rest))
            self.skip(indent)
        return out

    def pairs(self, indent: int) -> dict:
        out = {}
        while (row := self.next()) and row[0] == indent and (m := KEY.match(row[1])):
            key, rest = str(scalar(m[1])), row[1][m.end() :].strip()
            self.at += 1
            if rest[:1] in ("|", ">") and re.fullmatch(r"[|>][+\-0-9]*", rest):
                value = self.block(rest, indent)
            elif rest and not re.fullmatch(r"(?:[&!]\S*\s*)+", rest):
                value = scalar(rest)
            else:
                after = self.next()
                # a list may stand no deeper than the key that it belongs to
                value = self.items(indent) if after and after[0] == indent and after[1].startswith("-") else self.node(indent + 1)
            out[key] = value
            self.skip(indent)
        return out

    def block(self, mark: str, indent: int) -> str:
        lines = []
        while self.at < len(self.rows) and (not self.rows[self.at][1].strip() or self.rows[self.at][0] > indent):
            lines.append(self.rows[self.at][1].strip())
            self.at += 1
        return ("\n" if mark[0] == "|" else " ").join(lines).strip()

    def skip(self, indent: int) -> None:
        while (row := self.next()) and row[0] > indent:
            self.at += 1


def documents(text: str) -> list:
    """The values of all documents in a text, in order; empty ones are left out."""
    found = (Lines(part).node(0) for part in re.split(r"(?m)^---(?:[ \t].*)?$", text.replace("\r\n", "\n")))
    return [d for d in found if d is not None]


def mapping(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def rows_of(x: object) -> list:
    return x if isinstance(x, list) else []


def numbers(values: list) -> list[int]:
    """Ports as numbers: of a pair the last, of a map its containerPort or target."""
    out = []
    for v in values:
        v = v.get("containerPort") or v.get("target") if isinstance(v, dict) else v
        found = re.search(r"(\d+)(?:/\w+)?$", str(v or ""))
        out += [int(found[1])] if found else []
    return out


def names(env: object) -> list[str]:
    if isinstance(env, dict):
        return [str(k) for k in env]
    return [str(e.get("name")) if isinstance(e, dict) else str(e).partition("=")[0] for e in rows_of(env) if e]


def containers(doc: object, compose: bool) -> Iterator[dict]:
    """What one document runs: each container of an object, each service of a compose file."""
    doc = mapping(doc)
    if compose:
        for name, s in mapping(doc.get("services")).items():
            s = mapping(s)
            yield {"kind": "service", "name": name, "container": name, "image": s.get("image"), "env": names(s.get("environment")), "ports": numbers(rows_of(s.get("ports")))}
        return
    name, spec = mapping(doc.get("metadata")).get("name"), mapping(doc.get("spec"))
    if doc.get("kind") == "CronJob":
        spec = mapping(mapping(spec.get("jobTemplate")).get("spec"))
    if doc.get("kind") in RUNNING and isinstance(name, str) and "{{" not in name:
        found = rows_of(mapping(mapping(spec.get("template")).get("spec")).get("containers"))
        for c in map(mapping, found or [{}]):
            yield {"kind": doc["kind"], "name": name, "container": c.get("name"), "image": c.get("image"), "env": names(c.get("env")), "ports": numbers(rows_of(c.get("ports")))}


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_objects(path: Column) -> Column:
    """YAML below a folder of deployments that has no other meaning."""
    folders = F.concat(F.lit("/"), path)
    return path.rlike(r"\.ya?ml$") & ~base(path).isin(*COMPOSE, *SERVERLESS, "Chart.yaml") & folders.rlike(rf"/(?:{'|'.join(FOLDERS)})/")


def deployments(files: DataFrame) -> DataFrame:
    """repo, path, document (from 0) and the containers that objects and compose files run, in the order of the file. files: repo, path, content.

    Other files, null and empty contents give nothing, nor do documents that run nothing; what can't be read as YAML is passed over.
    """
    chosen = files.where(is_objects(F.col("path")) | base(F.col("path")).isin(*COMPOSE)).select("repo", "path", F.coalesce("content", F.lit("")).alias("content"))
    kinds = {"kind": pa.string(), "name": pa.string(), "container": pa.string(), "image": pa.string(), "env": pa.list_(pa.string()), "ports": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int, dict]] = []
            for i, (path, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for n, doc in enumerate(documents(text)):
                    found += [(i, n, c) for c in containers(doc, path.rpartition("/")[2] in COMPOSE)]
            rows = pa.array([i for i, _, _ in found], pa.int64())
            told = [pa.array([c[k] if kind.num_fields or c[k] is None else str(c[k]) for _, _, c in found], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([n for _, n, _ in found], pa.int32()), *told], names=["repo", "path", "document", *kinds])

    return chosen.mapInArrow(run, f"repo {files.schema['repo'].dataType.simpleString()}, path string, document int, {CONTAINER}")


def deployed_as(files: DataFrame) -> DataFrame:
    """repo, service and path: the names under which a repository's files deploy it, each once."""
    text, name = F.coalesce("content", F.lit("")), base(F.col("path"))
    top = lambda key: F.regexp_extract(text, rf"(?m)^{key}:\s*[\"']?({NAME})[\"']?\s*$", 1)
    said = F.when(name == "Chart.yaml", top("name")).when(name.isin(*SERVERLESS), top("service")).when((name == "Dockerfile") | name.startswith("Dockerfile."), F.regexp_extract(text, LABEL, 1))
    return files.select("repo", said.alias("service"), "path").where("service <> ''").unionByName(deployments(files).select("repo", F.col("name").alias("service"), "path")).distinct()
