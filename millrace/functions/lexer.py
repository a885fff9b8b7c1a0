"""What of a source file matters to a machine: its tokens without comments, blanks and the wording of its texts, in six languages.

No grammar: one pass over comments, texts, words, numbers and marks, with as much state as indentation and brackets need.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LANGUAGES = {
    "go": ("go",), "java": ("java",), "python": ("py", "pyi"), "typescript": ("ts", "mts", "cts", "tsx"), "javascript": ("js", "mjs", "cjs", "jsx"), "rust": ("rs",),
}
BY_ENDING = {ending: language for language, endings in LANGUAGES.items() for ending in endings}

_PLAIN = r'"(?:[^"\\\n]|\\[\s\S])*"?'
_QUOTED = r"'(?:[^'\\\n]|\\[\s\S])*'?"
_TICKS = r"`(?:[^`\\]|\\[\s\S])*`?"
_SLASHES = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
#: Comments and texts of each language; what begins like both is the first that fits.
FORMS = {
    "go": (_SLASHES, rf"`[^`]*`?|{_PLAIN}|{_QUOTED}"),
    "java": (_SLASHES, rf'"""[\s\S]*?(?:"""|\Z)|{_PLAIN}|{_QUOTED}'),
    "python": (r"#[^\n]*", rf"(?i:[rbuf]{{0,2}})(?:'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|{_PLAIN}|{_QUOTED})"),
    "typescript": (_SLASHES, rf"{_TICKS}|{_PLAIN}|{_QUOTED}"),
    "javascript": (_SLASHES, rf"{_TICKS}|{_PLAIN}|{_QUOTED}"),
    # a quote that closes behind one character is a character, else it begins a lifetime; comments nest, and are taken by depth
    "rust": (r"//[^\n]*|(?P<nested>/\*)", rf'b?r(?P<fence>#*)"[\s\S]*?(?:"(?P=fence)|\Z)|b?{_PLAIN}|b?\'(?:\\[^\n]+?|[^\\\n\'])\''),
}
SCANNERS = {
    language: re.compile(rf"(?P<comment>{comment})|(?P<text>{text})|(?P<line>\n)|(?P<blank>[^\S\n]+|\\\n)|(?P<word>[^\W\d]\w*|[$@]\w+|'\w+)|(?P<number>\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<mark>[\s\S])")
    for language, (comment, text) in FORMS.items()
}
# What reads a setting by its name.
SETTINGS = {"getenv", "Getenv", "LookupEnv", "get_env", "env", "var", "var_os", "option_env", "getProperty"}
# Words before a text that names another file.
IMPORTS = {"import", "from", "require", "include", "export"}


def kept_text(text: str, before: list[str]) -> bool:
    """Whether a text is more than wording: a key in brackets, the name of a setting, a file that is imported, or part of an annotation."""
    last, open_ = (before[-1:] or [""])[0], before[-3:]
    if last == "[" or last in IMPORTS:
        return True
    if last != "(":
        return False
    called = [t for t in open_[:-1] if t != "!"][-1:]
    return bool(called) and (called[0] in SETTINGS or called[0] in IMPORTS or called[0].startswith("@"))


def inner(text: str, language: str) -> list[str]:
    """Expressions that a text takes in, without blanks."""
    if language in ("typescript", "javascript") and text.startswith("`"):
        found = re.findall(r"\$\{([^}]*)\}", text)
    elif language == "python" and "f" in re.match("[A-Za-z]*", text)[0].lower():
        found = re.findall(r"\{([^{}]+)\}", text.replace("{{", "").replace("}}", ""))
    else:
        return []
    return ["${" + re.sub(r"\s+", "", x) + "}" for x in found]


def significant(source: str, language: str) -> list[str]:
    """The tokens of a file that matter, in order. Texts are "s" but where their wording counts; a statement that is but a text counts as
    a comment; in Python, indentation counts as marks of its own."""
    scan, out, at = SCANNERS[language], [], 0
    python, imports = language == "python", False
    depth, indents, fresh, column = 0, [0], True, 0  # open brackets; indentation of open blocks; whether a line begins, and where
    while at < len(source):
        m = scan.match(source, at)
        kind, own, at = m.lastgroup, m[0], m.end()
        kind = "comment" if kind == "nested" else "text" if kind == "fence" else kind
        if kind == "comment":
            if own == "/*" and language == "rust":
                at = nested_end(source, at)
            continue
        if kind == "line":
            fresh, column, imports = True, 0, imports and depth > 0
            continue
        if kind == "blank":
            column += len(own.expandtabs(8)) if fresh else 0
            continue
        first, fresh = fresh, False
        if kind == "text" and first and not depth and (not out or out[-1] not in ("=", "return", "+", ",")) and re.match(r"[^\S\n]*(?:#[^\n]*|//[^\n]*)?(?:;|\n|\Z)", source[at : at + 400]):
            if out[-1:] != ["from"] and not inner(own, language):
                continue  # a text alone on its line says nothing
        if python and first and not depth:
            while column < indents[-1]:
                indents.pop()
                out.append("<")
            if column > indents[-1]:
                indents.append(column)
                out.append(">")
            out.append(";")
        if kind == "text":
            out.append("s:" + own if imports or kept_text(own, out) else "s")
            out.extend(inner(own, language))
            continue
        if first and own in ("import", "use", "from"):
            imports = True
        depth += (own in "([{" and kind == "mark") - (own in ")]}" and kind == "mark")
        depth = max(depth, 0)
        out.append(own)
    return [t for t in out if t != ";"] if not python else out


def nested_end(source: str, at: int) -> int:
    """Where a comment ends that others may stand in."""
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


def without_remarks(source: str, language: str) -> tuple[str, str]:
    """A file with its comments blanked, lines kept: once with the insides of its texts blanked too, once with those of one line left."""
    scan, code, quoted, at = SCANNERS[language], [], [], 0
    while at < len(source):
        m = scan.match(source, at)
        kind, own, at = m.lastgroup, m[0], m.end()
        if kind == "nested":
            at = nested_end(source, at)
            own = source[m.start() : at]
        if kind in ("comment", "nested"):
            gone = re.sub(r"[^\n]", " ", own)
            code.append(gone)
            quoted.append(gone)
        elif kind in ("text", "fence"):
            gone = '"' + re.sub(r"[^\n]", " ", own[1:-1]) + ('"' if len(own) > 1 else "")
            code.append(gone)
            quoted.append(gone if "\n" in own else own)
        else:
            code.append(own)
            quoted.append(own)
    return "".join(code), "".join(quoted)


def language_of(path: Column) -> Column:
    """The language of a path by its ending; null for others."""
    table = F.create_map(*(F.lit(x) for kv in BY_ENDING.items() for x in kv))
    return F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


@F.pandas_udf(StringType())
def _key(language: pd.Series, source: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], str] = {}

    def one(name: str | None, text: str | None) -> str | None:
        if name not in SCANNERS or text is None:
            return None
        if (name, text) not in seen:
            seen[name, text] = hashlib.sha256("\x1f".join(significant(text, name)).encode()).hexdigest()
        return seen[name, text]

    return pd.Series([one(a, b) for a, b in zip(language, source, strict=True)], dtype=object)


def significant_key(path: Column, source: Column) -> Column:
    """A hash that two contents share if they differ in nothing that matters; null for other languages and where there is no content."""
    return _key(language_of(path), source)


@F.pandas_udf(StructType([StructField("code", StringType()), StructField("quoted", StringType())]))
def _bare(language: pd.Series, source: pd.Series) -> pd.DataFrame:
    both = [without_remarks(b or "", a) if a in SCANNERS else (None, None) for a, b in zip(language, source, strict=True)]
    return pd.DataFrame(both, columns=["code", "quoted"], dtype=object)


def bare(path: Column, source: Column) -> Column:
    """code and quoted: a content without comments and texts, and without comments and texts of several lines; lines stay. Null for other languages."""
    return _bare(language_of(path), source)
