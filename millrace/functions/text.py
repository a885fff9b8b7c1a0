"""Text functions of the signal pipeline as column expressions: normalising, scrubbing, redacting, fingerprints, small helpers."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary; the engine's own also looks at other letters. Behind a character of a word it is END.
B = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
END = r"(?![0-9A-Za-z_])"


def start(first: str) -> str:
    """The boundary before one of the characters of a word in first, which are looked at before what stands behind."""
    return rf"(?=[{first}])(?<![0-9A-Za-z_])"


# Patterns and their replacements, in the order in which they apply, and what a text must hold for them to fit anywhere.
NORMAL_FORMS = [
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:z|[+-][0-9]{2}:?[0-9]{2})?", "<ts>", "0-"),
    (r"[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}", "<ts>", "0"),
    (start("0-9") + r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?" + END, "<ts>", "0:"),
    (start("0-9a-f") + r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}" + END, "<uuid>", "-"),
    (r"(?<![a-z0-9._%+-])[a-z0-9._%+-]++@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}", "<email>", "@"),
    (start("0-9") + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?" + END, "<ip>", "0."),
    (r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", "<ip>", ":"),
    (r"\"[^\"]*\"|'[^']*'|`[^`]*`", "<str>", ""),
    (r"(?:[a-z][a-z0-9+.-]*:)?(?:/[^\t\n\f\r /]*)*/[^\t\n\f\r /]*[0-9][^\t\n\f\r ]*", "<path>", "0/"),
    # a token of eight hex digits or more: any after 0x, with a letter and a digit among them otherwise
    (start("0-9a-f") + r"(?:0x[0-9a-f]{8,}|(?=[0-9a-f]{8})(?:[0-9a-f]*[0-9][0-9a-f]*[a-f][0-9a-f]*|[0-9a-f]*[a-f][0-9a-f]*[0-9][0-9a-f]*))" + END, "<hex>", "0"),
    (start("0-9") + r"[0-9]+(?:\.[0-9]+)?", "<n>", "0"),
]
NORMAL_BYTES = 512

# Secrets, in the order in which they are replaced, and texts of which one is in whatever they fit: as they are, or in any case.
SECRETS = [
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "<PRIVATE_KEY>", ("-----BEGIN ",), False),
    (start("e") + r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+", "<JWT>", ("eyJ",), False),
    (start("A") + r"(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[0-9A-Z]{16}" + END, "<AWS_KEY>", ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA"), False),
    (r"(?i)(aws_secret_access_key|secret_access_key|aws_secret)([\"']?[\t\n\f\r ]*[:=][\t\n\f\r ]*[\"']?)[A-Za-z0-9/+=]{40}", "$1$2<AWS_SECRET>", ("aws_secret", "secret_access_key"), True),
    (start("A") + r"AIza[0-9A-Za-z_-]{35}" + B, "<GCP_API_KEY>", ("AIza",), False),
    (start("g") + r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})" + END, "<GITHUB_TOKEN>", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), False),
    (start("x") + r"xox[abposr]-[A-Za-z0-9-]{10,}", "<SLACK_TOKEN>", ("xox",), False),
    (start("rs") + r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}" + END, "<STRIPE_KEY>", ("k_live_", "k_test_"), False),
    (start("s") + r"sk-[A-Za-z0-9][A-Za-z0-9_-]{19,}", "<API_KEY>", ("sk-",), False),
    (r"(?i)" + start("bt") + r"(bearer|token)[\t\n\f\r ]+[A-Za-z0-9._~+/=-]{16,}", "$1 <TOKEN>", ("bearer", "token"), True),
    (r"(?i)" + start("b") + r"(basic)[\t\n\f\r ]+[A-Za-z0-9+/]{12,}={0,2}", "$1 <CREDENTIALS>", ("basic",), True),
    (start("a-zA-Z") + r"([a-zA-Z][a-zA-Z0-9+.-]*+://[^:/\t\n\f\r @]+):([^@\t\n\f\r /]+)@", "$1:<PASSWORD>@", ("://",), False),
    (r"(?i)" + start("p") + r"(password|passwd|pwd)([\"']?[\t\n\f\r ]*[=:][\t\n\f\r ]*)(\"[^\"]*\"|'[^']*'|[^;\t\n\f\r ,&\"'}]+)", "$1$2<PASSWORD>", ("password", "passwd", "pwd"), True),
    (r"(?i)" + start("acprst") + r"(api[_-]?key|apikey|secret|client[_-]?secret|access[_-]?token|refresh[_-]?token|auth[_-]?token|token|private[_-]?key)([\"']?[\t\n\f\r ]*[:=][\t\n\f\r ]*[\"']?)([A-Za-z0-9._~+/-]{8,})", "$1$2<SECRET>", ("apikey", "api_key", "api-key", "secret", "token", "privatekey", "private_key", "private-key"), True),
]

# Personal data.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = start("0-9") + r"[0-9](?:[ -]?[0-9]){12,18}" + END
IPV6 = r"(?i)(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?:%[0-9a-z]+)?"
IPV4 = start("0-9") + r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])" + END
PHONE = r"(?:\+[0-9]{1,3}[\t\n\f\r .-]?)?\(?" + start("0-9") + r"[0-9]{3}\)?[\t\n\f\r .-][0-9]{3}[\t\n\f\r .-][0-9]{4}" + END + r"|\+[0-9]{7,15}" + END


def replace_matches(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """text with each match of pattern replaced by by(match)."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.transform(between, lambda x: F.struct(x.alias("x"))), F.transform(found, lambda x: F.struct(x.alias("x"))))
    joined = F.array_join(F.transform(pairs, lambda p: F.concat(p["0"]["x"], F.when(p["1"].isNull(), "").otherwise(by(p["1"]["x"])))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def cut_bytes(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters that takes at most limit bytes."""
    short = F.left(text, F.lit(limit))
    fit = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.struct(F.lit(0).alias("low"), F.lit(limit).alias("high")), lambda s, _: _halved(s, short, limit), lambda s: F.left(short, s["low"]))
    return F.when(F.octet_length(short) <= limit, short).otherwise(fit) if limit < 4096 else F.when(F.octet_length(short) <= limit, short).otherwise(F.decode(F.substring(F.encode(short, "UTF-8"), 1, limit), "UTF-8"))


def _halved(s: Column, text: Column, limit: int) -> Column:
    middle = ((s["low"] + s["high"] + 1) / 2).cast("int")
    fits = F.octet_length(F.left(text, middle)) <= limit
    return F.struct(F.when(fits, middle).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(F.greatest(s["low"], middle - 1)).alias("high"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def replaced_where(guard: Column, text: Column, pattern: str, by: str) -> Column:
    return let(text, lambda t: F.when(guard, F.regexp_replace(t, pattern, by)).otherwise(t))


def normalize_message(text: Column) -> Column:
    """Lower case, variable parts as placeholders, single spaces, at most 512 bytes. Null stays null."""

    def replaced(x: Column) -> Column:
        out, digit = x["low"], x["digit"]
        for pattern, placeholder, marks in NORMAL_FORMS:
            fits = [digit if m == "0" else x["low"].contains(m) for m in marks]
            guard = fits[0] & fits[1] if len(fits) > 1 else fits[0] if fits else None
            out = F.regexp_replace(out, pattern, placeholder) if guard is None else replaced_where(guard, out, pattern, placeholder)
        return let(F.trim(F.regexp_replace(out, r"[\t\n\f\r ]+", " ")), lambda t: cut_bytes(t, NORMAL_BYTES))

    low = F.lower(text)
    return let(F.struct(low.alias("low"), low.rlike("[0-9]").alias("digit")), replaced)


def scrub(text: Column) -> Column:
    """Secrets replaced by typed placeholders. A pass over a text is made only where it holds what the secret's pattern needs."""

    def replaced(x: Column) -> Column:
        out = x["text"]
        for pattern, placeholder, literals, lowered in SECRETS:
            held = [(x["low"] if lowered else x["text"]).contains(literal) for literal in literals]
            out = replaced_where(reduce(or_, held), out, pattern, placeholder)
        return out

    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), replaced)


def luhn(candidate: Column) -> Column:
    """13 to 19 digits, separators aside, that pass the Luhn checksum."""
    only = F.regexp_replace(candidate, "[^0-9]", "")
    return F.length(only).between(13, 19) & F.call_function("luhn_check", only)


def is_ipv6(candidate: Column) -> Column:
    """Eight groups, or fewer with one double colon; a zone is left out."""
    host = F.lower(F.regexp_replace(candidate, "%.*$", ""))
    groups = F.filter(F.split(host, ":"), lambda g: g != "")
    double = F.regexp_count(host, F.lit("::"))
    whole = (double == 0) & host.rlike(r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$")
    short = (double == 1) & ~host.contains(":::") & (F.size(groups) <= 7) & (host.endswith("::") | ~host.endswith(":")) & (host.startswith("::") | ~host.startswith(":"))
    return whole | short


def redact(text: Column, custom: dict[str, str] | None = None) -> Column:
    """Personal data as typed placeholders: custom patterns first, then e-mail, cards, IPv6, IPv4, phones."""
    for name, pattern in (custom or {}).items():
        text = F.regexp_replace(text, pattern, f"<{name.strip().upper()}>")
    text = F.regexp_replace(text, EMAIL, "<EMAIL>")
    text = replace_matches(text, CARD, lambda m: F.when(luhn(m), F.lit("<CARD>")).otherwise(m))
    text = replace_matches(text, IPV6, lambda m: F.when(is_ipv6(m), F.lit("<IP>")).otherwise(m))
    return F.regexp_replace(F.regexp_replace(text, IPV4, "<IP>"), PHONE, "<PHONE>")


def hashed(*parts: Column) -> Column:
    """SHA-256 over each part followed by a NUL byte; null counts as empty."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p, F.lit("")), F.char(F.lit(0))))), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    """The keyed hash of a message, as lowercase hex. key, message: binary or text; null gives null."""
    raw, said = key.cast("binary"), message.cast("binary")
    short = F.when(F.octet_length(raw) > 64, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    digits = F.rpad(F.hex(short), 128, "0")

    def padded(mark: int) -> Column:
        byte = lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(mark))
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))

    signed = F.sha2(F.concat(padded(0x5C), F.unhex(F.sha2(F.concat(padded(0x36), said), 256))), 256)
    return F.when(key.isNotNull() & message.isNotNull(), signed)


def top_frames(stack: Column) -> Column:
    """The first five in-app frames as module:function, or of all frames if none is in-app; file stands in for a missing module."""
    inside = F.exists(stack, lambda f: F.coalesce(f["in_app"], F.lit(False)))
    frames = F.when(inside, F.filter(stack, lambda f: F.coalesce(f["in_app"], F.lit(False)))).otherwise(stack)
    names = F.transform(frames, lambda f: F.concat(F.lower(F.coalesce(F.nullif(f["module"], F.lit("")), f["file"], F.lit(""))), F.lit(":"), F.lower(F.coalesce(f["function"], F.lit("")))))
    return F.slice(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x != ":"), 1, 5)


#: Sources that are one backend reached in different ways: fixed values.
FAMILIES = {"firehose": "cloudwatch", "cloudwatch": "cloudwatch", "pubsub": "gcp", "gcp": "gcp"}


def lookup(table: dict[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def fingerprints(kind: Column, source: Column, service: Column, environment: Column, exception: Column, title: Column, message: Column, frames: Column, rule: Column, resource: Column, group: Column) -> tuple[Column, Column]:
    """Fingerprint and alternative fingerprint by kind; a source's own group wins over the content, which becomes the alternative."""
    src = F.lower(source)
    said = F.when(F.trim(F.coalesce(message, F.lit(""))) == "", title).otherwise(message)
    content = hashed(F.coalesce(lookup(FAMILIES, src), src), F.lower(service), F.lower(exception), normalize_message(said), F.array_join(frames, "|"))
    named = F.when(F.coalesce(rule, F.lit("")) == "", normalize_message(title)).otherwise(rule)
    grouped = F.coalesce(group, F.lit("")) != ""
    error = ~kind.isin("alert", "security_finding", "event_bus")
    main = (
        F.when(kind == "alert", hashed(F.lit("alert"), src, named, F.lower(service), F.lower(environment)))
        .when(kind == "security_finding", hashed(F.lit("security"), src, rule, resource))
        .when(kind == "event_bus", hashed(F.lit("event_bus"), src, resource, F.lower(rule), F.lower(exception)))
        .when(grouped, hashed(F.lit("group"), src, group))
        .otherwise(content)
    )
    return main, F.when(error & grouped, content).otherwise("")


# Severities by rank, and what sources and people call them.
SEVERITIES = ("info", "warning", "error", "critical")
BY_SOURCE = {
    "pagerduty": {"high": "error", "low": "warning", "critical": "critical", "error": "error", "warning": "warning", "info": "info"},
    "opsgenie": {"p1": "critical", "p2": "error", "p3": "warning", "p4": "info", "p5": "info"},
    "wiz": {"critical": "critical", "high": "error", "medium": "warning", "low": "info", "informational": "info"},
    "sentry": {"fatal": "critical", "error": "error", "warning": "warning", "info": "info", "debug": "info"},
    "datadog": {"alert": "error", "warn": "warning", "no data": "warning", "ok": "info"},
    "cloudwatch": {"alarm": "error", "insufficient_data": "warning", "ok": "info"},
    "splunk": {"1": "info", "2": "info", "3": "warning", "4": "error", "5": "critical", "6": "critical", "severe": "critical", "low": "info", "medium": "warning", "high": "error", "critical": "critical"},
}
BY_WORD = {
    "critical": "emergency emerg alert critical crit fatal panic sev1 p1 disaster",
    "error": "error err high major severe sev2 p2 failure failed",
    "warning": "warning warn medium moderate minor sev3 p3 notice",
    "info": "info informational low debug trace default ok resolved p4 p5",
}


def severity_rank(severity: Column) -> Column:
    """1 (info) to 4 (critical), 0 for anything else."""
    return F.coalesce(lookup({s: i + 1 for i, s in enumerate(SEVERITIES)}, severity), F.lit(0))


def severity_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.nullif(rank, F.lit(0)))


def map_severity(source: Column, word: Column, fallback: Column) -> Column:
    """A source's word for a severity, by the source's own meaning, then the general one, else fallback."""
    w = F.lower(F.trim(word))
    own = lookup({f"{s} {k}": v for s, m in BY_SOURCE.items() for k, v in m.items()}, F.concat(F.lower(source), F.lit(" "), w))
    general = lookup({k: v for v, words in BY_WORD.items() for k in words.split()}, w)
    return F.coalesce(own, general, fallback)


#: Attributes that name a service, the most telling first: fixed values.
SERVICE_TAGS = ("service", "service.name", "dd.service", "k8s.label.app", "kubernetes.labels.app", "app.kubernetes.io/name", "app", "job")


def glob_pattern(glob: str) -> str:
    """A one-level glob (*, ?, [a-z], [^a-z], \\ before a sign that stands for itself) as a regular expression; a malformed one matches nothing."""
    out, i = "", 0
    literal = lambda c: c if c.isalnum() else "\\" + c
    while i < len(glob):
        c = glob[i]
        if c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", glob[i:])
            ranges = re.match(r"(?:(?:\\.|[^\\-])(?:-(?:\\.|[^\\-]))?)+\Z", m[2]) if m else None
            if not ranges:
                return "(?!)"
            out += "[" + m[1] + "".join("-" if x == "-" else literal(x[-1]) for x in re.findall(r"\\.|.", m[2])) + "]"
            i += m.end()
            continue
        if c == "\\":
            if i + 1 == len(glob):
                return "(?!)"
            i, c = i + 1, glob[i + 1]
            out += literal(c)
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or literal(c)
        i += 1
    return f"^{out}$"


def path_pattern(glob: str) -> str:
    """A path glob: ** crosses directories, * and ? do not; **/ may match nothing."""
    out, i = "^", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]" if glob[i] == "?" else glob[i] if glob[i].isalnum() else "\\" + glob[i]), i + 1
    return out + "$"


def filled(x: Column) -> Column:
    """x trimmed, null if that leaves nothing."""
    return F.nullif(F.trim(x), F.lit(""))


def resolve_service(explicit: Column, attrs: Column, rules: list[tuple[str, dict[str, str]]] = ()) -> Column:
    """An explicit service, a tag, the first rule whose every glob matches, a derived name, else unknown."""
    named = F.nullif(filled(explicit), F.lit("unknown"))
    by_rule = [F.when(_all(F.coalesce(F.lower(attrs[k]).rlike(glob_pattern(g.lower())), F.lit(False)) for k, g in patterns.items()), F.lit(service)) for service, patterns in rules if patterns]
    return F.coalesce(named, *(filled(attrs[t]) for t in SERVICE_TAGS), *by_rule, filled(attrs["service.derived"]), F.lit("unknown"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4)


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def natural_key(text: Column) -> Column:
    """Sorts digit runs by value: each run is padded to 20 digits."""
    return replace_matches(text, "[0-9]+", lambda m: F.lpad(F.regexp_replace(m, "^0+(?=.)", ""), 20, "0"))


# Words that say how a question is put, not what it asks.
FILLER = "a an the please pls kindly hey hi can could would will you me us i we tell explain describe want to know about is are was were do does did".split()
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_./-]*[\p{L}\p{N}_]|[\p{L}\p{N}_]"
NAME = r"[A-Za-z_][0-9A-Za-z_./-]*[0-9A-Za-z_]"


def question_fingerprint(question: Column) -> Column:
    """The words that carry a question's meaning, in order, plurals as singulars."""
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*FILLER))
    size = F.octet_length
    single = lambda w: F.when(w.rlike("[./]"), w).when((size(w) > 4) & w.endswith("ies"), F.concat(F.left(w, F.length(w) - 3), F.lit("y"))).when((size(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w)
    return F.array_join(F.transform(words, single), " ")


def identifiers(question: Column) -> Column:
    """Sorted lower-case names of code: with dots, slashes, underscores, digits or inner capitals."""
    found = F.regexp_extract_all(question, F.lit(NAME), F.lit(0))
    return F.sort_array(F.transform(F.filter(found, lambda w: w.rlike("[./_0-9]") | F.substring(w, 2, 1 << 20).rlike("[A-Z]")), lambda w: F.lower(w)))


def same_identifiers(a: Column, b: Column) -> Column:
    """Whether every identifier of either question is among the other's names."""
    names = lambda q: F.regexp_extract_all(F.lower(q), F.lit(NAME), F.lit(0))
    return (F.size(F.array_except(identifiers(a), names(b))) == 0) & (F.size(F.array_except(identifiers(b), names(a))) == 0)


# What a question about a repository as a whole is about, and how it asks.
SUBJECT = r"\b(repo|repos|repository|repositories|project|codebase|code base|service|services|app|application|system|platform|architecture)\b"
ASK = r"\b(explain|overview|summar\w*|describe|introduce|how (does|do|is|are)\b.*\bwork|what (is|does|are)\b|architecture|structure|walk me through|get started|onboard\w*)"


def is_overview_question(question: Column) -> Column:
    return F.lower(question).rlike(SUBJECT) & F.lower(question).rlike(ASK)
