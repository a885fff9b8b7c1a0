"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers. Wider generators propose overlapping candidate
spans. Boosted trees score a candidate's format and context. They are trained on labelled candidates: a bounded table of texts
that may be handed in; by default examples made here of known ways to write such data, those that the base patterns confirm
among them, and of known lookalikes. A threshold for each kind, calibrated on examples that the trees have not seen, selects the
candidates that are added to the base spans.
"""

from __future__ import annotations

import functools
import math
import operator
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base patterns in the order of the kinds. Quantified groups are possessive: the same matches, without deep recursion.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: Generators: addresses written with signs or words, any run of digits and separators, plain digits, dotted numbers.
GENERATORS = {
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "number": r"(?<![0-9])[+(]?[0-9][0-9().\x20/-]{5,}[0-9]",
    "digits": r"[0-9]{7,}+",
    "dotted": r"(?<![0-9.])[0-9]++(?:(?:\.|\[\.\]|\(\.\))[0-9]++){3}(?![0-9.])",
}
TRIGGERS = {"address": r"@|\(at\)|\[at\]|\x20dot\x20", "number": r"[0-9]{3}|[0-9][.\x20/-][0-9]", "digits": "[0-9]{7}", "dotted": r"[0-9][\]\[().]{1,3}[0-9]"}
#: Characters before and after a candidate that the context features see.
CONTEXT = 24
HINTS = {"email": "mail|kontakt|contact|correo|courriel|write to|reach", "ip": r"\bip\b|addr|host|server|login|client", "card": "card|visa|karte|carte|tarjeta|paid|credit", "phone": "tel|phone|call|fax|mobil|ring|contact"}
OTHER = "order|invoice|version|release|isbn|serial|total|price|page|date|ref|section|chapter|sku|uuid|commit|token|sum|usd|eur|since|from|item"
ROUNDS, RATE, LAMBDA = 60, 0.3, 1.0
#: Part of the selected candidates of a kind that must be personal data, in examples that were not trained on.
PRECISION = 0.98
#: Features and how many values each can take.
FEATURES = {"kind": 4, "generator": 4, "digits": 8, "groups": 5, "spaces": 3, "dots": 4, "marks": 4, "lead": 4, "label": 3, "left": 4, "right": 4, "hint": 2, "other": 2, "checked": 2, "year": 2}
#: Labelled texts at most that the trees are grown on, and as many that the thresholds are calibrated on.
ROWS = 8000


def spans(text: Column, pattern: str, trigger: Column) -> Column:
    """array<struct<start, stop, value>> of the leftmost matches that don't overlap, in code points."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.transform(between, lambda x: F.struct(x.alias("x"))), F.transform(found, lambda x: F.struct(x.alias("x"))))
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["0"]["x"])
        stop = start + F.coalesce(F.length(x["1"]["x"]), F.lit(0))
        return F.struct(stop.alias("at"), F.when(x["1"].isNull(), s["out"]).otherwise(F.array_append(s["out"], F.struct(start.alias("start"), stop.alias("stop"), x["1"]["x"].alias("value")))).alias("out"))

    return F.when(trigger, F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda s: s["out"])).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def confirmed(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, stop, kind>> of all confirmed base matches, by start, then kind as listed."""
    parts = []
    for no, kind in enumerate(KINDS):
        found = spans(text, BASE[kind], text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]"))
        parts.append(base_of(found, no, kind))
    return F.array_sort(F.concat(*parts))


def base_of(found: Column, no: int, kind: str) -> Column:
    return F.transform(F.filter(found, lambda x: confirmed(kind, x["value"])), lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("kind"), x["stop"].alias("stop")))


def count_of(value: Column, chars: str) -> Column:
    return F.length(value) - F.length(F.translate(value, chars, ""))


def bins(x: Column, *edges: int) -> Column:
    return functools.reduce(operator.add, [(x >= e).cast("int") for e in edges])


def kind_of(value: Column) -> Column:
    """The kind that a candidate's form suggests, as its number."""
    n = F.length(digits(value))
    return F.when(value.rlike(r"@|\(at\)|\[at\]|\x20at\x20"), 0).when(value.rlike(r"^[0-9]+([\[(]?\.[\])]?[0-9]+){3}$") & (n <= 12), 1).when(value.startswith("+"), 3).when(n >= 13, 2).otherwise(3)


def features(value: Column, generator: int, before: Column, after: Column) -> Column:
    """Binned format and context of a candidate."""
    bare = digits(value)
    n, kind, near = F.length(bare), kind_of(value), F.lower(F.concat(before, F.lit(" "), after))
    last, first = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    edge = lambda c: F.when(c == "", 0).when(c.rlike(r"[\x20\n\t,;:]"), 1).when(c.rlike(r"[A-Za-z0-9_]"), 2).otherwise(3)
    hint = F.coalesce(F.element_at(F.array(*(near.rlike(HINTS[k]) for k in KINDS)), kind + 1), F.lit(False))
    octets = F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("double") <= 255)
    marks = F.when(kind == 0, F.when(value.contains("@"), F.when(value.contains(" "), 1).otherwise(0)).when(value.rlike(r"[(\[]"), 2).otherwise(3)).when(value.rlike(r"[()\[]"), 1).when(value.contains("/"), 2).when(value.contains("-"), 3).otherwise(0)
    made = {
        "kind": kind, "generator": F.lit(generator), "digits": bins(n, 1, 7, 10, 12, 14, 16, 17), "groups": F.least(F.size(F.split(value, "[^0-9]+")), F.lit(4)), "spaces": F.least(count_of(value, " "), F.lit(2)), "dots": F.least(count_of(value, "."), F.lit(3)), "marks": marks,
        "lead": F.when(value.startswith("+"), 1).when(value.startswith("("), 2).when(value.startswith("0"), 3).otherwise(0), "label": bins(F.length(F.regexp_extract(value, r"([A-Za-z]+)$", 1)), 1, 2), "left": edge(last), "right": edge(first), "hint": hint.cast("int"), "other": near.rlike(OTHER).cast("int"),
        "checked": F.when(kind == 1, octets).when(kind == 2, n.between(14, 19) & F.call_function("luhn_check", bare)).when(kind == 3, n.between(9, 15)).otherwise(True).cast("int"), "year": value.rlike(r"(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)").cast("int"),
    }
    return F.struct(*(made[k].cast("int").alias(k) for k in FEATURES))


def described(text: Column, found: Column, generator: int) -> Column:
    def one(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - CONTEXT, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT)))
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), features(x["value"], generator, before, F.substring(text, x["stop"] + 1, F.lit(CONTEXT))).alias("f"))

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """array<struct<start, stop, f>>: all generators' spans with their features; they may overlap."""
    parts = []
    for no, (name, pattern) in enumerate(GENERATORS.items()):
        parts.append(described(text, spans(text, pattern, text.rlike(TRIGGERS[name])), no))
    return F.concat(*parts)


Tree = tuple[str, int, tuple[str, int, float, float], tuple[str, int, float, float]]


def best_split(rows: list[tuple[dict, float, float]]) -> tuple[float, str, int, float, float]:
    """The split (feature < edge) of cells (features, gradient, hessian) that gains most, and the leaves' values."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (0.0, "kind", 0, -g / (h + LAMBDA), -g / (h + LAMBDA))
    for name, n in FEATURES.items():
        sums = [[0.0, 0.0] for _ in range(n)]
        for f, a, b in rows:
            sums[f[name]][0] += a
            sums[f[name]][1] += b
        gl = hl = 0.0
        for edge in range(1, n):
            gl, hl = gl + sums[edge - 1][0], hl + sums[edge - 1][1]
            gain = gl * gl / (hl + LAMBDA) + (g - gl) ** 2 / (h - hl + LAMBDA) - g * g / (h + LAMBDA)
            if gain > best[0] + 1e-9:
                best = (gain, name, edge, -gl / (hl + LAMBDA), -(g - gl) / (h - hl + LAMBDA))
    return best


def boost(cells: list[tuple[dict, int, int]]) -> tuple[float, list[Tree]]:
    """Newton boosting of trees of depth two on cells (features, candidates, confirmed candidates)."""
    n, k = sum(c[1] for c in cells), sum(c[2] for c in cells)
    offset = math.log((k + 1) / (n - k + 1))
    score, trees = [offset] * len(cells), []
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in score]
        rows = [(f, m * q - c, m * q * (1 - q) + 1e-9) for (f, m, c), q in zip(cells, p, strict=True)]
        _, name, edge, _, _ = best_split(rows)
        sides = [best_split([r for r in rows if (r[0][name] < edge) == side])[1:] for side in (True, False)]
        tree = (name, edge, *[(a, e, RATE * lo, RATE * hi) for a, e, lo, hi in sides])
        trees.append(tree)
        score = [s + leaf(tree, f) for s, (f, _, _) in zip(score, cells, strict=True)]
    return offset, trees


def leaf(tree: Tree, f: dict) -> float:
    name, edge, low, high = tree
    a, e, lo, hi = low if f[name] < edge else high
    return lo if f[a] < e else hi


def score_of(f: Column, model: tuple[float, list[Tree]]) -> Column:
    """The boosted trees as one expression: log-odds."""
    total = F.lit(model[0])
    for name, edge, low, high in model[1]:
        sides = [F.when(f[a] < e, F.lit(lo)).otherwise(F.lit(hi)) for a, e, lo, hi in (low, high)]
        total = total + F.when(f[name] < edge, sides[0]).otherwise(sides[1])
    return total


def calibrated(cells: list[tuple[dict, int, int]], model: tuple[float, list[Tree]]) -> list[float]:
    """For each kind the least score from which PRECISION of the candidates are confirmed; infinite if there is none."""
    out = []
    for kind in range(len(KINDS)):
        own = sorted(((model[0] + sum(leaf(t, f) for t in model[1]), n, c) for f, n, c in cells if f["kind"] == kind), reverse=True)
        n = c = 0
        least = math.inf
        for i, (s, m, k) in enumerate(own):
            n, c = n + m, c + k
            if (i + 1 == len(own) or own[i + 1][0] < s) and c >= PRECISION * n and n >= 20:
                least = s - 1e-9
        out.append(least)
    return out


def examples(rng: random.Random) -> list[tuple[str, int, int, int, int]]:
    """Texts with one candidate each: text, its kind, start and stop in it, and whether it is personal data (1) or a lookalike (0)."""
    run = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    year, user, host, top = str(rng.randrange(1950, 2030)), rng.choice([word(), word() + "." + word(), word() + run(2)]), word() + rng.choice(["", run(1), "-" + word()]), rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
    byte = lambda: str(rng.randrange(256))
    card = run(15)
    card += str(-sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(card))) % 10)
    four, wrong = [card[i : i + 4] for i in range(0, 16, 4)], card[:-1] + str((int(card[-1]) + rng.randrange(1, 10)) % 10)
    area, local = "0" + run(rng.randrange(2, 5)), run(rng.randrange(6, 8))
    date, clock = f"{year}-{run(1)}{run(1)}-{run(2)}", f"{rng.randrange(24):02}.{rng.randrange(60):02}.{rng.randrange(60):02}"
    about = {0: ["mail me: ", "contact ", "Kontakt: ", "write to ", "reach us, "], 1: ["host ", "server ", "login from client ", "ip ", "addr="], 2: ["card ", "Visa ", "Karte: ", "paid with ", "credit card no "], 3: ["tel. ", "phone: ", "call ", "Fax ", "mobile "]}
    things = ["order ", "invoice ", "version ", "release ", "ISBN ", "serial ", "total ", "price ", "page ", "ref ", "section ", "sku ", "item ", "sum of ", "date "]
    good = [
        (0, f"{user}@{host}.{top}"), (0, f"{user} (at) {host} (dot) {top}"), (0, f"{user} [at] {host} [dot] {top}"), (0, f"{user}(at){host}.{top}"), (0, f"{user} at {host} dot {top}"), (0, f"{user} @ {host}.{top}"), (0, f"{user}[at]{host}[dot]{top}"),
        (1, ".".join((byte(), byte(), byte(), byte()))), (1, "[.]".join((byte(), byte(), byte(), byte()))), (1, "(.)".join((byte(), byte(), byte(), byte()))),
        (2, card), (2, " ".join(four)), (2, "-".join(four)), (2, ".".join(four)), (2, "/".join(four)), (2, "  ".join(four)),
        (3, f"+{run(2)} {run(3)} {run(7)}"), (3, f"({area}) {local}"), (3, f"{area}-{local}"), (3, f"{area} {local}"), (3, f"{area}/{local}"), (3, f"({run(3)}) {run(3)}-{run(4)}"), (3, f"{run(3)}-{run(3)}-{run(4)}"), (3, f"00{run(2)} {run(2)} {run(7)}"), (3, f"{run(3)}.{run(3)}.{run(4)}"),
    ]
    bad = [
        (0, f"{word()} at {word()} dot {word()}"), (0, f"{run(1)} @ {run(1)}.{run(2)}"), (0, f"{word()} @ {run(1)}.{run(1)}"), (1, f"{run(1)}.{run(1)}.{run(2)}.{run(1)}"), (1, f"{rng.randrange(256, 999)}.{byte()}.{byte()}.{rng.randrange(256, 999)}"), (1, f"{run(2)}.{run(2)}.{year}.{run(1)}"),
        (2, wrong), (2, run(18)), (2, f"{date.replace('-', '')}{run(6)}"), (2, f"978-{run(1)}-{run(2)}-{run(6)}-{run(1)}"), (2, run(20)), (2, f"{run(13)}"),
        (3, date), (3, f"{date} {clock}"), (3, f"{year}-{rng.randrange(1950, 2030)}"), (3, f"{run(1)} {run(3)} {run(3)} {run(3)}"), (3, f"{run(2)} {run(3)} {run(3)}.{run(2)}"), (3, run(8)), (3, run(10)), (3, f"{run(2)}.{run(2)}.{year}"), (3, f"{run(2)}/{run(2)}/{year}"), (3, f"{run(3)}-{run(5)}"), (3, f"{run(5)} {run(5)}"),
    ]
    out = []
    for label, kinds in ((1, good), (0, bad)):
        for kind, value in kinds:
            told = rng.random() < (0.75 if label else 0.1)
            before = f"{word()} {word()} " + (rng.choice(about[kind]) if told else rng.choice(things) if not label and rng.random() < 0.6 else f"{word()} ")
            out.append((f"{before}{value}{rng.choice([' ', ', ', '. ', chr(10), ''])}{word()}" if rng.random() < 0.95 else before + value, kind, len(before), len(before) + len(value), label))
    # digits inside tokens of letters and digits
    token = "".join(rng.choice("0123456789abcdef") for _ in range(12)) + run(9) + "".join(rng.choice("abcdef") for _ in range(9))
    return [*out, (f"{word()} token = {token} {word()}", 3, 0, 0, 0)]


def labelled(spark: SparkSession, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """text, kind, start, stop and label: rows examples, of all forms alike."""
    rng, made = random.Random(seed), []
    while len(made) < rows:
        made += examples(rng)
    return spark.createDataFrame(made[:rows], "text string, kind int, start int, stop int, label int")


def cells(texts: DataFrame) -> list[tuple[dict, int, int]]:
    """Features of all candidates of labelled texts, with their number and that of those that are personal data from end to end."""
    each = texts.select("kind", "start", "stop", "label", F.explode(candidates(F.col("text"))).alias("c"))
    good = (F.col("label") == 1) & (F.col("c.start") == F.col("start")) & (F.col("c.stop") == F.col("stop")) & (F.col("c.f.kind") == F.col("kind"))
    # no more rows than candidates of at most ROWS short texts
    return [(r.f.asDict(), r.n, r.good) for r in each.groupBy(F.col("c.f").alias("f")).agg(F.count("*").alias("n"), F.count_if(good).alias("good")).orderBy("f").collect()]


def train(spark: SparkSession, texts: DataFrame | None = None, held: DataFrame | None = None) -> tuple[tuple[float, list[Tree]], list[float]]:
    """Trees and thresholds. texts, held: labelled texts (see labelled) to grow on and to calibrate on, ROWS of each at most are used."""
    texts, held = (labelled(spark, seed=seed) if t is None else t.orderBy(F.xxhash64("text", "start")).limit(ROWS) for t, seed in ((texts, 11), (held, 12)))
    model = boost(cells(texts))
    return model, calibrated(cells(held), model)


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: tuple | None = None) -> DataFrame:
    """The columns of docs named in keep, then base and added: array<struct<start, kind, stop>>, in code points, ends exclusive.

    added holds candidates over their kind's threshold that meet no base span, the better scored of any two that overlap.
    Null texts count as empty and have no spans. Repeated rows are judged alike; other columns have no influence. An empty
    table gives no rows. model: from train(); by default trained on examples.
    """
    keep = ["doc_id"] if keep is None else keep
    trees, limits = model or train(docs.sparkSession)
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = out.select(*keep, "__text", base_spans(F.col("__text")).alias("base"), candidates(F.col("__text")).alias("__found"))
    limit = F.array(*(F.lit(x if x < math.inf else 1e300) for x in limits))
    scored = F.transform("__found", lambda c: F.struct(c["start"].alias("start"), c["f"]["kind"].alias("kind"), c["stop"].alias("stop"), score_of(c["f"], trees).alias("score")))
    passed = F.filter(scored, lambda c: (c["score"] >= F.element_at(limit, c["kind"] + 1)) & ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    out = out.select(*keep, "base", passed.alias("__passed"))
    better = lambda d, c: (d["score"] > c["score"]) | ((d["score"] == c["score"]) & ((d["start"] < c["start"]) | ((d["start"] == c["start"]) & ((d["stop"] > c["stop"]) | ((d["stop"] == c["stop"]) & (d["kind"] < c["kind"]))))))
    added = F.filter("__passed", lambda c: ~F.exists("__passed", lambda d: (d["start"] < c["stop"]) & (c["start"] < d["stop"]) & better(d, c)))
    return out.select(*keep, "base", F.array_sort(F.array_distinct(F.transform(added, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))))).alias("added"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", model: tuple | None = None) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in angle brackets; overlapping spans become the first's kind. Null stays null."""
    found = find(docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text).alias("__own")), "__own", ["__doc", "__own"], model)
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def step(s: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= s["at"], F.concat(F.substring(F.col("__own"), s["at"] + 1, x["start"] - s["at"]), F.element_at(names, x["kind"] + 1))).otherwise("")
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.concat(s["out"], piece).alias("out"))

    clean = F.aggregate(F.array_sort(F.concat("base", "added")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("__own"), s["at"] + 1, F.length(F.col("__own")))))
    clean = F.when(F.size("base") + F.size("added") > 0, clean).otherwise(F.col("__own"))
    return found.select(*(clean.alias(c) if c == text else F.col("__doc")[c].alias(c) for c in docs.columns))


def kind_is(no: int):
    return lambda k: k == no


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, and spans (base and added) for each row of docs."""
    out = find(docs)
    counts = [F.size(F.filter(F.col("base.kind"), kind_is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
