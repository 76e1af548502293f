"""Personal data: native candidate generators, boosted trees over their features, calibrated cuts, redaction.

Base spans (e-mail, IP, card and phone numbers by their patterns and check sums) always stand. Besides them,
generators with high recall propose spans that may overlap each other: written-out addresses, local phone
numbers, grouped identity numbers and account numbers. Their format and context features go through trees
boosted on labelled examples; a logistic calibration on held-out examples turns the score into a probability, and
per generator the lowest cut with the wanted precision there decides. Of overlapping proposals the most probable
stays, and none may overlap a base span.

The examples are composed from a fixed grammar of formats and contexts, ``TRAIN`` of them by a fixed seed; the
features of examples and documents come from the same native expressions, and the trees become one SQL
expression, so documents never leave the JVM.

Defined results: a null text is empty; a text without spans is unchanged; repeated rows are judged alike; other
columns go through redaction untouched; empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.llm import spans as sp

TRAIN = 3000  # labelled examples, half of them held out for the calibration
ROUNDS, RATE, LEAVES = 40, 0.3, 4
PRECISION = 0.99
SEED = 7

# The base patterns. Possessive and guarded forms match the same texts as the plain ones, but
# long runs of one character class stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"  # also finds lone digits, which the length drops
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
BASE = ("email", "ip", "card", "phone")
GENERATORS = {
    "written_email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,64}){1,8}",
    "local_phone": r"(?<![0-9A-Za-z])\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,5}(?![0-9A-Za-z])",
    "id_number": r"(?<![0-9A-Za-z])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
# Words that announce personal data, and words that announce other numbers.
CUES = r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|mail|contact|reach|write|ssn|social|passport|iban|account|konto|telefon)[^\n]{0,16}$"
OTHER = r"(?i)(?:version|order|invoice|isbn|part|item|page|section|release|build|ratio|score|total|sum|no\.|#|\$|€|%)[^\n]{0,6}$"
PROPOSAL = "struct<start:int,end:int,g:int,p:double>"
FEATURES = ("digits", "letters", "signs", "length", "kinds", "cue", "other", "bracket", "round", "after_unit", "generator")


def digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def _card(match: Column) -> Column:
    n = F.length(digits(match))
    return F.when((n >= 16) & (n <= 19), luhn(digits(match))).otherwise(False)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``email``, ``ip``, ``card`` and ``phone`` spans."""
    df = sp.with_matches(docs, text, "email", EMAIL)
    df = sp.with_matches(df, text, "ip", IP, lambda m: m.rlike(IP_PARTS))
    df = sp.with_matches(df, text, "card", CARD, _card)
    return sp.with_matches(df, text, "phone", PHONE, lambda m: F.length(digits(m)).between(8, 15))


def features(body: Column, before: Column, after: Column, generator: int) -> list[Column]:
    """Whole numbers in the order of ``FEATURES``."""
    d = digits(body)
    return [
        F.length(d), F.length(F.regexp_replace(body, "[^A-Za-z]", "")), F.length(F.regexp_replace(body, "[A-Za-z0-9]", "")),
        F.length(body), F.size(F.array_distinct(F.split(d, ""))), before.rlike(CUES).cast("int"), before.rlike(OTHER).cast("int"),
        body.rlike(r"[\[(]").cast("int"), d.rlike("0{3}$").cast("int"), after.rlike(r"^\x20?(?:%|€|\$|kg|km|ms|GB|MB|px|cm)").cast("int"),
        F.lit(generator),
    ]


# --- labelled examples -----------------------------------------------------------------------------

def _example(rng: random.Random) -> tuple[str, str, str, int, int]:
    """(before, body, after, generator, label) of one example."""
    def d(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word() -> str:
        return "".join(rng.choice(("an", "re", "ti", "on", "sta", "le", "mi", "so", "ver", "da")) for _ in range(rng.randint(1, 4)))

    prose = f"{word()} {word()} {word()} "
    cue = prose + rng.choice(("phone: ", "call me at ", "Tel. ", "mobile ", "contact ", "fax ", "telefon "))
    other = prose + rng.choice(("order ", "invoice no. ", "version ", "part ", "total $", "page ", "ratio ", "#"))
    tail = rng.choice((" ", ". ", ", ")) + word()
    generator, label = rng.randrange(4), rng.randrange(2)
    if generator == 0:
        if label:
            body = f"{word()}.{word()} (at) {word()} (dot) {rng.choice(('com', 'org', 'net', 'de'))}"
            return rng.choice((prose, cue)), body, tail, 0, 1
        return prose, f"{word()} (at) {word()} (dot) {word()}{word()}{word()}{word()}{word()}", tail, 0, 0
    if generator == 1:
        if label:
            body = rng.choice((f"({d(3)}) 555-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(3)}{d(4)}"))
            return cue, body, tail, 1, 1
        body = rng.choice((f"{d(2)}.{d(3)}.000", f"{d(3)}-{d(4)}-{d(3)}", f"{d(4)} {d(3)} {d(3)}", f"{d(2)}/{d(4)} {d(4)}", f"{d(3)} {d(3)} {d(3)}"))
        return rng.choice((other, prose)), body, rng.choice((tail, " km", " %", " kg")), 1, 0
    if generator == 2:
        body = f"{d(3)}-{d(2)}-{d(4)}"
        if label:
            return prose + rng.choice(("SSN ", "social security ", "passport ")), body, tail, 2, 1
        return rng.choice((other, prose)), rng.choice((body, body.replace("-", " "))), tail, 2, 0
    if label:
        return prose + rng.choice(("IBAN ", "account ", "Konto: ", "")), f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", tail, 3, 1
    return rng.choice((other, prose)), "".join(rng.choice("ABCDEFGH") for _ in range(2)) + d(2) + "".join(
        rng.choice("ABCDEFGHIJKLMNOP") for _ in range(12)), tail, 3, 0


def labelled_examples(spark: SparkSession, n: int = TRAIN, seed: int = SEED) -> list[tuple[list[int], int]]:
    """Feature vectors and labels of ``n`` composed examples, by the expressions that documents go through."""
    rng = random.Random(seed)
    rows = [dict(zip(("i", "before", "body", "after", "generator", "label"), (i, *_example(rng)))) for i in range(n)]
    shape = "array<struct<i:int,before:string,body:string,after:string,generator:int,label:int>>"
    df = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), shape)))
    by = [F.array(*features(F.col("body"), F.col("before"), F.col("after"), 0)[:-1], F.col("generator")).alias("x"), "label"]
    return [(list(r["x"]), r["label"]) for r in df.orderBy("i").select(*by).collect()]


# --- boosted trees ---------------------------------------------------------------------------------

def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def boost(rows: list[tuple[list[int], int]], rounds: int = ROUNDS, rate: float = RATE, leaves: int = LEAVES) -> list:
    """Trees by gradient boosting on the logistic loss. A tree is a leaf value or (feature, cut, low, high).

    Equal feature vectors are one cell with counts, so a round costs no more than there are cells.
    """
    cells: dict[tuple, list[float]] = {}
    for x, y in rows:
        cells.setdefault(tuple(x), [0, 0])[y] += 1
    data = [(x, n0 + n1, n1) for x, (n0, n1) in sorted(cells.items())]
    score = [0.0] * len(data)

    def grow(members: list[int], grad: list[float], hess: list[float], depth: int):
        g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
        best = (1e-6, None)
        if depth:
            for f in range(len(FEATURES)):
                by: dict[int, list[float]] = {}
                for i in members:
                    cell = by.setdefault(data[i][0][f], [0.0, 0.0])
                    cell[0] += grad[i]
                    cell[1] += hess[i]
                gl = hl = 0.0
                for v in sorted(by)[:-1]:
                    gl, hl = gl + by[v][0], hl + by[v][1]
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, v))
        if best[1] is None:
            return rate * g / (h + 1)
        f, v = best[1]
        low = [i for i in members if data[i][0][f] <= v]
        high = [i for i in members if data[i][0][f] > v]
        return (f, v, grow(low, grad, hess, depth - 1), grow(high, grad, hess, depth - 1))

    trees = []
    for _ in range(rounds):
        p = [_sigmoid(s) for s in score]
        grad = [n1 - n * q for (_, n, n1), q in zip(data, p)]
        hess = [n * q * (1 - q) for (_, n, _), q in zip(data, p)]
        trees.append(grow(list(range(len(data))), grad, hess, int(math.log2(leaves))))
        score = [s + value(trees[-1], x) for s, (x, _, _) in zip(score, data)]
    return trees


def value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_sql(tree, x: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(x[tree[0]] <= tree[1], tree_sql(tree[2], x)).otherwise(tree_sql(tree[3], x))


def calibrate(scores: list[float], labels: list[int]) -> tuple[float, float]:
    """(a, b) of the logistic curve of a * score + b, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(30):
        g0 = g1 = 0.0
        h00 = h01 = h11 = 1e-6
        for s, y in zip(scores, labels):
            q = _sigmoid(a * s + b)
            w = q * (1 - q)
            g0, g1 = g0 + (y - q) * s, g1 + (y - q)
            h00, h01, h11 = h00 + w * s * s, h01 + w * s, h11 + w
        det = h00 * h11 - h01 * h01
        if abs(det) < 1e-9:
            break
        a, b = a + (h11 * g0 - h01 * g1) / det, b + (h00 * g1 - h01 * g0) / det
        if abs(a) > 20:
            break
    return max(0.1, min(20.0, a)), max(-20.0, min(20.0, b))


@lru_cache(maxsize=4)
def _model(spark: SparkSession, n: int, seed: int) -> tuple[list, float, float, tuple]:
    rows = labelled_examples(spark, n, seed)
    train, held = rows[::2], rows[1::2]
    trees = boost(train)
    scores = [sum(value(t, x) for t in trees) for x, _ in held]
    a, b = calibrate(scores, [y for _, y in held])
    cut = []
    for g in range(len(GENERATORS)):
        own = sorted(((_sigmoid(a * s + b), y) for s, (x, y) in zip(scores, held) if x[-1] == g), reverse=True)
        best, hits = 1.01, 0
        for k, (p, y) in enumerate(own, 1):
            hits += y
            if hits >= PRECISION * k and (k == len(own) or own[k][0] < p):
                best = p
        cut.append(max(0.5, best))
    return trees, a, b, tuple(cut)


def _scored(g: int, trees: list, a: float, b: float):
    def score(s: Column) -> Column:
        x = features(s["body"], s["before"], s["after"], g)
        total = F.lit(0.0)
        for t in trees:
            total = total + tree_sql(t, x)
        p = 1 / (1 + F.exp(-(a * total + b)))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(g).alias("g"), p.alias("p"))

    return score


def _likelier(o: Column, s: Column) -> Column:
    earlier = (o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["g"] < s["g"]))
    return (o["p"] > s["p"]) | ((o["p"] == s["p"]) & earlier)


def _passes(cut: float):
    return lambda s: s["p"] >= cut


def proposals(found: DataFrame) -> DataFrame:
    """Add ``added``: the proposals that pass their cut, don't overlap a base span, nor a likelier proposal.
    ``found`` has base spans."""
    trees, a, b, cut = _model(found.sparkSession, TRAIN, SEED)
    none = F.expr(f"cast(array() as array<{PROPOSAL}>)")
    df, all_ = found, []
    for g, (name, pattern) in enumerate(GENERATORS.items()):
        df = sp.with_matches(df, "text", f"_{name}", pattern)
        free = sp.apart(F.col(f"_{name}"), *(F.col(k) for k in BASE))
        likely = F.filter(F.transform(free, _scored(g, trees, a, b)), _passes(cut[g]))
        all_.append(F.when(F.size(f"_{name}") > 0, likely).otherwise(none))
    df = df.withColumn("_all", F.concat(*all_))
    best = sp.unbeaten(F.col("_all"), len(GENERATORS), PROPOSAL, _likelier)
    return df.withColumn("added", F.array_sort(best)).drop("_all", *(f"_{n}" for n in GENERATORS))


def _scanned(docs: DataFrame) -> DataFrame:
    body = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return proposals(base_spans(body))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with base spans by kind and ``added`` spans; other columns, whatever their names, stay out."""
    return _scanned(docs.select("doc_id", "text"))


def _named(kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _added(g: int) -> Column:
    name = list(GENERATORS)[g]
    own = F.filter("added", lambda s: s["g"] == g)
    return F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("kind")))


def digest(found: DataFrame) -> DataFrame:
    def label(spans: Column) -> Column:
        return F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))

    base = [label(_named(k)) for k in BASE]
    every = base + [label(_added(g)) for g in range(len(GENERATORS))]
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.concat(*base), ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.concat(*every), ",").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all other columns stay as they are."""
    found = _scanned(docs.select(F.struct(*docs.columns).alias("_own"), "text"))
    spans = F.concat(*(_named(k) for k in BASE), *(_added(g) for g in range(len(GENERATORS))))
    clean = found.withColumn("_spans", spans).withColumn("text", sp.redacted("text", F.col("_spans")))
    keep_null = F.when(F.col("_own.text").isNotNull(), F.col("text"))
    return clean.select([keep_null.alias("text") if c == "text" else F.col("_own")[c].alias(c) for c in docs.columns])
