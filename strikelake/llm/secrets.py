"""Secret scan with a randomness test battery, in native expressions only.

Three patterns find the base spans: assignments to secret names, access keys and long hex strings. Every other
run of 20 or more characters of an encoding alphabet that holds a digit and a letter is a candidate. Its encoding
is inferred as the smallest alphabet that fits (hex, base32, alphanumeric, base64), and three tests ask whether its
codes look drawn at random from that alphabet: chi-squared uniformity over as many classes as the length
allows, the runs test about the middle of the alphabet, and the serial correlation of neighbours. Fisher's
method combines their p-values.

Short strings can't be told from random ones, so what counts is decided by length: per stratum (encoding and
length class) a histogram of the p-values of *all* candidates estimates how many are truly random (these
have uniform p-values, so twice those above one half), and hence for each cut t the share of false discoveries
among the candidates above t. The smallest cut whose share is at most ``FDR`` holds; a stratum without
one adds nothing. A stratum of fewer than ``THIN`` candidates, too few for an estimate, takes the cut of a
histogram with those of its neighbours: the next length classes of its encoding, further ones, then all encodings.
(A table with fewer candidates in all has no better estimate than theirs.) The histogram has at most
``STRATA * BINS`` rows whatever the corpus.

Defined results: a null text is empty; empty texts have no spans; equal rows are judged alike; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelake.llm import spans as sp
from strikelake.llm.components import stored

FDR = 0.05
BINS = 200
STRATA = 4 * 6
THIN = 100
MIN_LENGTH = 20
# The base patterns. Matches that fail their length are dropped without another try.
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""")
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of 24 and more
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH
# Alphabets by encoding; both base64 forms share their last two codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LENGTHS = (32, 48, 64, 128, 256)  # upper ends of the length classes, the last class is open


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``assign``, ``access`` and ``hex`` spans."""
    df = sp.with_matches(docs, text, "assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6)
    df = sp.with_matches(df, text, "access", ACCESS, lambda m: F.length(m) >= 20)
    return sp.with_matches(df, text, "hex", HEX)


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z, by a rational approximation good to 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # The coefficients of the approximation of erfc.
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), poly * F.exp(-x * x)))


def encoding(body: Column) -> Column:
    return (F.when(body.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike(r"^[A-Z2-7]+=*$"), "base32")
            .when(body.rlike(r"^[A-Za-z0-9]+$"), "alnum").otherwise("base64"))


def _by_encoding(kind: Column, values: dict) -> Column:
    """The value of an encoding, from one literal map."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), kind)


def _codes(body: Column, kind: Column) -> Column:
    plain = F.translate(F.translate(body, "=", ""), "-_", "+/")
    plain = F.when(kind == "hex", F.lower(plain)).otherwise(plain)
    return sp.bound(_by_encoding(kind, ALPHABETS), lambda alphabet: F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c) - 1))


def battery(candidates: DataFrame) -> DataFrame:
    """Add ``encoding``, ``stratum`` and the p-values ``p_chi``, ``p_runs``, ``p_serial`` and ``p`` to rows
    with a candidate in ``body``. Small p-values mean structure."""
    df = candidates.withColumn("encoding", encoding(F.col("body")))
    df = df.withColumn("codes", F.filter(_codes(F.col("body"), F.col("encoding")), lambda c: c >= 0))
    size = {name: len(alphabet) for name, alphabet in ALPHABETS.items()}
    df = df.withColumns({"k": _by_encoding(F.col("encoding"), size), "n": F.size("codes")})
    # Uniformity over classes with about five expected codes each; the tail by the cube root of chi-squared.
    df = df.withColumn("classes", F.greatest(F.lit(2), F.least("k", (F.col("n") / 5).cast("int"))))
    df = df.withColumn("cells", F.transform("codes", lambda c: (c * F.col("classes") / F.col("k")).cast("int")))
    seen = F.transform(F.sequence(F.lit(0), F.col("classes") - 1), lambda j: F.size(F.filter("cells", lambda c: c == j)).cast("double"))
    expected = F.col("n") / F.col("classes")
    df = df.withColumn("chi", F.aggregate(seen, F.lit(0.0), lambda a, o: a + (o - expected) * (o - expected) / expected))
    free = (F.col("classes") - 1).cast("double")
    z = (F.pow(F.col("chi") / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    df = df.withColumn("p_chi", F.when(z >= 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2))
    # Runs of codes in the upper and lower half of the alphabet.
    df = df.withColumn("half", F.transform("codes", lambda c: (2 * c >= F.col("k")).cast("int")))
    upper = F.aggregate("half", F.lit(0), lambda a, h: a + h).cast("double")
    lower = F.col("n") - upper
    turns = F.aggregate(F.sequence(F.lit(1), F.col("n") - 1), F.lit(0),
                        lambda a, i: a + F.abs(F.get("half", i) - F.get("half", i - 1)))
    df = df.withColumn("upper", upper).withColumn("lower", lower).withColumn("runs", 1.0 + turns)
    both = 2 * F.col("upper") * F.col("lower")
    mean, n = both / F.col("n") + 1, F.col("n").cast("double")
    spread = both * (both - n) / (n * n * (n - 1))
    df = df.withColumn("p_runs", F.when(spread > 0, _normal_tail((F.col("runs") - mean) / F.sqrt(spread))).otherwise(1e-300))
    # Correlation of neighbouring codes.
    middle = F.aggregate("codes", F.lit(0.0), lambda a, c: a + c) / F.col("n")
    df = df.withColumn("middle", middle)
    square = F.aggregate("codes", F.lit(0.0), lambda a, c: a + (c - F.col("middle")) * (c - F.col("middle")))
    product = F.aggregate(F.sequence(F.lit(1), F.col("n") - 1), F.lit(0.0), lambda a, i: a + (
        F.get("codes", i) - F.col("middle")) * (F.get("codes", i - 1) - F.col("middle")))
    df = df.withColumn("square", square).withColumn("product", product)
    serial = F.when(F.col("square") > 0, _normal_tail((F.col("product") / F.col("square") * n + 1) / F.sqrt(n))).otherwise(1e-300)
    df = df.withColumn("p_serial", serial)
    # Fisher's sum of three logarithms has a chi-squared tail of six degrees, which is elementary.
    half = -(F.log("p_chi") + F.log("p_runs") + F.log("p_serial"))
    df = df.withColumn("half_sum", half)
    df = df.withColumn("p", F.exp(-F.col("half_sum")) * (1 + F.col("half_sum") + F.col("half_sum") * F.col("half_sum") / 2))
    band = F.lit(len(LENGTHS))
    for i in reversed(range(len(LENGTHS))):
        band = F.when(F.col("n") <= LENGTHS[i], i).otherwise(band)
    return df.withColumn("stratum", F.concat_ws("-", "encoding", band))


def candidates(df: DataFrame) -> DataFrame:
    """Add ``tokens``: the candidates outside the base spans."""
    df = sp.with_matches(df, "text", "tokens", TOKEN, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    return df.withColumn("tokens", sp.apart(F.col("tokens"), F.col("assign"), F.col("access"), F.col("hex")))


def cuts(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """``stratum, cut``: per stratum the smallest p-value above which at most ``fdr`` of the candidates aren't random."""
    cell = F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1))
    hist: dict[tuple[str, int], np.ndarray] = {}
    for stratum, at, n in tested.groupBy("stratum", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        kind, band = stratum.rsplit("-", 1)
        hist.setdefault((kind, int(band)), np.zeros(BINS, np.int64))[at] += n
    out = []
    for kind, band in hist:
        pool = neighbourhood(hist, kind, band)
        above = pool[::-1].cumsum()[::-1]
        random = 2 * pool[BINS // 2:].sum()
        seen = np.flatnonzero(pool)
        low = seen[1 - random * (1 - seen / BINS) / above[seen] <= fdr]
        if len(low):
            out.append(F.struct(F.lit(f"{kind}-{band}").alias("stratum"), F.lit(float(low[0] / BINS)).alias("cut")))
    rows = F.array(*out) if out else F.expr("cast(array() as array<struct<stratum:string,cut:double>>)")
    return tested.sparkSession.range(1).select(F.inline(rows))


def neighbourhood(hist: dict[tuple[str, int], np.ndarray], kind: str, band: int) -> np.ndarray:
    """The histogram of a stratum, with those of the nearest others as long as it has fewer than ``THIN`` candidates."""
    pool = hist[kind, band]
    for step in range(1, len(LENGTHS) + 1):
        if pool.sum() >= THIN:
            return pool
        pool = sum((hist[k] for k in ((kind, band - step), (kind, band + step)) if k in hist), pool)
    return pool if pool.sum() >= THIN else sum(hist.values())


def scan(docs: DataFrame) -> DataFrame:
    """Per document: the base spans by kind, ``random`` spans that the battery adds, and counts.

    The texts are read once; their spans are stored, and the battery works on the stored candidates.
    """
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # A row is named by what stands in it, not by an id that rows may share.
    row = F.struct("doc_id", F.xxhash64("text").alias("hash"), F.length("text").alias("n"))
    own = ["doc_id", row.alias("_row"), *(F.transform(k, lambda s: s.dropFields("before", "after")).alias(k)
                                          for k in ("assign", "access", "hex", "tokens"))]
    named = stored(candidates(base_spans(body)).select(*own), "secrets")
    tested = stored(battery(named.select("_row", F.inline("tokens"))).select("_row", "start", "end", "stratum", "p"), "tested")
    kept = (tested.join(F.broadcast(cuts(tested)), "stratum").where("p >= cut").select("_row", "start", "end").distinct()
            .groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("random")))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    joined = named.join(kept.withColumnRenamed("_row", "_of"), F.col("_row").eqNullSafe(F.col("_of")), "left")
    return joined.select("doc_id", "assign", "access", "hex", F.coalesce("random", none).alias("random"))


KINDS = ("assign", "access", "hex", "random")


def _tagged(rank: int, kind: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(
        ":", F.lit(kind), s["start"], s["end"]).alias("label")))


def joined(*kinds: str) -> Column:
    """``kind:start:end`` of all spans of these kinds by start, then kind, comma-joined."""
    tagged = F.array_sort(F.concat(*(_tagged(r, k) for r, k in enumerate(kinds))))
    return F.array_join(F.transform(tagged, lambda s: s["label"]), ",")


def digest(found: DataFrame) -> DataFrame:
    count = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *count, F.sha2(joined(*KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
                        joined(*KINDS).alias("spans"))
