"""URL filter: host rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule ``host/path`` fits a host and all its subdomains if the URL's path starts with the rule's path; the
longest fitting rule decides. Where none fits, the automaton finds all terms in the lower-cased URL in one pass;
a term counts if no letter or digit stands before or after it. One strict term, or ``SOFT_HITS`` distinct soft terms,
reject.

Rules are applied by native expressions, one URL at a time and without a join; terms in tasks on Arrow batches.
The vocabulary is a parameter, or a table of at most ``MOST_TERMS`` terms; it travels with the task, and a Python worker builds
its automaton once.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule; the vocabulary
still looks at its whole text, and a null has no hits; repeated rows are judged alike; extra columns go through
``mark`` untouched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The rules of the checked query, as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
# The vocabulary. A strict term rejects alone, soft terms only together.
STRICT = ("porn", "xxx", "viagra", "cialis", "escort", "escorts", "hentai", "malware", "phishing", "spam-farm",
          "cheap-pills", "warez", "jackpot-slots")
SOFT = ("cheap", "pills", "spam", "farm", "free", "casino", "poker", "bet", "betting", "slots", "loan", "loans", "payday",
        "adult", "sexy", "dating", "torrent", "crack", "keygen", "discount", "replica", "win", "bonus", "click")
SOFT_HITS = 2

MOST_TERMS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest fitting rule as (rule, verdict), null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == of) | host_.endswith("." + of)) & path_.startswith(start)
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    """A term listed as both counts as strict."""
    a = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (SOFT_HITS, strict)):
        for term in terms:
            a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def load_vocabulary(spark: SparkSession, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a Parquet table ``term, weight`` (``strict`` or ``soft``), lower-cased, without empty ones."""
    table = spark.read.parquet(path).select(lower_ascii(F.trim("term")).alias("term"), "weight")
    terms = table.where("term <> '' AND weight IN ('strict', 'soft')").distinct().limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    return tuple(tuple(sorted(t.term for t in terms if t.weight == weight)) for weight in ("strict", "soft"))


def _hits(a: ahocorasick.Automaton, url: str) -> tuple[int, int]:
    """Distinct strict and soft terms of a lower-cased URL that stand between boundaries."""
    strict, soft = set(), set()
    for last, (term, weight) in a.iter(url):
        first = last - len(term) + 1
        if (first == 0 or url[first - 1] not in _WORD) and (last + 1 == len(url) or url[last + 1] not in _WORD):
            (soft if weight == 1 else strict).add(term)
    return len(strict), len(soft)


def mark(pages: DataFrame, url: str = "url", strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT,
         soft_hits: int = SOFT_HITS) -> DataFrame:
    """Add ``n_strict``, ``n_soft`` (distinct terms) and ``rejected`` by the vocabulary."""
    names = pages.columns
    added = T.StructType().add("n_strict", T.IntegerType()).add("n_soft", T.IntegerType()).add("rejected", T.BooleanType())
    clash = set(added.names) & set(names)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist")
    fold = str.maketrans(_UPPER, _LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for batch in batches:
            hits = [_hits(a, u.translate(fold)) if u else (0, 0) for u in batch.column(names.index(url)).to_pylist()]
            n_strict, n_soft = [h[0] for h in hits], [h[1] for h in hits]
            rejected = [s > 0 or t >= soft_hits for s, t in hits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_strict, pa.int32()), pa.array(n_soft, pa.int32()),
                                              pa.array(rejected, pa.bool_())], names=[*names, *added.names])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, *added.fields]))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, strict: tuple[str, ...] = STRICT,
          soft: tuple[str, ...] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """Per page: page_id, host, path, the deciding rule, the verdict, and the vocabulary's counts."""
    marked = mark(pages.select("page_id", "url"), strict=strict, soft=soft, soft_hits=soft_hits)
    parts = marked.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    ruled = parts.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    words = F.when(F.col("rejected"), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("by.rule").alias("rule"),
                        F.coalesce("by.verdict", words).alias("verdict"), "n_strict", "n_soft")
