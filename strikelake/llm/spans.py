"""Positions of regular-expression matches as native Spark expressions, in code points."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "body:string,before:string,after:string"
SPAN = f"array<struct<start:int,end:int,{FIELDS}>>"
CONTEXT = 40  # code points before and after a match that are kept with it
BLOCK = 256  # results gathered in one array before they join the others, so that arrays aren't copied for each


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(n: Column, state: Column, of: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """One pass over 0 to n - 1, n above 0, that carries a state: a struct of the last ``state`` and ``out``, an array
    of type ``of``. ``step(state, i)`` gives the next state, whether there is a result, and the result."""
    none = F.expr(f"cast(array() as array<{of}>)")

    def block(acc: Column, first: Column) -> Column:
        def one(own: Column, i: Column) -> Column:
            after, passes, item = step(own["state"], i)
            grown = F.when(passes, F.concat(own["out"], F.array(item))).otherwise(own["out"])
            return F.struct(after.alias("state"), grown.alias("out"))

        return F.aggregate(
            F.sequence(first, F.least(first + BLOCK, n) - 1), F.struct(acc["state"].alias("state"), none.alias("out")), one,
            lambda own: F.struct(own["state"].alias("state"), F.concat(acc["parts"], F.array(own["out"])).alias("parts")))

    zero = F.struct(state.alias("state"), F.array(none).alias("parts"))
    return F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), zero, block,
                       lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["parts"]).alias("out")))


def with_matches(df: DataFrame, text: str, name: str, pattern: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``name``: the leftmost non-overlapping matches of ``pattern`` (never empty ones) that ``keep``
    holds for, as spans with the text just before and after them.

    ``split`` gives what lies between the matches, ``regexp_extract_all`` the matches; positions are the running
    sum of their lengths. A text without a match is only scanned once.
    """
    body, gap = f"_body_{uuid.uuid4().hex}", f"_gap_{uuid.uuid4().hex}"
    found = df.withColumn(body, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    found = found.withColumn(gap, F.when(F.size(body) > 0, F.split(text, pattern, -1)))

    def step(at: Column, i: Column) -> tuple[Column, Column, Column]:
        match, before = F.get(body, i), F.get(gap, i)
        start = at + F.length(before)
        end = start + F.length(match)
        span = F.struct(start.alias("start"), end.alias("end"), match.alias("body"), F.right(before, F.lit(CONTEXT)).alias("before"),
                        F.left(F.get(gap, i + 1), F.lit(CONTEXT)).alias("after"))
        return end, keep(match) if keep else F.lit(True), span

    spans = folded(F.size(body), F.lit(0), SPAN[6:-1], step)["out"]
    return (found.withColumn(name, F.when(F.size(body) > 0, spans).otherwise(F.expr(f"cast(array() as {SPAN})")))
            .drop(body, gap))


def labels(spans: Column, kind: str) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def unbeaten(spans: Column, kinds: int, of: str, beats: Callable[[Column, Column], Column]) -> Column:
    """The spans that no overlapping span beats, also if that one is beaten itself.

    Spans are structs of type ``of`` that begin with ``start``, ``end`` and ``g``, their kind, 0 to ``kinds`` - 1; those
    of one kind don't overlap, and none is empty. So of each kind only the last span that began before can overlap the
    next one, and a single pass in the order of starts meets every overlapping pair.
    """
    def meets(x: Column, s: Column) -> Column:
        return x["span"]["end"] > s["start"]

    def sweep(ordered: Column) -> Column:
        def step(last: Column, i: Column) -> tuple[Column, Column, Column]:
            s = F.get(ordered, i)
            lost = F.exists(last, lambda x: F.coalesce(meets(x, s) & beats(x["span"], s), F.lit(False)))
            after = F.transform(last, lambda x, k: F.when(k == s["g"], F.struct(s.alias("span"), lost.alias("lost"))).otherwise(
                F.struct(x["span"].alias("span"), (x["lost"] | F.coalesce(meets(x, s) & beats(s, x["span"]), F.lit(False))).alias("lost"))))
            gone = F.get(last, s["g"])
            return after, ~gone["lost"], gone["span"]

        nothing = F.struct(F.lit(None).cast(of).alias("span"), F.lit(True).alias("lost"))
        swept = folded(F.size(ordered), F.array_repeat(nothing, kinds), of, step)
        return bound(swept, lambda w: F.concat(w["out"], F.transform(F.filter(w["state"], lambda x: ~x["lost"]), lambda x: x["span"])))

    return F.when(F.size(spans) > 1, bound(F.array_sort(spans), sweep)).otherwise(spans)


def apart(spans: Column, *others: Column) -> Column:
    """The spans of one pattern, in their order, that overlap none of the spans of other patterns."""
    def marked(column: Column, g: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(g).alias("g"),
                                                      *(s[c].alias(c) for c in ("body", "before", "after"))))

    every = F.concat(*(marked(c, g) for g, c in enumerate((spans, *others))))
    left = bound(every, lambda a: unbeaten(a, len(others) + 1, f"struct<start:int,end:int,g:int,{FIELDS}>",
                                           lambda x, s: (x["g"] > 0) & (s["g"] == 0)))
    own = F.transform(F.filter(left, lambda s: s["g"] == 0), lambda s: F.struct(*(s[c].alias(c) for c in ("start", "end", "body", "before", "after"))))
    met = sum((F.size(o) for o in others), F.lit(0)) > 0
    return F.when((F.size(spans) > 0) & met, own).otherwise(spans)


def redacted(text: str, spans: Column) -> Column:
    """The text with every span ``(start, end, kind)`` replaced by its kind in brackets; where spans overlap,
    the later one covers only what the earlier one leaves.

    Positions in a string are found by walking, so the text between blocks of spans is cut out first.
    """
    whole = F.col(text)

    def cut(ordered: Column) -> Column:
        def step(state: Column, i: Column) -> tuple[Column, Column, Column]:
            s, at = F.get(ordered, i), state["at"]
            fresh = i % BLOCK == 0
            reach = F.coalesce(F.get(ordered, i + BLOCK)["start"], F.length(whole))
            base = F.when(fresh, at).otherwise(state["base"])
            part = F.when(fresh, F.substring(whole, at + 1, reach - at)).otherwise(state["part"])
            kept = F.substring(part, at - base + 1, F.greatest(at, s["start"]) - at)
            after = F.struct(F.greatest(at, s["end"]).alias("at"), base.alias("base"), part.alias("part"))
            return after, s["end"] > at, F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("base"), F.lit("").alias("part"))
        done = folded(F.size(ordered), zero, "string", step)
        return bound(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(whole, d["state"]["at"] + 1, F.length(whole))))

    return F.when(F.size(spans) > 0, bound(F.array_sort(spans), cut)).otherwise(whole)
