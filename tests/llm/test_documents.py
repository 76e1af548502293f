"""Operators on documents against plain versions: odd rows, ties, repeats, hot groups."""

import math
import os
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strikelake.llm import bwt_dedup, parity_join, phrase_index, pii, quality, secrets, spans
from strikelake.llm import text as tx
from strikelake.llm.components import components
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and characters of every width."""
    rng = random.Random(5)
    base, line = words(rng, 120), "all rights reserved by the owners of this common line and nobody else"
    near = base.split()
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One two"), (6, base), (7, base), (8, base.upper()),
            (9, " ".join(near[:60] + ["x"] + near[60:])), (10, " ".join(near[:100])), (11, words(rng, 30_000, 5000)),
            (12, "a" * 9000), (13, "ä€😀 " * 60), (6, base), (None, base), (None, None),
            (14, base + "\n" + line), (15, "same line here\n" * 12), (16, "AKIA" + "Q" * 16 + " token = abcdef mail a.b@c.de 1.2.3.4")]
    rows += [(100 + i, f"{words(rng, 60, 10_000)}\n{line}\n{words(rng, 60, 10_000)}") for i in range(60)]
    rows += [(200 + i, " ".join(near[:i] + near[i + 1:])) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The odd rows with columns whose names the operators use inside."""
    path = str(tmp_path_factory.mktemp("odd"))
    shape = "doc_id long, text string, kept boolean, node string, n string, source string, bucket int"
    spark.createDataFrame([(d, t, True, "x", "y", "src", 1) for d, t in odd_rows()], shape).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_quality(odd):
    got = tuples(quality.quality_report(odd).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    assert got == sorted(((d, *brute.quality(t)) for d, t in odd_rows()), key=str)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, t in odd_rows() if brute.quality(t)[-1])


def test_rules_of_one_order_or_another_agree(odd):
    one = tuples(quality.cascade(odd.select("doc_id", "text"), quality.RULES).select("doc_id", "kept"))
    other = tuples(quality.cascade(odd.select("doc_id", "text"), quality.RULES[::-1]).select("doc_id", "kept"))
    assert one == other


def test_cheap_and_selective_rules_come_first(odd):
    ordered = quality.order_rules(odd)
    assert set(ordered) == set(quality.RULES)
    assert ordered.index(next(r for r in ordered if r.name == "few_words")) < ordered.index(next(r for r in ordered if r.name == "dup_lines"))


@pytest.mark.parametrize("group,often", [(16, 8), (2, 10**6), (2, 3)])
def test_classes(odd, group, often):
    """Also with groups so small that rounds for common blocks are needed (nothing known beforehand, then something)."""
    assert tuples(parity_join.classes(odd, group, often)) == brute.classes(odd_rows())


def test_one_per_class(odd):
    left = parity_join.one_per_class(odd)
    assert left.columns == odd.columns
    want = {d for d, _, c in brute.classes(odd_rows()) if d is None or d == c}
    got = [r.doc_id for r in left.collect()]
    assert set(got) == want and got.count(6) == 1


def test_sketches_bound_the_difference():
    rng = random.Random(3)
    for _ in range(200):
        a = {rng.getrandbits(64) for _ in range(rng.randrange(1, 400))}
        b = {x for x in a if rng.random() < 0.9} | {rng.getrandbits(64) for _ in range(rng.randrange(1, 40))}
        s, t = (parity_join.np.array(sorted(x), parity_join.np.uint64) for x in (a, b))
        assert parity_join.sketch_distance(parity_join.sketch(s), parity_join.sketch(t)) <= len(a ^ b)


def test_leaks(spark, odd):
    docs = odd_rows()
    items = [(1, docs[5][1]), (2, "one two"), (3, None), (4, ""), (5, "!!"), (6, "ä€😀 ä€😀"), (7, docs[5][1]), (8, "rights RESERVED by the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.n_words): tuple(r)[1:] for r in phrase_index.digest(phrase_index.decontaminate(odd, bench)).collect()}
    for d, t in docs:
        want = brute.leaks([(d, t)], items)[d]
        assert got[d, want[0]] == want
    kept = phrase_index.remove_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in docs if not brute.leaks([(d, t)], items)[d][-1])


def test_leaks_in_several_blocks_of_items(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(odd_rows()[5][1].split()[3 * i:3 * i + 15])) for i in range(30)], "item_id long, text string")
    one = tuples(phrase_index.digest(phrase_index.decontaminate(odd.where("doc_id < 20 AND doc_id <> 6"), bench)))
    monkeypatch.setattr(phrase_index, "BLOCK_BYTES", 800)
    assert tuples(phrase_index.digest(phrase_index.decontaminate(odd.where("doc_id < 20 AND doc_id <> 6"), bench))) == one


def test_every_row_in_several_blocks_of_items(spark, odd, monkeypatch):
    """Repeated rows, null ids, different texts of one id with as many words, and a repeated item."""
    text = odd_rows()[5][1]
    items = [(i, " ".join(text.split()[3 * i:3 * i + 15])) for i in range(30)]
    items += [items[4], (None, "one two"), (31, text), (32, text), (33, None), (34, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = [(5, "two one"), (7, " ".join(text.split()[:119] + ["other"])), (None, text[::-1])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = [brute.leaks([row], items)[row[0]] for row in [*odd_rows(), *more]]

    def found():
        whole = phrase_index.decontaminate(docs, bench)
        return tuples(phrase_index.digest(whole)), sorted(str((r.doc_id, r.n_words, sorted(map(str, r.near_items)), r.hits)) for r in whole.collect())

    one = found()
    monkeypatch.setattr(phrase_index, "BLOCK_BYTES", 800)
    assert found() == one
    # The plain version has the null id by the name "None"; the digests leave it out.
    assert sorted((r[1:4], r[5]) for r in one[0]) == sorted((w[:3], w[4]) for w in want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 200 + "beta gamma"), (3, "alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "gamma beta alpha")], "item_id long, text string")
    assert {r.doc_id: list(r.near_items) for r in phrase_index.decontaminate(docs, bench).collect()} == {1: [1], 2: [], 3: []}


SECRETS = ["", None, "password: hunter22 PASSWD=abc", "secret=token = 'abcdefgh'", "api_key=\"x.y-z_12\"", "AKIAAKIA" + "Z" * 14, "AKIA" + "9" * 15,
           "é😀 " + "ab12" * 6 + "g " + "0" * 24, "token==abcdef", "f" * 30_000, "token=short token = longer1"]


def test_secrets(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SECRETS)] + [(3, SECRETS[3], 1)], "doc_id long, text string, assign int")
    got = [tuple(r)[:5] for r in secrets.digest(secrets.scan(docs)).collect()]
    assert sorted(got) == sorted((i, *brute.secrets(t)) for i, t in [*enumerate(SECRETS), (3, SECRETS[3])])


def test_random_strings_are_told_from_words(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_ = ["".join(rng.choice(alphabet) for _ in range(60)) + "a1" for _ in range(150)]
    words_ = ["".join(rng.choice(("station", "under", "rail", "go")) for _ in range(14))[:60] + "x1" for _ in range(150)]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate(random_ + words_)], "doc_id long, text string")
    flagged = {r.doc_id for r in secrets.scan(docs).where("size(random) > 0").collect()}
    assert len([i for i in flagged if i < 150]) >= 120
    assert not [i for i in flagged if i >= 150]


def _plain_p(body):
    """Encoding and p-values of uniformity, runs, serial correlation and of the three together, with the exact erfc."""
    kind = next((k for k, p in (("hex", "[0-9a-f]+|[0-9A-F]+"), ("base32", "[A-Z2-7]+=*"), ("alnum", "[A-Za-z0-9]+")) if re.fullmatch(p, body)), "base64")
    text = body.replace("=", "").replace("-", "+").replace("_", "/")
    alphabet = secrets.ALPHABETS[kind]
    codes = [alphabet.index(c) for c in (text.lower() if kind == "hex" else text)]
    n, k = len(codes), len(alphabet)
    m = max(2, min(k, n // 5))
    chi = sum((sum(c * m // k == j for c in codes) - n / m) ** 2 * m / n for j in range(m))
    free = m - 1
    z = ((chi / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free))
    half = [2 * c >= k for c in codes]
    up, low = sum(half), n - sum(half)
    runs, mean = 1 + sum(a != b for a, b in zip(half, half[1:])), 2 * up * low / n + 1
    spread = 2 * up * low * (2 * up * low - n) / (n * n * (n - 1))
    mid = sum(codes) / n
    rho = sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:])) / sum((c - mid) ** 2 for c in codes)
    ps = [math.erfc(z / math.sqrt(2)) / 2, math.erfc(abs(runs - mean) / math.sqrt(2 * spread)), math.erfc(abs(rho * n + 1) / math.sqrt(2 * n))]
    h = -sum(math.log(p) for p in ps)
    return kind, *ps, math.exp(-h) * (1 + h + h * h / 2)


def test_p_values_of_the_battery(spark):
    rng = random.Random(12)
    bodies = ["".join(rng.choice(a + extra) for _ in range(n)) for a in secrets.ALPHABETS.values()
              for extra in ("", a[:4] * 4) for n in (20, 33, 64, 150, 400)] + ["ab12" * 8 + "c", "A2B3C4D5" * 3 + "QQ==", "x-_Y/9z" * 6]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    for r in secrets.battery(df).select("body", "encoding", "p_chi", "p_runs", "p_serial", "p").collect():
        kind, *want = _plain_p(r.body)
        assert r.encoding == kind and list(r)[2:] == pytest.approx(want, rel=1e-2, abs=1e-5)


def test_lone_candidates_are_judged_with_their_neighbours(spark):
    """One candidate in a length class of its encoding, beside many random ones of another class."""
    rows = [("base64-3", (i + 0.5) / 400) for i in range(400)] + [("base64-5", 0.3), ("base32-0", 0.8), ("alnum-2", 1e-9)]
    cut = {r.stratum: r.cut for r in secrets.cuts(spark.createDataFrame(rows, "stratum string, p double")).collect()}
    assert cut["base64-3"] <= 0.05 and cut["base64-5"] <= 0.3 and cut["base32-0"] <= 0.8
    structured = spark.createDataFrame([("hex-1", 1e-9)] * 300 + [("hex-2", 0.01)], "stratum string, p double")
    assert secrets.cuts(structured).collect() == []


def test_strata_with_enough_candidates_stand_alone():
    np = secrets.np
    full, thin = np.full(secrets.BINS, 2), np.zeros(secrets.BINS, np.int64)
    thin[40] = 1
    hist = {("hex", 0): full, ("alnum", 1): thin, ("alnum", 4): full, ("alnum", 5): full, ("base32", 2): thin}
    assert (secrets.neighbourhood(hist, "hex", 0) == full).all()
    assert (secrets.neighbourhood(hist, "alnum", 1) == thin + full).all()
    assert (secrets.neighbourhood(hist, "base32", 2) == 3 * full + 2 * thin).all()


PERSONAL = ["", None, "a@b.c_x@d.e, @x.y a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 12.34.56", "4111 1111 1111 1111 and 4111-1111-1111-1112",
            "+1 (234) 555-0199 +12 +1234567 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "9" * 20_000, "x" * 50_000, "é😀 mail äb@c.de", "1-" * 5000 + "1", "+ 1234567890"]


def test_personal_data(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PERSONAL)] + [(2, PERSONAL[2], 1)], "doc_id long, text string, email int")
    got = [tuple(r)[:6] for r in pii.digest(pii.scan(docs)).collect()]
    assert sorted(got) == sorted((i, *brute.personal(t)) for i, t in [*enumerate(PERSONAL), (2, PERSONAL[2])])


def test_proposals_and_redaction(spark):
    text = ["write to jane.roe (at) mail (dot) org or a@b.com", "order 123-45-6789 total 12.345.000", "SSN 123-45-6789 é", None, "call me at (212) 555-0187 now"]
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in enumerate(text)], "doc_id long, text string, email string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert out[0].text == "write to [WRITTEN_EMAIL] or [EMAIL]" and out[0].email == "s" and out[0].n_chars == 5
    assert out[1].text == text[1] and out[3].text is None
    assert out[2].text == "SSN [ID_NUMBER] é" and out[4].text == "call me at [LOCAL_PHONE] now"


def _disjoint(rng, n, g):
    """Spans of one kind that don't overlap, some of them touching."""
    out, at = [], 0
    for _ in range(n):
        start = at + rng.choice((0, 1, 3, 9))
        at = start + rng.choice((1, 2, 5, 30))
        out.append((start, at, g, rng.choice((0.5, 0.75, 0.9))))
    return out


def test_swept_spans_equal_those_of_all_pairs(spark):
    """Chains, containment and ties; more spans than a block holds."""
    rng = random.Random(3)
    rows = [[_disjoint(rng, rng.choice((0, 1, 5, 40)), g) for g in range(4)] for _ in range(60)]
    rows += [[_disjoint(rng, 700, g) for g in range(4)], [[], [], [], []]]
    of = "array<struct<start:int,end:int,g:int,p:double>>"
    df = spark.createDataFrame([(i, sum(r, [])) for i, r in enumerate(rows)], f"id int, s {of}")
    got = df.select("id", spans.unbeaten(F.col("s"), 4, pii.PROPOSAL, pii._likelier).alias("s")).collect()

    def likelier(o, s):
        return (-o[3], o[0], o[2]) < (-s[3], s[0], s[2])

    for r in got:
        every = sum(rows[r.id], [])
        want = [s for s in every if not any(s[0] < o[1] and o[0] < s[1] and likelier(o, s) for o in every)]
        assert sorted(map(tuple, r.s)) == sorted(want)


def test_spans_apart_equal_those_of_all_pairs(spark):
    rng = random.Random(4)
    rows = [[_disjoint(rng, rng.choice((0, 1, 7, 300)), g) for g in range(3)] for _ in range(40)]
    full = [(i, *([(s[0], s[1], f"b{s[0]}", "x", "y") for s in part] for part in r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, f"id int, a {spans.SPAN}, b {spans.SPAN}, c {spans.SPAN}")
    for r in df.select("id", spans.apart(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect():
        a, b, c = rows[r.id]
        want = [(s[0], s[1], f"b{s[0]}", "x", "y") for s in a if not any(s[0] < o[1] and o[0] < s[1] for o in b + c)]
        assert [tuple(s) for s in r.s] == want


def test_redaction_of_many_and_overlapping_spans(spark):
    rng = random.Random(6)
    text = "".join(rng.choice("abé😀 \n") for _ in range(9000))
    own = [(s, e, f"k{g}") for g in range(2) for s, e, _, _ in _disjoint(rng, 600, g) if e <= len(text)]
    df = spark.createDataFrame([(text, own), (text, []), ("", [])], "text string, s array<struct<start:int,end:int,kind:string>>")
    out, at = "", 0
    for start, end, kind in sorted(own):
        if end > at:
            out, at = out + text[at:max(at, start)] + f"[{kind.upper()}]", end
    assert [r[0] for r in df.select(spans.redacted("text", F.col("s"))).collect()] == [out + text[at:], text, ""]


def test_a_text_of_twenty_thousand_numbers(spark):
    text = "\n".join(f"call +1 (212) 555-{i:05d} or (212) 555-{i % 9000 + 1000} x" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    started = time.time()
    found = pii.digest(pii.scan(docs)).first()
    clean = pii.redact(docs).first().text
    assert time.time() - started < 90
    assert tuple(found)[:6] == (1, *brute.personal(text))
    assert clean.count("[PHONE]") == found.n_phone == 10_000 and clean.count("\n") == 9_999


def test_boosted_trees_on_held_out_examples(spark):
    rows = pii.labelled_examples(spark, 2000, seed=99)
    trees, a, b, cut = pii._model(spark, pii.TRAIN, pii.SEED)
    said = [(pii._sigmoid(a * sum(pii.value(t, x) for t in trees) + b) >= cut[x[-1]], y) for x, y in rows]
    hits = [y for s, y in said if s]
    assert sum(hits) >= 0.97 * len(hits) and sum(hits) >= 0.7 * sum(y for _, y in said)


@pytest.mark.parametrize("many,shard", [(256, 400_000), (3, 2000)])
def test_repeated_strings(odd, many, shard):
    """Also with frequent names split and several shards to merge."""
    assert tuples(bwt_dedup.report(odd, many, shard)) == brute.repeats(odd_rows())


def test_merged_transforms_find_repeated_windows():
    rng = random.Random(1)
    for shard in (200, 400_000):
        for _ in range(40):
            base = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 90))) for _ in range(3)]
            texts = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) + rng.choice(base)[rng.randint(0, 20):]) for _ in range(8)]
            texts = [t for t in texts if len(t) >= 50] or [b"a" * 60]
            ids = [rng.randint(0, 4) for _ in texts]
            first = {}
            for t, d in zip(texts, ids):
                for i in range(len(t) - 49):
                    first[t[i:i + 50]] = min(d, first.get(t[i:i + 50], d))
            want = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 49) if first[t[i:i + 50]] < ids[k]]
            np = bwt_dedup.np
            text, window = bwt_dedup.repeated_windows(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), np.array(ids), shard)
            assert list(zip(text.tolist(), window.tolist())) == want


def test_rows_sent_to_buckets_stay_few(monkeypatch):
    """A task sends a bucket one row of a kind, however many batches, rows and sets of names it reads."""
    import pyarrow as pa

    rng, np = random.Random(2), bwt_dedup.np
    shared = [words(rng, 40) for _ in range(60)]
    docs = [(k, f"{words(rng, 10, 10**6)} {shared[k % 60]} {words(rng, 10, 10**6)}") for k in range(240)] + [(500, None), (None, "x")]
    batches = [pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([t], pa.string())], names=["doc_id", "text"]) for d, t in docs]

    def sent(rows):
        return pa.Table.from_batches(sorted(rows, key=lambda b: (b["bucket"][0].as_py(), b["kind"][0].as_py()))).to_batches()

    def one_by_one(rows):
        return [b.slice(i, 1) for b in rows for i in range(b.num_rows)]

    texts = one_by_one(bwt_dedup._emit_texts(16)(iter(batches)))
    assert len(texts) <= 16
    found = [r for _, kinds in bwt_dedup._by_bucket(sent(texts)) for r in bwt_dedup._texts(kinds[bwt_dedup.TEXTS])]
    back = [(int(i) if k else None, c.raw(j).decode()) for c, ids, known, _ in found for j, (i, k) in enumerate(zip(ids, known))]
    assert sorted(back, key=str) == sorted(((d, t or "") for d, t in docs), key=str)

    names = one_by_one(bwt_dedup._emit_names(1)(iter(batches)))
    met = one_by_one(bwt_dedup._meet_names(1, 256)(sent(names)))
    whole = one_by_one(bwt_dedup._emit_texts(1)(iter(batches)))
    segments = one_by_one(bwt_dedup._emit_segments(1, np.zeros(0, np.uint64))(sent(met + whole)))
    monkeypatch.setattr(bwt_dedup, "TOGETHER", 2000)
    lost = one_by_one(bwt_dedup._meet_segments(1, 400_000)(sent(segments)))
    assert len(met) == len(lost) == 1
    monkeypatch.undo()
    gone = pa.concat_tables([pa.Table.from_batches([b]) for b in bwt_dedup._remove(False)(sent(lost + whole))])
    assert sorted((tuple(r.values()) for r in gone.to_pylist()), key=str) == brute.repeats(docs)


def test_buckets_grow_before_they_become_many():
    assert [bwt_dedup._buckets(n) for n in (0, 10**8, 864 * 10**6)] == [16, 16, 108]
    assert bwt_dedup._buckets(2 * 10**9) == 128 and bwt_dedup._buckets(10**10) ** 2 < 200_000
    assert all(n / bwt_dedup._buckets(n) < 25_000_000 for n in range(10**9, 6 * 10**10, 10**9))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (quality.quality_report(docs), quality.keep_good(docs), parity_join.classes(docs), parity_join.one_per_class(docs),
               phrase_index.decontaminate(docs, bench), phrase_index.remove_contaminated(docs, bench), secrets.scan(docs),
               pii.scan(docs.select("doc_id", "text")), pii.redact(docs), bwt_dedup.report(docs)):
        assert df.collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert phrase_index.decontaminate(one, bench).first().n_hit == 0


def test_chunks_cut_batches_between_texts():
    import pyarrow as pa

    texts = ["a" * 10, None, "", "b" * 50, "é" * 7]
    for limit in (1, 15, 10**6):
        found = [c.raw(i).decode() for c in tx.chunks(pa.array(["skip", *texts]).slice(1), limit=limit) for i in range(c.hi - c.lo)]
        assert found == [t or "" for t in texts]


@pytest.mark.skipif(not os.path.exists(f"{SMALL}/documents.parquet"), reason="needs the test tables")
def test_pipeline_stages(spark):
    """Every stage against the plain version of its decision, on its own input."""
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), "test-stage")
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if name == "quality":
            assert sorted(ids) == sorted(r.doc_id for r in before if brute.quality(r.text)[-1])
        elif name == "near_copies":
            assert sorted(ids) == sorted(d for d, _, c in brute.classes([(r.doc_id, r.text) for r in before]) if d == c)
        elif name == "decontamination":
            bad = brute.leaks([(r.doc_id, r.text) for r in before], items)
            assert sorted(ids) == sorted(d for d in (r.doc_id for r in before) if not bad[d][-1])
        elif name == "personal_data":
            assert sorted(ids) == sorted(r.doc_id for r in before)
            assert not any(sum(brute.personal(r.text)[:4]) for r in after)
            clean = {r.doc_id: r.text for r in before if not sum(brute.personal(r.text)[:4])}
            assert all(r.text == clean[r.doc_id] for r in after if r.doc_id in clean)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            before = after
    from strikelake.llm import lattice

    assert {r.doc_id: r.text for r in lattice.decode(docs).collect()} == {r.doc_id: r.text or "" for r in before}


def test_components_of_a_random_graph(spark):
    """A long path, a star, self-loops, repeated and turned edges, against a plain union of sets."""
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 60)] + [(5, 5), (300, 301), (301, 300), (300, 301)]
    edges += [(rng.randrange(400, 480), rng.randrange(400, 480)) for _ in range(50)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark, spark.createDataFrame(edges, "a long, b long"))
    assert tuples(got) == sorted(want.items(), key=str)
    assert components(spark, spark.createDataFrame([], "a long, b long")).collect() == []


def test_clashing_names_of_the_cascade(odd):
    with pytest.raises(ValueError):
        quality.cascade(odd)
    marked = quality.cascade(odd, prefix="_")
    assert marked.columns == [*odd.columns, "_kept", "_rejected_by"] and marked.count() == odd.count()
