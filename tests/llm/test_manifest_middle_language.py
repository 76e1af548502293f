"""Merkle manifest, fill-in-the-middle samples and language identification against plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from strikelake.llm import merkle, middle, oracle, string_kernels
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.01"
SHAPE = "doc_id long, source string, lang string, n_chars long, text string, place long, tree string, digest int, path string, form string, output int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, languages of one row and of many."""
    rng = random.Random(8)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "de", "fr", "é", "", "Z"]), i, f"text {i}  of\tmany\nwords {i * i} ") for i in range(60)]
    rows += [(None, "s", "en", 3, "a"), (None, None, None, None, None), (61, None, None, 5, ""), (62, "é😀", None, None, " \n "),
             (7, "other", "en", 7, "same id"), (7, "other", "en", 7, "same id"), (63, "s", "only", 1, "x" * 300_000 + " ä😀"),
             (64, "s", "en", 1, "has <P> inside"), (65, "s", "en", 2, "word"), (-5, "s", "de", 2**63 - 1, "ä ö ü 😀 <"), (66, "s", "en", 3, "< S> <M <P <S P>")]
    return rows + [(1000 + i, "s", f"lang{i:02d}", i, "t") for i in range(11)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "t", 2, "p", "f", 3) for r in rows], SHAPE).repartition(parts)


# --- manifest ------------------------------------------------------------------------------------

def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join(map(part, (doc_id, source, lang, n_chars, text))))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return levels


def climb(levels, i, x):
    siblings = []
    for level in levels[:-1]:
        run = level[i & ~1:(i | 1) + 1]
        siblings += [d for k, d in enumerate(run) if k != i & 1]
        run[i & 1] = x
        x, i = sha("".join(run)), i >> 1
    return siblings, x


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for g in order}
    levels = {g: tree([leaf_of(*r) for r in trees[g]]) for g in order}
    top = tree([levels[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for i, r in enumerate(trees[g]):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            claimed = leaf_of(*r[:3], r[3] + 1, r[4]) if hit else leaf_of(*r)
            siblings, x = climb(levels[g], i, claimed)
            more, folded = climb(top, k, x)
            out.append((r[0], leaf_of(*r), levels[g][-1][0], root, sha("".join(siblings + more)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("rounds,parts", [(2, 7), (1, 1), (merkle.BLOCK_LEVELS, 3)])
def test_manifest(spark, rounds, parts):
    """Also with superblocks so small that languages and the tree over them have several levels of them."""
    rows = odd_rows()
    got = merkle.manifest(frame(spark, rows, parts), merkle.tampered_chars(), rounds)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)


def test_proofs_fold_to_the_root(spark):
    rows = odd_rows()
    found = merkle.manifest(frame(spark, rows), rounds=3, proofs=True).collect()
    assert all(r.verified and merkle.fold(r.leaf, r.proof) == r.root for r in found)
    assert len({r.root for r in found}) == 1
    other = next(r for r in found if r.doc_id == 10)
    assert merkle.fold(sha("other"), other.proof) != other.root


def test_order_and_dealing_do_not_matter_but_values_do(spark):
    rows = odd_rows()

    def root(some):
        return {r.root for r in merkle.manifest(frame(spark, some, 2), rounds=4).collect()}
    assert root(rows) == root(rows[::-1])
    changed = [(*r[:4], r[4] + "!") if r[0] == 20 else r for r in rows]
    assert root(changed) != root(rows)
    # A null and a text that looks like it are different leaves.
    assert root([(1, None, "en", 1, "x")]) != root([(1, "-", "en", 1, "x")])


def test_one_row_and_one_hot_id(spark):
    one = [(5, "s", "en", 1, "x")]
    assert [tuple(r) for r in merkle.manifest(frame(spark, one), merkle.tampered_chars()).collect()] == plain_manifest(one)
    hot = [(9, "s", "en", 1, "x")] * 50 + [(9, "s", "en", 1, f"y{i}") for i in range(30)]
    got = merkle.manifest(frame(spark, hot), merkle.tampered_chars(), 2).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(hot)


# --- fill in the middle --------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def middle_rows():
    rows = odd_rows()
    rng = random.Random(4)
    rows += [(2000 + i, None, None, None, "".join(rng.choice(["a", "é", "😀", " ", "\n", "<", "S", ">", "\x0b", " "]) for _ in range(rng.randrange(40))))
             for i in range(300)]
    return rows + [(3000 + i, None, None, None, "w " * 60_000 + "é") for i in range(4)]


def test_middle(spark):
    rows = middle_rows()
    got = sorted((tuple(r) for r in middle.digest(frame(spark, rows)).collect()), key=str)
    want = sorted((plain_middle(r[0], r[4]) for r in rows), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_are_real_and_give_the_texts_back(spark):
    rows = middle_rows()
    samples = middle.transform(frame(spark, rows), seed=7, rate=100, spm_share=50, sentinels=("<|pre|>", "<|mid|>", "<|suf|>"))
    texts = {(r[0], sha(r[4] or "")) for r in rows}
    back = middle.restore(samples, ("<|pre|>", "<|mid|>", "<|suf|>")).collect()
    assert {(r.doc_id, sha(r.restored)) for r in back} == texts == {(r.doc_id, r.restored_sha256) for r in back}
    assert all(sha(r.output) == r.output_sha256 for r in back)
    assert all(r.output.startswith("<|suf|>" if r.form == "spm" else "<|pre|>") for r in back if r.form != "plain")
    hashed = middle.transform(frame(spark, rows), keep_output=False)
    assert all(r.output is None and r.output_sha256 for r in hashed.collect())


def test_pieces_are_cut_permuted_and_put_back():
    table = middle.PieceTable.whole((memoryview(b"abcdef"), memoryview(b"<>")), np.array([0, 3]), np.array([3, 6]))
    cut = table.cut(np.array([1, 3])).cut(np.array([3, 5]))
    assert [[bytes(x) for x in cut.stream(i)] for i in (0, 1)] == [[b"a", b"bc", b""], [b"", b"de", b"f"]]
    order = (2, 0, 1)
    assert cut.permute(order).permute(middle.inverse(order)).bytes(0) == b"abc"
    assert cut.permute(order).marked(np.array([[0, 1], [1, 2], [0, 1]])).bytes(1) == b"<f><de"


@pytest.mark.parametrize("name,run", [("op11_merkle_manifest", lambda d: merkle.manifest(d, merkle.tampered_chars())), ("op12_fill_in_middle", middle.digest)])
def test_same_rows_as_sql_with_odd_rows(spark, tmp_path, name, run):
    path = str(tmp_path / "documents.parquet")
    rows = [r for r in middle_rows() if r[3] != 2**63 - 1]  # SQL has no sum beyond the largest number
    frame(spark, rows, 1).select("doc_id", "source", "lang", "n_chars", "text").toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}).to_parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert difference(run(spark.read.parquet(path)), con, oracle.ORACLES[name]) == ""


# --- languages -----------------------------------------------------------------------------------

def plain_runs(text):
    letters, out = [], set()
    for c in text:
        low = c.lower() if c.isalpha() else " "
        letters.append(low if len(low) == 1 else c)
    folded = " " + re.sub(" +", " ", "".join(letters)).strip(" ") + " "
    if folded.strip(" "):
        for n in (1, 2, 3):
            out |= {folded[i:i + n] for i in range(len(folded) - n + 1)}
    return out


TEXTS = ["", "a", "Straße, İstanbul!", "çà et là", "中文 text 😀 ok", "a" * 50, "12 34", "don't", "x́y"]


def unpacked(run):
    run, out = int(run), ""
    while run:
        out, run = chr(run & (1 << 21) - 1) + out, run >> 21
    return out


@pytest.mark.parametrize("piece", [1, 3, 10**6])
def test_runs(monkeypatch, piece):
    """Also read in small pieces."""
    monkeypatch.setattr(string_kernels, "PIECE", piece)
    for text in TEXTS:
        assert {unpacked(r) for r in string_kernels.runs(text)} == plain_runs(text), text


def test_kernel_equals_the_definition():
    texts = [t for t in TEXTS if plain_runs(t)]
    sets = [plain_runs(t) for t in texts]
    kernel = string_kernels.Kernel.of([string_kernels.runs(t) for t in texts[:4]])
    got = kernel.against([string_kernels.runs(t) for t in [*texts, ""]])
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets[:4]] for a in sets] + [[0.0] * 4]
    assert np.allclose(got, want)


def test_languages_of_odd_rows(spark):
    rng = random.Random(2)
    sounds = {"one": "bcd", "two": "xyz", "three": "кмн"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(sounds))
        rows.append((i, "s", lang if i % 9 else None, 1, " ".join("".join(rng.choice(sounds[lang]) for _ in range(4)) for _ in range(20))))
    odd = [(500, "s", "one", 1, None), (501, "s", "one", 1, ""), (502, "s", "one", 1, "12 !? \n"), (None, "s", "two", 1, "xyzz yxz"),
           (503, None, None, None, "BCDB " * 50_000), (504, "s", "two", 1, "xyzz yxz"), (504, "s", "two", 1, "xyzz yxz"), (505, "s", "two", 1, "☃ 😀")]
    out = string_kernels.identify(frame(spark, rows + odd)).collect()
    said = {}
    for r in out:
        said.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out))
        assert 0 <= r.score <= 1
    assert len(out) == len(rows) + len(odd) and len(said[504]) == 2
    assert [said[i][0][0] for i in (500, 501, 502, 505)] == ["und"] * 4
    assert said[None] == [("two", False)] and said[503][0][0] == "one" and said[504][0][0] == "two"
    for r in rows:
        lang = next(k for k, v in sounds.items() if r[4][0] in v)
        assert said[r[0]] == [(lang, zlib.crc32(str(r[0]).encode()) % 5 == 0)]


def test_held_out_labels_teach_nothing(spark):
    """Labels of the held-out fold, nulls and null ids may say what they like."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    wrong = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 5 = 0, 'nonsense', lang) as lang")
    one = {tuple(r) for r in string_kernels.identify(docs).collect()}
    assert {tuple(r) for r in string_kernels.identify(wrong).collect()} == one
    assert "nonsense" not in {r[2] for r in one}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = string_kernels.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_training_draws_few_rows_of_every_language(spark):
    rows = [(i, "s", "common" if i % 50 else "rare", 1, f"some text {i}") for i in range(5000)]
    drawn = string_kernels.training_rows(frame(spark, rows), rows=200).collect()
    count = {lang: sum(r.lang == lang for r in drawn) for lang in ("common", "rare")}
    assert count["common"] == 100 and 60 <= count["rare"] <= 100
    assert sorted(r.nth for r in drawn if r.lang == "common") == list(range(1, 101))
    long = [(i, "s", "long", 1, f"word {i} " * 5000) for i in range(20)]
    assert {r.lang for r in string_kernels.training_rows(frame(spark, rows[:200] + long), rows=20).collect()} == {"common", "rare", "long"}


def test_empty_tables_and_none_to_learn_from(spark):
    none = frame(spark, [])
    assert merkle.manifest(none, merkle.tampered_chars()).collect() == []
    assert middle.digest(none).collect() == [] and string_kernels.identify(none).collect() == []
    unlabelled = string_kernels.identify(frame(spark, [(1, "s", None, 1, "some text"), (2, "s", None, 1, None)])).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_queries_have_their_counterparts(spark):
    con = connect(SF_DIR)
    from strikelake.llm import queries
    for name in ("op11_merkle_manifest", "op12_fill_in_middle"):
        assert difference(queries.QUERIES[name](spark, SF_DIR), con, oracle.ORACLES[name]) == ""
