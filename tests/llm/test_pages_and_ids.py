"""URL filter, main text, packing and piece ids against plain versions, round trips and held-out pages."""

import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest

from strikelake.llm import html_crf, lattice, oracle, packing, queries, urls
from strikelake.llm import text as tx
from strikelake.llm.components import stored as stored
from tests.compare import connect, difference

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), oracle.ORACLES[name]) == ""


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


# --- urls ------------------------------------------------------------------------------------------

URLS = {
    1: (None, "", "", None, "allow"), 2: ("", "", "", None, "allow"), 3: ("no scheme.com/", "", "", None, "allow"),
    4: ("http://COM/x", "com", "/x", "com/", "allow"), 5: ("https://a.Example.com/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"),
    6: ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"), 7: ("x://b.net/fr/#y", "b.net", "/fr/", "net/fr/", "block"),
    8: ("http://b.net/FR/", "b.net", "/FR/", None, "allow"), 9: ("http://notcom", "notcom", "", None, "allow"), 10: ("http://x.com", "x.com", "", None, "allow"),
    11: ("http://spam-farm.org/a", "spam-farm.org", "/a", None, "block"), 12: ("http://y.org/cheap/loan-free", "y.org", "/cheap/loan-free", None, "block"),
    13: ("http://y.org/cheap/cheap/cheap", "y.org", "/cheap/cheap/cheap", None, "allow"), 14: ("http://y.org/cheaper/freely", "y.org", "/cheaper/freely", None, "allow"),
    15: ("ftp://Z.example.org?q=xxx", "z.example.org", "", None, "block"), 16: ("a\nb://é.org/ü#", "é.org", "/ü", None, "allow"),
    17: ("http://x.com/" + "a" * 100_000 + "/viagra", "x.com", "/" + "a" * 100_000 + "/viagra", "com/", "allow"),
}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], "h", 1) for i, u in URLS.items()] + [(5, URLS[5][0], "h", 1)], "page_id long, url string, html string, rejected int")
    got = Counter(tuple(r)[:5] for r in urls.judge(pages).collect())
    assert got == Counter([*((i, *u[1:]) for i, u in URLS.items()), (5, *URLS[5][1:])])
    with pytest.raises(ValueError):
        urls.mark(pages)
    assert urls.judge(pages.limit(0)).collect() == []


# --- main text -------------------------------------------------------------------------------------

def test_held_out_pages():
    """Blocks of pages that the field hasn't seen."""
    model, wrong, total = html_crf.field(), 0, 0
    for page, labels in html_crf.compose(200, seed=99):
        wrong += sum(a != b for a, b in zip(model.viterbi(page), labels))
        total += len(labels)
    assert wrong <= 0.01 * total


def article(page: str) -> str:
    """The main text by the layout of the test pages."""
    start = page.index("<article>") + 9
    body = re.sub("<br>", " ", re.sub("</?b>", "", page[start:page.find("</article>", start)] if "</article>" in page else page[start:]))
    return "\n".join(x for x in (" ".join(unescape(p).split()) for p in re.split("</?(?:p|h1)>", body)) if x)


def test_pages_of_the_table(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.QUERIES["op4_main_text"](spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == {i: article(h) for i, h in html.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_odd_pages(spark):
    pages = {1: None, 2: "", 3: "<p", 4: "<article><p>One &amp; two<br>three &lt;b&gt;  four.</p><p>é&nbsp;x &unknown; &#65;</article><footer>&copy; x",
             5: "<script>if (a < b) { x = '<p>no</p>'; }</script><!-- <p>no</p> --><article><p>Yes, this is a sentence.</p></article>",
             6: "<article><p>Deep " + "<div>" * 3000 + "down it goes.</p></article>", 7: "<article><p>" + "Words go on. " * 50_000 + "</article>",
             8: "<nav><a href='x'>Home</a></nav><nav><a href=\"un>closed>Menu</a></nav><article><h1>Title</h1><p>Text is here.</p></article>"}
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in pages.items()] + [(5, "u", pages[5], "t")], "page_id long, url string, html string, text string")
    rows = html_crf.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 9 and got[1] == got[2] == got[3] == ""
    assert got[4] == "One & two three <b> four.\né x &unknown; A"
    assert got[5] == "Yes, this is a sentence."
    assert got[7] == " ".join(["Words go on."] * 50_000)
    assert got[8].endswith("Title\nText is here.")


def test_text_behind_drawings_and_custom_elements(spark):
    """An element without an end tag, or with a name that only begins like a raw one, doesn't take the rest of the page."""
    inner = ["<svg/>", "<svg class='i' />", "<SVG title=\"a>b\"/>", "<svg width=1/>", "<svg a=\"x/>", "<math/>", "<svg-icon></svg-icon>",
             "<video-player src=x></video-player>", "<video-js></video-js>", "<object-view/>", "<script-loader/>", "<svg><path/><text>no</text></svg>",
             "<svg a='/>'><text>no</text></svg>", "<svg class=\"x>no</svg><img alt=\"y\"/>", "<script>no</script foo>"]
    pages = [f"<article><p>One sentence is here.{x}</p><p>Another sentence is there.</p></article>" for x in inner]
    formula = "<math id=f><semantics><mfrac><mi>x</mi><mn>2</mn></mfrac><annotation encoding='application/x-tex'>no</annotation></semantics></math>"
    pages.append(f"<article><p>So {formula} holds. <select-box>Pick one of these.</select-box></p><p>Another sentence is there.</p></article>")
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_crf.extract(df).collect()}
    want = {i: "One sentence is here.\nAnother sentence is there." for i in range(len(inner))}
    assert got == {**want, len(inner): "So x 2 holds.\nPick one of these.\nAnother sentence is there."}


# --- packing ---------------------------------------------------------------------------------------

TEXTS = ["a  b  c  d\n\n  e é  x 's\t\tq", "", None, "ab " * 3000, "x　　 y\r\n z  \x1c q", "日本語 テキスト  é é  ß ", " \u0085 a", "q" * 5000, "same", "same"]


def test_ids_equal_those_of_the_whole_text():
    import pyarrow as pa

    with open(packing.VOCABULARY, "rb") as f:
        coder = packing.Encoder(f.read())
    for _ in range(2):  # the second time from memory
        for c in tx.chunks(pa.array(TEXTS)):
            ids, first = coder.encode(c)
            for i, t in enumerate(TEXTS):
                assert ids[first[i]:first[i + 1]].tolist() == coder.coder.encode_ordinary(t or "")


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(300):
        size = rng.choice([8, 64, 100])
        lengths = np.array([rng.randint(1, size) for _ in range(rng.randint(0, 60))], np.int64)
        rows = packing.best_fit(lengths, size)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        bins: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [b for b in bins if b >= n]
            if fit:
                bins.remove(min(fit))
            bins.append((min(fit) if fit else size) - n)
        assert sorted(bins) == sorted(size - int(sum(lengths[r])) for r in rows)


def test_matrices_and_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, rows int")
    path = str(tmp_path / "packed")
    packing.write_packed(packing.pack(docs, size=64, block=2000), path)
    packed = packing.read_packed(spark, path)
    for r in packed.collect():
        ids, position = (np.frombuffer(b, "<u2").reshape(r.rows, 64) for b in (r.ids, r.position_ids))
        bounds = np.frombuffer(r.cu_seqlens, "<i4")
        assert bounds[0] == 0 and bounds[-1] == r.rows * 64 and (np.diff(bounds) > 0).all() and r.rows <= packing.MATRIX_ROWS
        assert np.flatnonzero(position.ravel() == 0).tolist() == bounds[:-1].tolist()
        assert r.n_tokens == sum(s.length for s in r.segments) and ids.shape == position.shape
    assert sorted((r.doc_id, r.text) for r in packing.unpack(packed, size=64).collect()) == [(i, t or "") for i, t in enumerate(TEXTS)]
    assert packing.pack(docs.limit(0)).collect() == []


# --- pieces ----------------------------------------------------------------------------------------

def best_path(word: str, table: dict, p: lattice.Pieces) -> list[int]:
    best = [(0, [])]
    for end in range(1, len(word) + 1):
        found = None
        for n in range(1, min(p.longest, end) + 1):
            piece = word[end - n:end]
            if piece in table:
                ids, score = [table[piece][0]], table[piece][1]
            elif n == 1:
                ids, score = [p.fallback[b] for b in piece.encode()], p.unknown
            else:
                continue
            total = best[end - n][0] + score
            if found is None or total > found[0]:
                found = (total, best[end - n][1] + ids)
        best.append(found)
    return best[-1][1]


def split_words(text: str | None) -> list[str]:
    return re.findall(r"\x20[^\x20\x00-\x1F]*|[^\x20\x00-\x1F]+|[\x00-\x1F]", " " + text) if text else []


@pytest.mark.parametrize("longest", [2048, 40])
def test_long_words_are_those_of_the_whole_lattice(spark, tmp_path, monkeypatch, longest):
    """Uncovered characters in any number, alone and in rows, before and behind words; long words that fit."""
    monkeypatch.setattr(lattice, "LONGEST", longest)
    lattice.pieces.cache_clear()
    p = lattice.pieces()
    table, rng = {piece: (i, s) for piece, i, s in p.rows}, random.Random(9)
    rare = [chr(c) for c in range(0x4E00, 0x4F00) if not p.covered[c]]
    assert len(rare) > 50
    texts = ["".join(rng.choice(rare) for _ in range(n)) + word for n in (1, 39, 40, 41, 100, 264, 270, 700, 5000) for word in ("international", "", " the")]
    texts += ["".join(rng.choice(rare) * rng.randint(0, 3) + rng.choice(["station", "the", "x"]) for _ in range(400)), "國國" * 3000]
    if longest > 1000:
        texts += ["international" * 60, "xyz" * 600]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    coded = lattice.encode(spark.read.parquet(str(tmp_path / "docs")))
    got = {r.doc_id: list(r.ids) for r in coded.collect()}
    assert got == {d: [i for w in split_words(t) for i in best_path(w, table, p)] for d, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in lattice.decode(coded).collect()} == dict(enumerate(texts))
    lattice.pieces.cache_clear()


def test_pieces(spark, tmp_path):
    texts = [*TEXTS, " a  b\nThe tioned\t x ", "x" * 1900 + " é日本語😀▁ y", "\n\n", " ", "tion the "]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "tion the ", 1), (3, texts[3], 1)]
    spark.createDataFrame(rows, "doc_id long, text string, chunk int").write.parquet(str(tmp_path / "docs"))
    coded = lattice.encode(spark.read.parquet(str(tmp_path / "docs")))
    p = lattice.pieces()
    table = {piece: (i, s) for piece, i, s in p.rows}

    def ids(text: str | None) -> list[int]:
        return [i for w in split_words(text) for i in best_path(w, table, p)]

    got = [(r.doc_id, list(r.ids)) for r in coded.collect()]
    assert sorted(got, key=str) == sorted(((d, ids(t)) for d, t, _ in rows), key=str)
    assert {r.doc_id: r.text for r in lattice.decode(coded).collect()} == {d: t or "" for d, t, _ in rows}
    assert lattice.encode(spark.read.parquet(str(tmp_path / "docs")).limit(0)).collect() == []


def test_many_partitions_of_words_write_few_files(spark, tmp_path, monkeypatch):
    """An executor starts processes for every file that it writes, so small partitions of words share files."""
    monkeypatch.setattr(lattice, "WORDS", 100)
    kept = []
    monkeypatch.setattr(lattice, "stored", lambda df, label: kept.append(stored(df, label)) or kept[-1])
    texts = [f"{i} " + " ".join(f"w{i * k}" for k in range(20)) for i in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    coded = lattice.encode(spark.read.parquet(str(tmp_path / "docs")))
    assert {r.doc_id: r.text for r in lattice.decode(coded).collect()} == dict(enumerate(texts))
    assert len(kept[0].inputFiles()) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_numbers_in_few_bytes():
    rng = np.random.default_rng(1)
    for bits in range(1, 34):
        v = rng.integers(0, 1 << bits, 200)
        assert (lattice._unvarint(lattice._varint(v)) == v).all()


# --- vocabulary ------------------------------------------------------------------------------------

def test_a_vocabulary_of_thousands_of_terms(spark, tmp_path):
    rng = random.Random(3)
    made = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(6000)})
    rows = [(t.upper() if k % 3 else f" {t} ", "strict" if k % 10 == 0 else "soft") for k, t in enumerate(made)]
    spark.createDataFrame([*rows, ("", "strict"), (None, "soft"), ("zzz", "other")], "term string, weight string").write.parquet(str(tmp_path / "v"))
    strict, soft = urls.load_vocabulary(spark, str(tmp_path / "v"))
    assert sorted([*strict, *soft]) == made and len(strict) > 400
    pages = [(i, "http://x.org/" + rng.choice("/-._").join(rng.choice([rng.choice(made), "q" + rng.choice(made), "777"]) for _ in range(rng.randint(1, 5))))
             for i in range(400)] + [(400, None), (401, "")]
    got = {r.page_id: (r.n_strict, r.n_soft, r.verdict) for r in urls.judge(
        spark.createDataFrame(pages, "page_id long, url string"), rules=(), strict=strict, soft=soft, soft_hits=3).collect()}
    for i, url in pages:
        found = set(re.findall(r"[a-z0-9]+", (url or "").lower()))
        n_strict, n_soft = len(found & set(strict)), len(found & set(soft))
        assert got[i] == (n_strict, n_soft, "block" if n_strict or n_soft >= 3 else "allow"), url
