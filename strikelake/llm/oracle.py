"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from strikelake.llm import urls

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM d),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER p || chr(0) || lead(word, 2) OVER p || chr(0)
      || lead(word, 3) OVER p || chr(0) || lead(word, 4) OVER p AS rest FROM t
      WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, rest) AS n FROM g WHERE rest IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(5) s(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_caps,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _terms(table: str, key: str) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({low}, '{_TERM}') AS w FROM {table}"


LEAKS = f"""
WITH d AS ({_terms("documents", "doc_id")}), b AS ({_terms("benchmark", "item_id")}),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
"""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fits(of: str, start: str) -> str:
    return f"((host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{start}'))"


def _urls() -> str:
    """The rules and the vocabulary of the operator, with one regular expression per term."""
    def hits(terms: tuple[str, ...]) -> str:
        return " + ".join(f"regexp_matches(url, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INTEGER" for t in terms)

    by_length = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for _, h, p in by_length)
    said = " ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in by_length)
    return f"""
WITH p AS (SELECT page_id, {_FOLD.format("coalesce(url, '')")} AS url,
                  {_FOLD.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT *, {hits(urls.STRICT)} AS n_strict, {hits(urls.SOFT)} AS n_soft FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule, n_strict, n_soft,
       CASE {said} WHEN n_strict > 0 OR n_soft >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM h"""


_LEVELS = """
SELECT tree, 0 AS lvl, pos, n, digest FROM {0} UNION ALL
SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM {1} WHERE n > 1 GROUP BY tree, lvl, n, pos // 2"""


def _leaf(n_chars: str) -> str:
    parts = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))
    return f"sha256({parts})"


# The checksum of the decimal id, bit by bit.
_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

MANIFEST = f"""
WITH RECURSIVE
g AS (SELECT lang AS of_lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM documents)),
c AS (SELECT *, n_chars + CASE WHEN {_CRC32} % 7 = 0 THEN 1 ELSE 0 END AS claimed_chars FROM documents),
h AS (SELECT doc_id, tree, {_leaf("n_chars")} AS digest, {_leaf("coalesce(claimed_chars, n_chars)")} AS claimed
      FROM c JOIN g ON lang IS NOT DISTINCT FROM of_lang),
l AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h
      WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest)),
t AS ({_LEVELS.format("l", "t")}),
s AS (SELECT -1::BIGINT AS tree, tree AS pos, count(*) OVER () AS n, digest FROM t WHERE n = 1),
r AS ({_LEVELS.format("s", "r")}),
a AS (SELECT * FROM t UNION ALL SELECT * FROM r),
f AS (SELECT doc_id, tree AS own, pos AS place, digest AS leaf, tree, 0 AS lvl, pos, claimed AS x, '' AS proof, false AS ended FROM l
      UNION ALL
      SELECT doc_id, own, place, leaf, CASE WHEN me.n = 1 THEN -1 ELSE f.tree END, CASE WHEN me.n = 1 THEN 0 ELSE f.lvl + 1 END,
             CASE WHEN me.n = 1 THEN f.tree ELSE f.pos // 2 END,
             CASE WHEN me.n = 1 THEN x WHEN f.pos % 2 = 0 THEN sha256(x || coalesce(sib.digest, '')) ELSE sha256(sib.digest || x) END,
             proof || CASE WHEN me.n = 1 THEN '' ELSE coalesce(sib.digest, '') END, me.n = 1 AND f.tree = -1
      FROM f JOIN a me ON me.tree = f.tree AND me.lvl = f.lvl AND me.pos = f.pos
           LEFT JOIN a sib ON sib.tree = f.tree AND sib.lvl = f.lvl AND sib.pos = xor(f.pos, 1)
      WHERE NOT ended)
SELECT doc_id, leaf, s.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = root.digest AS verified
FROM f JOIN s ON s.pos = f.own, (SELECT digest FROM r WHERE n = 1) root WHERE ended"""

MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
             coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""

ORACLES: dict[str, str] = {
    "op1_url_filter": _urls(),
    "op7_quality": QUALITY + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars > 16 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > n_words
            OR 10 * n_caps > 4 * word_chars OR 10 * n_dup_lines > 3 * n_words) AS kept
FROM b""",
    "op8_decontamination": LEAKS + """
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_merkle_manifest": MANIFEST,
    "op12_fill_in_middle": MIDDLE,
}
