"""SQL of the corpus operators that SQL can express, for DuckDB on the same whole tables."""

#: Word windows are grouped by their hash; what they cover goes.
OP1 = r"""WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
 s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM t)),
 r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
 w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM t),
 kept AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.j) AS text FROM w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.j = w.j) GROUP BY w.doc_id)
 SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""

#: Bytes as hexadecimal digits, two each; windows of 50 bytes by their hash, and the spans that they make.
OP4 = r"""WITH t AS (SELECT doc_id, hex(CAST(coalesce(text, '') AS BLOB)) AS x FROM (SELECT doc_id, encode(coalesce(text, '')) AS text FROM documents)),
 s AS (SELECT doc_id, i, md5(x[2 * i + 1:2 * i + 100]) AS k FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM t)),
 r AS (SELECT doc_id, i FROM s QUALIFY min(doc_id) OVER (PARTITION BY k) < doc_id),
 e AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r),
 g AS (SELECT doc_id, i, sum(CASE WHEN before >= i - 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
 spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, span),
 edges AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM spans),
 kept AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, string_agg(x[2 * from_ + 1:2 * a] || CASE WHEN next IS NULL THEN x[2 * b + 1:] ELSE '' END, '' ORDER BY a) AS left_ FROM edges JOIN t USING (doc_id) GROUP BY doc_id)
 SELECT t.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, x))) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""


def merkle(levels: int = 12, top_levels: int = 6, fanout: int = 8) -> str:
    """Trees of up to fanout ** levels leaves and fanout ** top_levels languages, level by level; CRC-32 bit by bit."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    h = lambda text: "sha256(concat(" + ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in names[:-1]) + f", coalesce(strlen({text}) || ':' || {text}, '-')))"
    crc = "xor(list_reduce(list_prepend(4294967295, flatten([[ascii(ch), 0, 0, 0, 0, 0, 0, 0] for ch in string_split(CAST(doc_id AS VARCHAR), '')])), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"docs AS (SELECT doc_id, lang, {h('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {h(lower)} ELSE {h('text')} END AS claim FROM documents)",
        "f0 AS (SELECT *, row_number() OVER w - 1 AS p, row_number() OVER w - 1 AS position, claim AS folded, '' AS proof FROM docs WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf))",
        "n0 AS (SELECT lang, p AS i, leaf AS d, count(*) OVER (PARTITION BY lang) AS c FROM f0)",
    ]
    sides = "array_to_string(g.ds[1:{at}], '') || {own} || array_to_string(g.ds[{at} + 2:], '')"
    for name, count in (("", levels), ("t", top_levels)):
        if name:
            steps.append(f"tn0 AS (SELECT 1 AS lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, lang AS of_, d, count(*) OVER () AS c FROM n{levels})")
            steps.append(f"tf0 AS (SELECT f.* EXCLUDE (p), t.i AS p, t.d AS subroot FROM f{levels} f JOIN tn0 t ON f.lang IS NOT DISTINCT FROM t.of_)")
        for k in range(count):
            at = f"(p // {fanout**k} % {fanout})"
            own_lang = "f.lang" if not name else "1"
            steps.append(f"{name}g{k} AS (SELECT lang, i // {fanout} AS i, list(d ORDER BY i) AS ds, any_value(c) AS c FROM {name}n{k} GROUP BY lang, i // {fanout})")
            steps.append(f"{name}n{k + 1} AS (SELECT lang, i, CASE WHEN c = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, (c - 1) // {fanout} + 1 AS c FROM {name}g{k})")
            steps.append(
                f"{name}f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN g.c = 1 THEN folded ELSE sha256({sides.format(at=at, own='folded')}) END AS folded, CASE WHEN g.c = 1 THEN proof ELSE proof || {sides.format(at=at, own=repr(''))} END AS proof) FROM {name}f{k} f JOIN {name}g{k} g ON {own_lang} IS NOT DISTINCT FROM g.lang AND f.p // {fanout ** (k + 1)} = g.i)"
            )
    return f"WITH {', '.join(steps)} SELECT f.doc_id, f.lang, f.position, f.leaf, f.subroot, t.d AS root, sha256(f.proof) AS proof_sha256, f.folded AS folded_root, f.folded = t.d AS verified FROM tf{top_levels} f, tn{top_levels} t"


OP13 = merkle()
