"""DuckDB twins of the operators of this package that SQL can express."""

from __future__ import annotations

from lexspark.llm import decontamination as dc, fill_in_middle as fim, link_rank as lr, quality_rules as qr, secret_scan as ss

# words of a benchmark window, by contract
WINDOW = 13
_BLANK = r"[ \t\n\x0b\x0c\r]"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '')"


def _quality() -> str:
    gone = lambda chars: f"length(body) - length(translate(body, '{chars}', ''))"
    rules = " UNION ALL ".join(
        f"SELECT {i} AS rule, {g + 1} AS level, {c}::DOUBLE AS cutoff" for i, r in enumerate(qr.RULES) for g, c in enumerate(reversed(r.grid)))
    value = "CASE rule " + " ".join(f"WHEN {i} THEN {r.value}" for i, r in enumerate(qr.RULES)) + " END"
    share = qr.ALPHA / len(qr.RULES)
    tail = (f"list_sum(list_transform(range(0, good::BIGINT + 1), lambda j: exp(lgamma(n_good + 1.0) - lgamma(j + 1.0) - lgamma(n_good - j + 1.0)"
            f" + j * ln({share!r}) + (n_good - j) * ln({1 - share!r}))))")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS body, {_WORDS} AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\x0c\\r]')) AS lines FROM documents),
win AS (SELECT r, i, list_slice(words, i, i + {qr.WINDOW - 1}) AS w FROM d, unnest(range(1, len(words) - {qr.WINDOW - 2})) AS u(i)),
twice AS (SELECT r, unnest(ats) AS i FROM (SELECT r, list(i) AS ats FROM win GROUP BY r, w HAVING count(*) > 1)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, {qr.WINDOW})) AS v(k) GROUP BY r),
f AS (SELECT d.r, doc_id, lang, len(words)::BIGINT AS n_words, length(regexp_replace(body, '{_BLANK}+', '', 'g'))::BIGINT AS word_chars,
             ({gone(qr.SYMBOLS)})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
             {gone(qr.CAPITALS)} AS n_capitals, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
rules AS ({rules}),
known AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
marked AS (SELECT f.*, known.good AS good FROM f JOIN known USING (doc_id)),
totals AS (SELECT lang, count_if(good) AS n_good FROM marked GROUP BY lang),
tested AS (SELECT lang, rule, level, cutoff, count_if(good) AS good, count_if(NOT good) AS bad FROM marked, rules WHERE {value} > cutoff GROUP BY ALL),
proved AS (SELECT t.*, CASE WHEN good < n_good * {share!r} THEN least(1.0, {tail}) ELSE 1.0 END AS p
           FROM tested t JOIN totals ON t.lang IS NOT DISTINCT FROM totals.lang),
walked AS (SELECT *, max(p) OVER (PARTITION BY lang, rule ORDER BY level DESC) AS worst FROM proved),
best AS (SELECT * FROM walked WHERE worst <= {qr.DELTA!r} / ((SELECT count(*) FROM totals) * {len(qr.RULES)}) AND bad > good
         QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad - good DESC, level DESC) = 1),
lost AS (SELECT DISTINCT r FROM f JOIN best ON f.lang IS NOT DISTINCT FROM best.lang WHERE {value} > cutoff),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost.r IS NULL AS kept
FROM judged LEFT JOIN lost USING (r)"""


def _fill_in_middle() -> str:
    unit = rf"{_BLANK}*[^ \t\n\x0b\x0c\r]+|{_BLANK}+"
    draw = lambda i: f"('0x' || substr(digest, {8 * i - 7}, 8))::BIGINT"
    piece = lambda lo, hi: f"array_to_string(list_slice(toks, {lo}, {hi}), '')"
    p, s, m = fim.PREFIX, fim.SUFFIX, fim.MIDDLE
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{unit}') AS toks,
                  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
c AS (SELECT *, len(toks) AS n, least({draw(1)} % (len(toks) + 1), {draw(2)} % (len(toks) + 1)) AS a,
             greatest({draw(1)} % (len(toks) + 1), {draw(2)} % (len(toks) + 1)) AS b,
             CASE WHEN body = '' OR contains(body, '{p}') OR contains(body, '{s}') OR contains(body, '{m}') OR {draw(3)} % 100 >= 50 THEN 'plain'
                  WHEN {draw(4)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
x AS (SELECT *, {piece(1, 'a')} AS pre, {piece('a + 1', 'b')} AS mid, {piece('b + 1', 'n')} AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid
              ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256, sha256(body) AS restored_sha256
FROM x"""


def _merkle(levels: int = 6, sizes: int = 16) -> str:
    """levels of runs a tree: 16 ** 6 rows a source and as many sources."""
    enc = lambda v: f"coalesce(octet_length(encode(({v})::VARCHAR)) || ':' || ({v})::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    parts = [f"""
WITH l0 AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf,
                   CASE WHEN crc % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
            FROM documents LEFT JOIN crcs USING (doc_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l0),
a0 AS (SELECT source AS tree, pos, leaf AS node FROM l)"""]
    # a level: (tree, pos, node, run) with the whole run, null where the tree is one node already
    def climb(name: str, count: int) -> None:
        for i in range(count):
            parts.append(f"""{name}r{i} AS (SELECT tree, pos // {sizes} AS pos, list(node ORDER BY pos) AS run, count(*) AS n FROM {name}{i} GROUP BY tree, pos // {sizes}),
{name}s{i} AS (SELECT *, (SELECT count(*) FROM {name}{i} x WHERE x.tree IS NOT DISTINCT FROM {name}r{i}.tree) > 1 AS more FROM {name}r{i}),
{name}{i + 1} AS (SELECT tree, pos, CASE WHEN more THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node FROM {name}s{i})""")

    climb("a", levels)
    parts.append(f"""sub AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS rank FROM a{levels}),
b0 AS (SELECT 0 AS tree, rank AS pos, subroot AS node FROM sub)""")
    climb("b", levels)
    parts.append("p0 AS (SELECT l.*, subroot, rank, coalesce(tampered, leaf) AS fold, '' AS sib FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source)")
    step = 0
    for name, place_of, tree in (("a", "pos", "p.source"), ("b", "rank", "0")):
        for i in range(levels):
            place = f"(p.{place_of} // {sizes ** i}) % {sizes} + 1"
            parts.append(f"""p{step + 1} AS (SELECT p.* REPLACE (
 CASE WHEN more THEN sha256(array_to_string(list_slice(run, 1, {place} - 1), '') || fold || array_to_string(list_slice(run, {place} + 1, n), '')) ELSE fold END AS fold,
 CASE WHEN more THEN sib || array_to_string(list_slice(run, 1, {place} - 1), '') || array_to_string(list_slice(run, {place} + 1, n), '') ELSE sib END AS sib)
 FROM p{step} p JOIN {name}s{i} s ON s.tree IS NOT DISTINCT FROM {tree} AND s.pos = p.{place_of} // {sizes ** (i + 1)})""")
            step += 1
    crcs = _crc32()
    head, rest = parts[0].split("l0 AS", 1)
    return f"""{head.replace('WITH', 'WITH RECURSIVE')}{crcs},
l0 AS{rest}, {', '.join(parts[1:])}
SELECT doc_id, leaf, subroot, node AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = node AS verified FROM p{step}, b{levels}"""


def _crc32() -> str:
    """crc32 of every decimal doc_id, bit by bit (reversed polynomial 0xEDB88320)."""
    return """crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(doc_id::VARCHAR, ''), lambda c: c <> ''),
 lambda c: ascii(c)::BIGINT)), lambda acc, byte: list_reduce([xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
 lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc
 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))"""


_SMALL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = "regexp_extract_all(" + _SMALL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _contamination() -> str:
    """Windows of items, by their lengths, against all windows of documents; proximity around the rarest word of every window."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS ws FROM documents),
it AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, list_slice(ws, i, i + least(len(ws), {WINDOW}) - 1) AS w
       FROM it, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS u(i) WHERE len(ws) > 0),
word AS (SELECT r, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w1 FROM d),
next13 AS (SELECT r, i, [w1, {', '.join(f'lead(w1, {k}) OVER o' for k in range(1, WINDOW))}] AS ws FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
dw AS (SELECT r, n, i, list_slice(ws, 1, n) AS w FROM next13, (SELECT DISTINCT n FROM iw) WHERE ws[n] IS NOT NULL),
found AS (SELECT DISTINCT r, i, n, item_id FROM dw JOIN iw USING (n, w)),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS v(k) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r),
term AS (SELECT n, w, unnest(w) AS w1, unnest(range(0, n)) AS place FROM (SELECT DISTINCT n, w FROM iw)),
rare AS (SELECT n, w, min(struct_pack(seen := seen, w1 := w1, place := place)) AS m FROM term JOIN (SELECT w1, count(*) AS seen FROM word GROUP BY w1) USING (w1) GROUP BY n, w HAVING count(*) = n),
around AS (SELECT r, n, w, list_slice(ws, greatest(1, i - m.place - {dc.SLACK}), i - m.place + n - 1 + {dc.SLACK}) AS wide FROM rare JOIN word ON word.w1 = m.w1 JOIN d USING (r)),
held AS (SELECT DISTINCT r, n, w FROM around WHERE list_has_all(wide, w)
         AND len(list_filter(w, lambda x: len(list_filter(w, lambda y: y = x)) > len(list_filter(wide, lambda y: y = x)))) = 0),
nearby AS (SELECT r, count(*) AS n_near, string_agg(id, ',' ORDER BY id) AS near FROM (SELECT r, item_id::VARCHAR AS id FROM held JOIN iw USING (n, w) WHERE item_id IS NOT NULL
           EXCEPT SELECT r, item_id::VARCHAR FROM found) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN nearby USING (r)"""


def _url_verdicts() -> str:
    """Rules by length, then one pair of CTEs a round of both ranks."""
    rules = ", ".join(f"('{rule}', '{verdict}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for rule, verdict in lr.RULES)
    parts = lambda url: (_SMALL.format(f"regexp_extract({url}, '://([^/?#]*)', 1)"), f"regexp_extract({url}, '://([^/?#]*)([^?#]*)', 2)")
    host, path = parts("coalesce(url, '')")
    ranks = ", ".join(
        f"""r{i} AS (SELECT kind, host, sum(x) AS x FROM (SELECT kind, host, x * {1 - lr.DAMPING!r} AS x FROM r0 UNION ALL
          SELECT kind, e.dst, x * share * {lr.DAMPING!r} FROM r{i - 1} JOIN edges e USING (kind, host)) GROUP BY kind, host)""" for i in range(1, lr.ROUNDS + 1))
    return f"""
WITH rules(rule, said, domain, start) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS r, page_id, {host} AS host, {path} AS path, html FROM pages),
fits AS (SELECT p.r, arg_max(struct_pack(rule := rule, said := said), len(rule)) AS best FROM p JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY p.r),
j AS (SELECT p.*, best.rule AS rule, best.said AS said FROM p LEFT JOIN fits USING (r)),
links AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {parts("CASE WHEN starts_with(link, '//') THEN ':' || link ELSE link END")[0]} AS dst
          FROM (SELECT host, unnest(regexp_extract_all(html, '{_HREF_SQL}', 1)) AS link FROM p)) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
both_ways AS (SELECT 'allow' AS kind, src AS host, dst, n FROM links UNION ALL SELECT 'block', dst, src, n FROM links),
edges AS (SELECT kind, host, dst, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM both_ways),
r0 AS (SELECT said AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY said) AS x FROM j WHERE said IS NOT NULL AND host <> '' GROUP BY said, host), {ranks},
h AS (SELECT host, coalesce(sum(x) FILTER (WHERE kind = 'allow'), 0.0)::DOUBLE AS trust, coalesce(sum(x) FILTER (WHERE kind = 'block'), 0.0)::DOUBLE AS distrust FROM r{lr.ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN coalesce(distrust > trust, false) THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust FROM j LEFT JOIN h USING (host)"""


_HREF_SQL = lr._HREF.replace("'", "''")


def _secrets() -> str:
    """Spans by running lengths of matches and gaps. Without look-around: bare keys and addresses are whole runs of their characters."""
    patterns = ss.PATTERNS | {"key": "[A-Za-z0-9+/_=-]+", "endpoint": ss.PATTERNS["endpoint"].partition("|")[0] + "|[0-9.]+"}
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    matches = " UNION ALL ".join(
        f"SELECT r, {i} AS kind, '{k}' AS name, '{ss.PARTS[k]}' AS part, unnest(hs) AS h, unnest(gs[1:len(hs)]) AS g, generate_subscripts(hs, 1) AS j"
        f" FROM (SELECT r, regexp_extract_all(t, '{quoted[k]}') AS hs, string_split_regex(t, '{quoted[k]}') AS gs FROM d)" for i, k in enumerate(ss.KINDS))
    near = lambda parts: f"EXISTS (SELECT 1 FROM x o WHERE o.r = x.r AND o.part IN ({parts}) AND o.s BETWEEN x.s - {ss.SCOPE} AND x.s + {ss.SCOPE})"
    joined = "string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS ({matches}),
placed AS (SELECT r, kind, name, part, h, sum(len(g) + len(h)) OVER (PARTITION BY r, kind ORDER BY j)::BIGINT AS e FROM m),
x AS (SELECT r, kind, name, part, e - len(h) AS s, e FROM placed WHERE CASE name WHEN 'assign' THEN len(regexp_extract(h, '{quoted["assign"]}', 1)) >= 12 WHEN 'access' THEN len(h) >= 18
  WHEN 'key' THEN len(h) >= 32 AND regexp_matches(h, '[0-9]') AND regexp_matches(h, '[a-z]') AND regexp_matches(h, '[A-Z]')
  WHEN 'endpoint' THEN h LIKE 'http%' OR regexp_full_match(h, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') ELSE true END),
kept AS (SELECT *, kind < {ss.KINDS.index(ss.WEAK[0])} AS strong FROM x WHERE CASE name WHEN 'login' THEN {near("'s'")} WHEN 'key' THEN {near("'i', 'e'")} WHEN 'endpoint' THEN {near("'i'")} AND {near("'s'")} ELSE true END),
f AS (SELECT r, count(*) FILTER (WHERE name = 'assign') AS a, count(*) FILTER (WHERE name = 'access') AS k, count(*) FILTER (WHERE name = 'hex') AS x,
  {joined} FILTER (WHERE strong) AS base, {joined} AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(x, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)"""


# 13 words from this one on; null where the document ends earlier
_FOLLOWING = "w1 || ' ' || " + " || ' ' || ".join(f"lead(w1, {k}) OVER o" for k in range(1, WINDOW))


def _repeated_words() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w1 FROM d),
win AS (SELECT doc_id, i, {_FOLLOWING} AS w FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY w IS NOT NULL),
seen AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN seen USING (w), unnest(range(0, 13)) AS v(k) WHERE least < doc_id),
kept AS (SELECT doc_id, string_agg(w1, ' ' ORDER BY i) AS body, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _repeated_bytes() -> str:
    """Every 50-byte string that two documents may share, by its hash first; removed places are merged into runs."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
h AS (SELECT doc_id, unnest(range(0, n - 49)) AS i, unnest(list_transform(range(0, n - 49), lambda i: hash(b[i + 1:i + 50]))) AS h FROM d),
win AS (SELECT doc_id, i, b[i + 1:i + 50] AS w FROM (SELECT doc_id, i FROM h SEMI JOIN (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h)) JOIN d USING (doc_id)),
seen AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w),
bad AS (SELECT doc_id, i FROM win JOIN seen USING (w) WHERE least < doc_id),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true)::INT AS opens FROM bad),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked) GROUP BY doc_id, run),
cut AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
gaps AS (SELECT doc_id, s, hex(b[after + 1:s]) AS piece FROM (
  SELECT doc_id, s, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS after FROM (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, n, NULL FROM d)) JOIN d USING (doc_id) WHERE s > after),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) AS hx FROM gaps GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(hx, ''))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""


ORACLE = {"op1_secret_scans": _secrets(), "op2_benchmark_decontamination": _contamination(), "op7_url_filters": _url_verdicts(), "op9_substring_dedup": _repeated_words(), "op10_suffix_array_dedup": _repeated_bytes(),
          "op11_quality_rules": _quality(), "op12_fill_in_middle": _fill_in_middle(), "op13_merkle_manifest": _merkle()}
