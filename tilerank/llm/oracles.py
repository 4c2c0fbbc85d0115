"""The same results in DuckDB's SQL, for the queries that SQL can express.

Links are found there by comparing all pairs, so these are for small tables only.
"""

from __future__ import annotations

from . import url_filter

_COMPONENTS = """
reach(node, other) AS (
    SELECT node, node FROM nodes
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
),
component AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
"""

CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
    FROM range(2) AS both_turns(n)
),
escaped AS (
    SELECT *,
        replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
            '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS shown,
        replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
            '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), chr(10), '\' || chr(10)) AS named
    FROM turns
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
        AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
        FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(CASE role WHEN 'assistant' THEN length(shown) + 6
        ELSE length(named) + length(shown) + 19 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

MINHASH = (
    r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    END AS s
    FROM words
),
rows AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
overlap AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM rows x JOIN rows y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM overlap o JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
),
nodes AS (SELECT DISTINCT a AS node FROM links),
"""
    + _COMPONENTS
    + """
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
    coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN component ON node = doc_id
"""
)

EMBEDDINGS = (
    """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
),
usable AS (
    SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_sum(list_transform(e, lambda x: x * x)) > 0
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id
        AND len(x.e) = len(y.e)
    WHERE list_cosine_similarity(x.e, y.e) >= 0.9
),
nodes AS (SELECT DISTINCT a AS node FROM links),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
"""
    + _COMPONENTS
    + """
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
    coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN counts ON counts.a = vec_id LEFT JOIN component ON node = vec_id
"""
)

WARC = r"""
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest,
        octet_length(encode(coalesce(html, ''))) AS payload_bytes,
        regexp_replace(coalesce(url, ''), '^[^:/?#]*://', '') AS rest
    FROM pages
),
first AS (
    SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
    array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^[^/?#]*')), '.')), ',')
        || ')' || regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '#.*$', '') AS urlkey,
    strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM p LEFT JOIN first USING (payload_digest)
"""


PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 5) AS sizes(m)
),
counts AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (
    SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE m > 1 AND f >= 30
),
cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
),
scored AS (
    SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r,
        ((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f))::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = head
        JOIN counts y ON y.lang = c.lang AND y.phrase = tail
),
weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_runs AS (
    SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, w, a, size, unnest(range(1, m - size + 2)) AS i
        FROM candidates, range(2, 4) AS sizes(size) WHERE size < m)
    GROUP BY ALL
),
kept AS (
    SELECT w.* FROM weakest w LEFT JOIN inner_runs i ON i.lang = w.lang AND i.phrase = w.phrase
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def _crc_table() -> str:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ 0xEDB88320 * (value & 1)
        table.append(value)
    return "[" + ", ".join(map(str, table)) + "]::BIGINT[]"


# The bytes of a key of ASCII and U+00C0 to U+00FF, and their crc32.
_CRC = f"""xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c) - 64] END))),
    lambda value, byte: xor(value >> 8, ({_crc_table()})[(xor(value, byte) & 255) + 1])), 4294967295)"""

SPELLING = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
    FROM documents
),
keyed AS (
    SELECT run, count(*) AS c, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs GROUP BY doc_id, run
),
coded AS (SELECT run, c, {_CRC} AS h FROM keyed),
changed AS (
    SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, (h % length(run))::BIGINT + 2)
        ELSE run END AS word
    FROM coded
),
words AS (
    SELECT word, sum(c)::BIGINT AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
),
cut AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
),
near AS (
    SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM cut x JOIN cut y USING (i, rest) WHERE x.word <> y.word
    UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN words y ON x.rest = y.word
    UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN words y ON x.rest = y.word
),
best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n
    FROM near GROUP BY word
),
forms AS (SELECT word, other AS form, other_n AS form_n FROM best JOIN words USING (word) WHERE other_n >= 5 * n),
steps AS (
    SELECT word, form AS reached, 1 AS step FROM forms
    UNION ALL SELECT s.word, f.form, step + 1 FROM steps s JOIN forms f ON f.word = s.reached
),
roots AS (SELECT word, arg_max(reached, step) AS root FROM steps GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""


def _rule_case(result) -> str:
    """CASE over the rules, longest first; ``result`` makes the value from rule and verdict."""
    lines = []
    for text, verdict in sorted(url_filter.RULES, key=lambda pair: -len(pair[0])):
        host, slash, rest = text.partition("/")
        fits = f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{slash}{rest}')"
        lines.append(f"WHEN {fits} THEN '{result(text, verdict)}'")
    return "CASE " + " ".join(lines) + " END"


def _variable(segment: str) -> str:
    return f"CASE WHEN regexp_full_match({segment}, '[0-9]+(\\.[A-Za-z0-9]+)?') THEN '<n>' ELSE '<*>' END"


def _lone(rest: str) -> str:
    """The template of the segments below a node that is no parent."""
    names = f"CASE WHEN n >= {url_filter.LEAST_SUPPORT} THEN '/' || x ELSE '/' || {_variable('x')} END"
    return f"coalesce(array_to_string(list_transform({rest}, lambda x: {names}), ''), '')"


def _apart(b: str, n: str, b0: str, n0: str, deviations: float) -> str:
    p = f"(({b} + {b0} + 1) / ({n} + {n0} + 2))"
    return f"(({b} / {n} - {b0} / {n0}) > {deviations}::DOUBLE * sqrt({p} * (1 - {p}) * (1 / {n} + 1 / {n0})))"


def _url_level(k: int) -> str:
    before, u = f"t{k}", url_filter
    return f"""
parents{k} AS MATERIALIZED (
    SELECT host, t, sum(n) AS parent_n FROM {before} WHERE open GROUP BY host, t
    HAVING sum(n) >= {u.LEAST_SUPPORT} AND count(*) > 1
),
literal{k} AS MATERIALIZED (
    SELECT host, t, s[{k + 1}] AS seg, sum(n_labelled) AS l, sum(n_bad) AS b
    FROM {before} JOIN parents{k} USING (host, t) WHERE open GROUP BY host, t, s[{k + 1}], parent_n
    HAVING sum(n) >= {u.LEAST_SUPPORT}
        AND (sum(n_labelled) >= {u.LEAST_LABELLED} OR sum(n) >= parent_n * {u.LEAST_SHARE}::DOUBLE)
),
in_band{k} AS MATERIALIZED (
    SELECT *, floor(b * {u.BANDS} / l) AS band FROM literal{k} WHERE l >= {u.LEAST_LABELLED}
),
bands{k} AS MATERIALIZED (
    SELECT host, t, band, avg(b) AS b, avg(l) AS l, sum(b) AS all_b, sum(l) AS all_l
    FROM in_band{k} GROUP BY host, t, band
),
steps{k} AS MATERIALIZED (
    SELECT *, lag(b) OVER w AS b0, lag(l) OVER w AS l0 FROM bands{k}
    WINDOW w AS (PARTITION BY host, t ORDER BY band)
),
rows{k} AS MATERIALIZED (
    SELECT *, sum(CASE WHEN b0 IS NULL OR {_apart("b", "l", "b0", "l0", u.DEVIATIONS)} THEN 1 ELSE 0 END)
        OVER (PARTITION BY host, t ORDER BY band) AS g
    FROM steps{k}
),
ends{k} AS MATERIALIZED (
    SELECT host, t, g, arg_min(b, band) AS low_b, arg_min(l, band) AS low_l, arg_max(b, band) AS high_b,
        arg_max(l, band) AS high_l, sum(all_b) / sum(all_l) AS mean
    FROM rows{k} GROUP BY host, t, g
),
placed{k} AS MATERIALIZED (
    SELECT i.host, i.t, i.seg, r.g, CASE WHEN {_apart("high_b", "high_l", "low_b", "low_l", 2 * u.DEVIATIONS)}
        THEN floor((i.b + {u.PRIOR_WEIGHT}::DOUBLE * mean) / (i.l + {u.PRIOR_WEIGHT}::DOUBLE) * {u.SPLIT_BANDS})
        ELSE -1 END AS part
    FROM in_band{k} i JOIN rows{k} r USING (host, t, band) JOIN ends{k} USING (host, t, g)
),
names{k} AS MATERIALIZED (
    SELECT host, t, seg, CASE WHEN count(*) OVER w > 1 THEN '<~' || min(seg) OVER w || '>' ELSE seg END AS name
    FROM placed{k} WINDOW w AS (PARTITION BY host, t, g, part)
),
t{k + 1} AS MATERIALIZED (
    SELECT p.host, p.path, p.s, p.n, p.n_labelled, p.n_bad,
        CASE WHEN NOT p.open THEN p.t
            WHEN parent_n IS NULL THEN p.t || {_lone(f"p.s[{k + 1}:]")}
            ELSE p.t || '/' || coalesce(m.name, v.seg, {_variable(f"p.s[{k + 1}]")}) END AS t,
        p.open AND parent_n IS NOT NULL AND len(p.s) > {k + 1} AS open
    FROM {before} p LEFT JOIN parents{k} r ON r.host = p.host AND r.t = p.t AND p.open
        LEFT JOIN literal{k} v ON v.host = p.host AND v.t = p.t AND v.seg = p.s[{k + 1}] AND p.open
        LEFT JOIN names{k} m ON m.host = p.host AND m.t = p.t AND m.seg = p.s[{k + 1}] AND p.open
),"""


def urls(levels: int = 8) -> str:
    """The tree, segment by segment: for paths that part within so many segments."""
    u = url_filter
    return f"""
WITH parts AS MATERIALIZED (
    SELECT page_id, html,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
        regexp_extract_all(regexp_replace(regexp_replace(html,
            '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'),
            '[^\\x20\\x09-\\x0D]+') AS words
    FROM pages
),
ruled AS MATERIALIZED (
    SELECT *, {_rule_case(lambda text, verdict: text)} AS rule,
        {_rule_case(lambda text, verdict: verdict)} AS rule_verdict,
        CASE WHEN contains(host, '-') THEN true WHEN html IS NULL THEN NULL
            ELSE len(words) < {u.LEAST_WORDS} OR 100 * len(list_filter(words,
                lambda word: regexp_matches(word, '[A-Za-z\\x{{C0}}-\\x{{FF}}]'))) < {u.LEAST_LETTERED} * len(words) END AS bad
    FROM parts
),
t0 AS MATERIALIZED (
    SELECT host, path, string_split(regexp_replace(path, '^/', ''), '/') AS s,
        count(*) AS n, count(bad) AS n_labelled, count(*) FILTER (bad) AS n_bad, '' AS t, true AS open
    FROM ruled GROUP BY host, path
),
mean AS (SELECT (sum(n_bad) + 1) / (sum(n_labelled) + 2) AS share FROM t0),
{"".join(_url_level(level) for level in range(levels))}
placed AS MATERIALIZED (
    SELECT host, path, n_labelled, n_bad,
        CASE WHEN open THEN t || {_lone(f"s[{levels + 1}:]")} ELSE t END AS template
    FROM t{levels}
),
judged AS (
    SELECT host, template,
        (sum(n_bad) + {u.PRIOR_WEIGHT}::DOUBLE * any_value(share))
            / (sum(n_labelled) + {u.PRIOR_WEIGHT}::DOUBLE) AS bad_share
    FROM placed, mean GROUP BY host, template
)
SELECT page_id, ruled.host, ruled.path, rule,
    coalesce(rule_verdict, CASE WHEN bad_share >= {u.PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
    placed.template, bad_share
FROM ruled JOIN placed USING (host, path) JOIN judged ON judged.host = placed.host
    AND judged.template = placed.template
"""


def build() -> dict[str, str]:
    return {
        "op1_url_filters": urls(),
        "op4_chat_formatting": CHAT,
        "op8_minhash_near_dedup": MINHASH,
        "op9_embedding_near_dedup": EMBEDDINGS,
        "op10_warc": WARC,
        "op12_phrase_collocations": PHRASES,
        "op13_spelling_variants": SPELLING,
    }
