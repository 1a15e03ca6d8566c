"""SQL for the queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

import math

from glyphmill.operators import clean
from glyphmill.operators.vocabulary import HEX_BASE
from glyphmill.plans import queries as Q


def _text(s: str) -> str:
    """A string literal; control characters by number."""
    parts = ["'" + c.replace("'", "''") + "'" if c >= " " else f"chr({ord(c)})" for c in s]
    return "(" + " || ".join(parts or ["''"]) + ")"


def _list(strings) -> str:
    return "(" + ", ".join(strings) + ")"


BYTES = "regexp_extract_all(hex(encode(text)), '..')"
HISTOGRAM = f"SELECT byte, count(*) AS cnt FROM (SELECT unnest({BYTES}) AS byte FROM documents) GROUP BY byte"


def _caps(text: str, source: str) -> str:
    return rf"""
    SELECT doc_id, coalesce(array_to_string(list_transform(list_zip(runs, range(1, len(runs) + 1)), lambda z: CASE
        WHEN NOT regexp_matches(z[1], '^\p{{L}}') THEN z[1]
        WHEN regexp_matches(z[1], '^\p{{Lu}}') AND ((regexp_full_match(z[1], '.[^\P{{L}}\p{{Lu}}\p{{Lt}}]*') AND regexp_matches(z[1], '\p{{Ll}}'))
             OR (length(z[1]) = 1 AND z[2] < len(runs))) THEN chr(20) || lower(z[1])
        WHEN regexp_full_match(z[1], '[^\P{{L}}\p{{Ll}}\p{{Lt}}]*') AND regexp_matches(z[1], '\p{{Lu}}') THEN chr(21) || lower(z[1])
        ELSE z[1] END), ''), '') AS text
    FROM (SELECT doc_id, regexp_extract_all({text}, '\p{{L}}+|\P{{L}}+') AS runs FROM {source})"""


def _words(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '(\p{{L}}+)', '\1' || chr(22), 'g'), chr(22) || ' ([\p{{L}}' || chr(20) || chr(21) || ']|\z)', chr(22) || '\1', 'g')"


def _line_words(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '(\p{{L}}+)', '\1' || chr(22), 'g'), chr(22) || ' (\p{{L}})', chr(22) || '\1', 'g')"


def _line_caps(text: str) -> str:
    return rf"""array_to_string(list_transform(regexp_extract_all({text}, '\p{{L}}+|\P{{L}}+'), lambda w: CASE
        WHEN regexp_full_match(w, '\p{{Lu}}\p{{Ll}}*') THEN chr(20) || lower(w[1]) || w[2:]
        WHEN regexp_full_match(w, '\p{{Lu}}+') THEN chr(21) || lower(w)
        ELSE w END), '')"""


def _lines(of_line) -> str:
    return f"""
    SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)), lambda x: {of_line("x")}), chr(10)) || chr(10) AS text
    FROM documents"""


def _hex_fallback(pair: str) -> str:
    return f"'10 ' || hex(encode(lower({pair}[1]))) || ' ' || hex(encode(lower({pair}[2])))"


def _bits_fallback(pair: str) -> str:
    nibbles = ", ".join(f"'{d:X}': '{' '.join('12' if d >> k & 1 else '11' for k in (3, 2, 1, 0))}'" for d in range(16))
    return f"(map {{{nibbles}}})[{pair}[1]] || ' ' || (map {{{nibbles}}})[{pair}[2]]"


def _joined_tokens(parts: str) -> str:
    return f"""
    SELECT doc_id, CASE WHEN tokens = '' THEN 0 ELSE len(string_split(tokens, ' ')) END AS n_tokens, tokens
    FROM (SELECT doc_id, coalesce(array_to_string({parts}, ' '), '') AS tokens FROM documents)"""


def _by_bytes(vocabulary, fallback) -> str:
    single = _list(f"'{t.string.hex().upper()}'" for t in vocabulary if len(t.string) == 1)
    return _joined_tokens(f"list_transform({BYTES}, lambda x: CASE WHEN x IN {single} THEN x ELSE {fallback('x')} END)")


def _greedy() -> str:
    strings = sorted((t.string.decode() for t in Q.HEX), key=lambda s: (-len(s), s))
    pattern = "(?s)" + "|".join("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in strings) + "|."
    inner = f"array_to_string(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: {_hex_fallback('x')}), ' ')"
    known = _list(map(_text, strings))
    return _joined_tokens(f"list_transform(regexp_extract_all(text, '{pattern}'), lambda t: CASE WHEN t IN {known} THEN hex(encode(t)) ELSE {inner} END)")


COUNTS = f"SELECT token, count(*) AS cnt FROM (SELECT unnest(string_split(tokens, ' ')) AS token FROM ({_greedy()}) WHERE tokens <> '') GROUP BY token"


def _costs(table: str, keys: str, vocabulary) -> str:
    """c: the least cost up to each place, from 0 on; texts of null have no row."""
    ways = []
    for t in vocabulary:
        s = t.string.decode()
        n = len(s)
        ways.append(f"CASE WHEN pp[1] >= {n} AND text[pp[1] - {n - 1}:pp[1]] = {_text(s)} THEN c[pp[1] - {n - 1}] + 1 ELSE 1000000000 END")
    literal = f"c[pp[1]] + {vocabulary.literal_cost} * strlen(text[pp[1]:pp[1]])"
    steps = "list_prepend([0::BIGINT], list_transform(range(1, length(text) + 1), lambda p: [p]))"
    return f"SELECT {keys}, text, list_reduce({steps}, lambda c, pp: list_append(c, least({literal}, {', '.join(ways)}))) AS c FROM {table} WHERE text IS NOT NULL"


def _optimal_cost() -> str:
    return f"SELECT item_id, c[length(text) + 1] AS cost FROM ({_costs('benchmark', 'item_id', Q.HEX)})"


def _optimal_pieces(table: str, keys: str, vocabulary) -> str:
    """WITH ... s: the optimal tokens backwards: keys, place of the end, piece (text), n (its length), own (a token or not).

    Of equal costs, the longest last token.
    """
    longest = sorted((t.string.decode() for t in vocabulary), key=lambda s: (-len(s), s))
    ways = " ".join(f"WHEN q >= {len(s)} AND text[q - {len(s) - 1}:q] = {_text(s)} AND c[q + 1] = c[q - {len(s) - 1}] + 1 THEN {len(s)}" for s in longest)
    return f"""
    WITH RECURSIVE k AS MATERIALIZED ({_costs(table, keys, vocabulary)}),
    w AS (
      SELECT {keys}, length(text) AS p, CAST(0 AS BIGINT) AS n, CAST(length(text) AS BIGINT) AS q FROM k
      UNION ALL
      SELECT {keys}, q, n, q - greatest(n, 1) FROM (
        SELECT {keys}, q, CAST(CASE {ways} ELSE 0 END AS BIGINT) AS n
        FROM w JOIN k USING ({keys}) WHERE q > 0)),
    s AS (
      SELECT {keys}, p, n > 0 AS own, text[p - greatest(n, 1) + 1:p] AS piece
      FROM w JOIN k USING ({keys}) WHERE p > q)"""


def _optimal_strings(table: str, keys: str, vocabulary) -> str:
    """... b: a row for each token, and for each byte of a literal character: keys, p, k, own, h (hex)."""
    return _optimal_pieces(table, keys, vocabulary) + f""",
    b AS (
      SELECT {keys}, p, own, unnest(CASE WHEN own THEN [hex(encode(piece))] ELSE regexp_extract_all(hex(encode(piece)), '..') END) AS h,
        unnest(range(1, CASE WHEN own THEN 2 ELSE CAST(strlen(piece) AS BIGINT) + 1 END)) AS k
      FROM s)"""


def _optimal_tokens() -> str:
    return f"""{_optimal_strings("conversations", "conv_id, turn", Q.BITS)},
    j AS (SELECT conv_id, turn, string_agg(h, ' ' ORDER BY p, k) AS tokens FROM b GROUP BY conv_id, turn)
    SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN coalesce(tokens, '') ELSE '' END AS tokens FROM conversations LEFT JOIN j USING (conv_id, turn)"""


BENCHMARK = _optimal_strings("benchmark", "item_id", Q.HEX)
OPTIMAL_COUNTS = f"{BENCHMARK} SELECT CASE WHEN own THEN 'token' ELSE 'literal' END AS kind, lower(h) AS token, count(*) AS cnt FROM b GROUP BY ALL"
OPTIMAL_PAIRS = f"""{BENCHMARK}, f AS (SELECT lower(h) AS "left", lower(lead(h) OVER (PARTITION BY item_id ORDER BY p, k)) AS "right" FROM b)
    SELECT "left", "right", count(*) AS cnt FROM f WHERE "right" IS NOT NULL GROUP BY ALL"""
OPTIMAL_REPORT = f"""{BENCHMARK}
    SELECT token, count(*) AS cnt FROM (SELECT unnest(CASE WHEN own THEN [h] ELSE string_split({_hex_fallback("h")}, ' ') END) AS token FROM b) GROUP BY token
    ORDER BY cnt DESC, token LIMIT 200"""


def _top_substrings(source: str, n: int, levels: int = 6) -> str:
    """No string of ``levels`` bytes or more is among the best of the tables that this runs on, so no longer one can be."""
    parts = [
        f"h AS MATERIALIZED (SELECT hex(encode(text)) AS x FROM {source} WHERE text <> '')",
        "b1 AS MATERIALIZED (SELECT gram, 1 AS length, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(x, '..')) AS gram FROM h) GROUP BY gram)",
    ]
    for k in range(2, levels + 1):
        at = " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(substr(x, {2 * o + 1}), '.{{{2 * k}}}')) AS gram FROM h" for o in range(k))
        grams = f"SELECT gram, count(*) AS n FROM ({at}) GROUP BY gram"
        parts.append(f"c{k} AS (SELECT gram, {k} AS length, n AS cnt FROM ({grams}) WHERE gram[:{2 * k - 2}] IN (SELECT gram FROM b{k - 1} WHERE length = {k - 1}))")
        parts.append(f"b{k} AS MATERIALIZED (SELECT * FROM (SELECT * FROM b{k - 1} UNION ALL SELECT * FROM c{k}) ORDER BY cnt DESC, length, gram LIMIT {n})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT gram, length, cnt FROM b{levels}"


def _vocabulary_rows(name: str) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t.string.hex().upper()}')" for i, t in enumerate(Q.HEX)) + f") AS {name}(id, token)"


def _markers(line: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({line}, {_text(p)})" for p in prefixes) + ")"


STRIP = f"""
WITH l AS (
  SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS x FROM documents WHERE text <> '')),
m AS (
  SELECT *, CASE WHEN {_markers("line", clean.LEGAL_START)} THEN 1 WHEN {_markers("line", clean.LEGAL_END)} THEN 0 END AS legal,
    {_markers("line", clean.START_MARKERS)} AS starts, {_markers("line", clean.END_MARKERS)} AS ends
  FROM l),
p AS (SELECT *, legal IS NULL AND coalesce(last_value(legal IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) = 0 AS plain FROM m),
h AS (SELECT *, starts AND coalesce(sum((plain AND NOT starts)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {clean.HEADER_LINES} AS heads FROM p),
s AS (SELECT *, ends AND NOT heads AND coalesce(sum((plain AND NOT heads)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {clean.FOOTER_LINES} AS stops FROM h),
o AS (SELECT *, bool_or(stops) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS over_ FROM s),
f AS (SELECT *, max(CASE WHEN heads AND NOT over_ THEN pos END) OVER (PARTITION BY doc_id) AS last FROM o),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM f WHERE plain AND NOT heads AND NOT over_ AND (last IS NULL OR pos > last) GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""



def _clean(source: str) -> str:
    trimmed = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
    rows = "PARTITION BY doc_id ORDER BY pos"
    verse = r"""len(list_filter(list_zip(bare[:-2], bare[2:]), lambda z: NOT regexp_matches(z[1], '[.!?]$') AND regexp_matches(z[2], '^\p{Lu}'))) > 0
        AND len(list_filter(bare, lambda x: NOT regexp_matches(x, '^\p{Lu}') AND regexp_matches(x, '^\p{L}'))) = 0"""
    return rf"""
    WITH t AS (SELECT doc_id, text FROM {source}),
    l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM t)),
    m AS (SELECT *, regexp_full_match(line, '\s*') AS blank, max(pos) OVER (PARTITION BY doc_id) AS last_pos FROM l),
    r AS (SELECT *, sum(blank::INT) OVER ({rows} ROWS UNBOUNDED PRECEDING) AS run FROM m),
    g AS (
      SELECT doc_id, blank, min(pos) AS pos, max(pos) = max(last_pos) AS final, list(line ORDER BY pos) AS lines,
        list({trimmed.format("line")} ORDER BY pos) AS bare
      FROM r GROUP BY doc_id, blank, CASE WHEN blank THEN -pos ELSE run END),
    p AS (
      SELECT doc_id, blank, pos, final, CASE WHEN blank THEN [''] WHEN {verse} THEN lines
        ELSE [array_to_string(list_prepend(regexp_replace(lines[1], '\s+$', ''), bare[2:]), ' ')] END AS lines
      FROM g),
    k AS (SELECT *, min(CASE WHEN NOT blank AND (final OR NOT {_markers("lines[1]", clean.SKIPPED)}) THEN pos END) OVER (PARTITION BY doc_id) AS start FROM p),
    o AS (
      SELECT doc_id, string_agg(CASE WHEN pos = start AND NOT final THEN chr(10) || chr(10) ELSE '' END || array_to_string(lines, chr(10)), chr(10) ORDER BY pos) AS text
      FROM k WHERE pos >= start GROUP BY doc_id)
    SELECT t.doc_id, coalesce(o.text, '') AS text FROM t LEFT JOIN o ON t.doc_id = o.doc_id"""


SAMPLED = """
WITH a AS (SELECT doc_id, text, length(text) AS n, (doc_id * 2654435761) % greatest(length(text) - 256, 1) AS cut FROM documents),
b AS (SELECT *, substr(text, cut - length(string_split(substr(text, 1, cut), chr(10))[-1]) + 1) AS rest FROM a),
c AS (SELECT *, instr(substr(rest, 256), chr(10)) AS after FROM b)
SELECT doc_id, CASE WHEN n <= 256 THEN text WHEN after > 0 THEN substr(rest, 1, 255 + after) ELSE rest END AS piece FROM c
"""

def _substring_vocabulary(size: int) -> str:
    base = ", ".join(f"('{s.hex()}', {len(s)}, true)" for s in HEX_BASE)
    return f"""
    WITH t AS ({_top_substrings("documents", size)}),
    b(token, length, mandatory) AS (VALUES {base}),
    r AS (SELECT lower(gram) AS token, length, row_number() OVER (ORDER BY cnt DESC, length, gram) AS k FROM t WHERE lower(gram) NOT IN (SELECT token FROM b))
    SELECT token, CAST(length AS INTEGER) AS length, mandatory FROM b
    UNION ALL SELECT token, CAST(length AS INTEGER), false FROM r WHERE k <= {size - len(HEX_BASE)}"""


_BASE = "(VALUES " + ", ".join(f"({i}, '{s.hex().upper()}')" for i, s in enumerate(HEX_BASE)) + ") AS b(id, token)"

SQL = {
    "byte_histogram": HISTOGRAM,
    "top_bytes": f"SELECT * FROM ({HISTOGRAM}) ORDER BY cnt DESC, byte LIMIT {Q.TOP}",
    "char_histogram": "SELECT CAST(unicode(c) AS INTEGER) AS code, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY c",
    "reserved_chars": """SELECT * FROM (
        SELECT CAST(unicode(c) AS INTEGER) AS code, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY c)
        WHERE code < 500 OR code BETWEEN 57344 AND 57375""",
    "hex_digit_counts": "SELECT digit, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(hex(encode(text))), '.')) AS digit FROM documents) GROUP BY digit",
    "bigram_pairs": f"""SELECT "left", "right", count(*) AS cnt FROM (
        SELECT b[i] AS "left", b[i + 1] AS "right" FROM (SELECT b, unnest(range(1, len(b))) AS i FROM (SELECT {BYTES} AS b FROM documents))) GROUP BY ALL""",
    "filter_reserved": "SELECT doc_id, regexp_replace(text, '[' || chr(16) || '-' || chr(23) || ']', chr(57344), 'g') AS text FROM documents",
    "filter_caps": _caps("text", "documents"),
    "filter_words": f"SELECT doc_id, {_words('text')} AS text FROM documents",
    "filter_caps_words": f"SELECT doc_id, {_words('text')} AS text FROM ({_caps('text', 'documents')})",
    "filter_lines_caps": _lines(_line_caps),
    "filter_lines_words": _lines(_line_words),
    "filter_lines_caps_words": _lines(lambda x: _line_caps(_line_words(x))),
    "tokenize_bytes_hex": _by_bytes(Q.HEX, _hex_fallback),
    "tokenize_bytes_bits": _by_bytes(Q.BITS, _bits_fallback),
    "tokenize_greedy": _greedy(),
    "token_counts": COUNTS,
    "token_stats": f"""
        WITH c AS ({COUNTS}), s AS (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS scanned_bytes FROM documents),
        t AS (SELECT CAST(sum(cnt) AS BIGINT) AS total_tokens, count(*) AS used_tokens, sum(cnt * log2(cnt)) AS weighted FROM c)
        SELECT CAST({len(Q.HEX)} AS BIGINT) AS ntokens, scanned_bytes, used_tokens, total_tokens,
          round(scanned_bytes / total_tokens, 9) AS bytes_per_token,
          round(total_tokens * {math.log2(len(Q.HEX))!r}::DOUBLE / scanned_bytes, 9) AS bits_per_byte,
          round((total_tokens * log2(total_tokens) - weighted) / scanned_bytes, 9) AS entropy_per_byte
        FROM t, s""",
    "token_stats_report": f"SELECT * FROM ({COUNTS}) ORDER BY cnt DESC, token LIMIT 200",
    "optimal_cost": _optimal_cost(),
    "optimal_tokens": _optimal_tokens(),
    "optimal_benchmark_counts": OPTIMAL_COUNTS,
    "optimal_benchmark_pairs": OPTIMAL_PAIRS,
    "optimal_benchmark_report": OPTIMAL_REPORT,
    "top_substrings": _top_substrings("documents", Q.TOP),
    "top_substrings_filtered": _top_substrings(f"(SELECT doc_id, {_words('text')} AS text FROM ({_caps('text', 'documents')}))", 2 * Q.TOP),
    "suffix_tokens": f"""
        SELECT l.token AS token, max_by(s.token, length(s.token)) AS suffix
        FROM {_vocabulary_rows("l")} JOIN {_vocabulary_rows("s")} ON length(l.token) > length(s.token) AND ends_with(l.token, s.token)
        GROUP BY l.token""",
    "vocab_build_top": f"""
        WITH r AS (SELECT byte, row_number() OVER (ORDER BY cnt DESC, byte) AS k FROM ({HISTOGRAM}) WHERE byte NOT IN (SELECT token FROM {_BASE}))
        SELECT CAST(id AS INTEGER) AS token_id, token, true AS mandatory FROM {_BASE}
        UNION ALL SELECT CAST({len(HEX_BASE) - 1} + k AS INTEGER), byte, false FROM r WHERE k <= {Q.BUILT - len(HEX_BASE)}""",
    "decoded_tokens": "SELECT conv_id, turn, text FROM conversations",
    "substring_vocabulary": _substring_vocabulary(32),
    "strip_headers": STRIP,
    "clean_text": _clean("documents"),
    "sample_pieces": SAMPLED,
    "prepare": f"SELECT doc_id, {_words('text')} AS text FROM ({_caps('text', '(' + _clean('(' + STRIP + ')') + ')')})",
    "merge_fragments": r"SELECT doc_id, body || chr(10) || chr(57363) AS fragment FROM (SELECT doc_id, regexp_extract(text, '(?s)\A(.*[^\s][^\n]*\n?)', 1) AS body FROM documents) WHERE body <> ''",
    "chunk_sample": "SELECT doc_id, text FROM documents WHERE doc_id % 4 = 0",
    "text_directories": """
        SELECT doc_id, array_to_string(regexp_extract_all(p[:length(p) - 1], '.'), '/') || '/' || doc_id AS directory
        FROM (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(2, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS p FROM documents)""",
}
