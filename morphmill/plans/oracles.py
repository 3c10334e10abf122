"""The queries' SQL: written by itself, with the character classes written out."""

from __future__ import annotations

from morphmill.plans.examples import HAN_VOWELS, MERGES

#: The pre-tokenizer's classes of letters, Han characters and digits, as the inside of a regex class.
LETTERS = (
    r"\x{41}-\x{5A}\x{61}-\x{7A}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{85F}\x{900}-\x{1FFF}\x{2E80}-\x{2FFF}\x{3040}-\x{33FF}\x{4DC0}-\x{4DFF}"
    r"\x{A000}-\x{D7FF}\x{FB00}-\x{FDFF}\x{FE70}-\x{FEFF}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FFDC}\x{10000}-\x{10FFF}"
)
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
#: White space and control characters, which aren't punctuation.
BLANKS = r"\x{00}-\x{20}\x{7F}-\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DIGITS = r"\x{30}-\x{39}\x{FF10}-\x{FF19}"
MARKS = f"[^▁{LETTERS}{DIGITS}{HAN}]"
#: Words with what stands before them, digits, Han runs, marks with a space before them, spaces; and all of them apart.
CUT = (f"(?:▁|{MARKS})?[{LETTERS}]+|[{DIGITS}]+|[{HAN}]+|▁?{MARKS}+|▁", f"[{LETTERS}]+(?:''[{LETTERS}]+)*|[{DIGITS}]+|[{HAN}]+|{MARKS}|▁")


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


def _norm(col: str) -> str:
    return f"rtrim(regexp_replace(ltrim({col}, ' '), ' +', '▁', 'g'), '▁')"


def _split(col: str, cut: int = 0) -> str:
    return f"regexp_extract_all({col}, '{CUT[cut]}')"


COUNTS = f"{LINES}, words AS (SELECT unnest({_split(_norm('line'))}) AS word FROM lines), counts AS (SELECT word, count(*) AS freq FROM words GROUP BY word)"
CHARS = "chars AS (SELECT c AS char, CAST(sum(freq) AS BIGINT) AS cnt FROM (SELECT unnest(string_split(word, '')) AS c, freq FROM {source}) GROUP BY c)"
COVERED = "ordered AS (SELECT char, cnt, coalesce(sum(cnt) OVER (ORDER BY cnt DESC, char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(cnt) OVER () AS total FROM chars), covered AS (SELECT char, cnt FROM ordered WHERE before / total < {coverage})"
PAIRS = """tokens AS (SELECT regexp_extract_all(hex(word), '..') AS t, freq FROM counts),
positions AS (SELECT t, freq, unnest(range(1, len(t))) AS i FROM tokens),
pairs AS (SELECT t[i] AS l, t[i + 1] AS r, CAST(sum(freq) AS BIGINT) AS cnt FROM positions GROUP BY 1, 2)"""


def _grams(most: int) -> str:
    return f"""h AS (SELECT hex(word) AS h, freq FROM counts), starts AS (SELECT h, freq, unnest(range(0, len(h) // 2)) AS i FROM h),
grams AS (SELECT CAST(k AS INTEGER) AS n, substr(h, 2 * i + 1, 2 * k) AS gram, CAST(sum(freq) AS BIGINT) AS cnt FROM starts, range(1, {most + 1}) AS s(k) WHERE i + k <= len(h) // 2 GROUP BY 1, 2)"""


def _merged_sql(start: str) -> str:
    for u, v in MERGES:
        u, v = u.encode().hex().upper(), v.encode().hex().upper()
        start = f"replace({start}, '<{u}><{v}>', '<{u}{v}>')"
    return start


def _source(x: str) -> str:
    """The byte of a line that byte ``x`` of its normalised hexadecimal ``h`` comes from: its character's, with sentinels as spaces."""
    back = " ".join(f"WHEN substr(h, 2 * ({x}) + {1 - 2 * k}, 2) NOT BETWEEN '80' AND 'BF' THEN {x} - {k}" for k in range(3))
    char = f"(CASE {back} ELSE {x} - 3 END)"
    prefix = f"substr(h, 1, 2 * {char})"
    return f"({char} - (length({prefix}) - length(replace({prefix}, 'E29681', ''))) // 3)"


#: Pieces of the small byte-pair model, one a row, and its ids.
PIECES = (
    LINES + ", joined AS (SELECT doc_id, line_no, " + _merged_sql(f"regexp_replace(hex({_norm('line')}), '(..)', '<\\1>', 'g')") + " AS p FROM lines), "
    "pieces AS (SELECT doc_id, line_no, unnest(l) AS piece, (generate_subscripts(l, 1) - 1)::INT AS pos FROM (SELECT doc_id, line_no, regexp_extract_all(p, '[0-9A-F]+') AS l FROM joined))"
)
VOCABULARY = (
    "vocabulary AS (SELECT CAST(i + 3 AS INTEGER) AS id, printf('%02X', i) AS piece FROM range(256) AS t(i) UNION ALL SELECT id, piece FROM (VALUES "
    + ", ".join(f"({259 + i}, '{(u + v).encode().hex().upper()}')" for i, (u, v) in enumerate(MERGES))
    + ") AS v(id, piece))"
)


def _hex(text: str) -> str:
    return text.encode().hex().upper()


#: The rows of special pieces, and of byte pieces after them.
META = "SELECT * FROM (VALUES (0, '3C756E6B3E', 2), (1, '3C733E', 3), (2, '3C2F733E', 3)) AS m(id, piece, type)"
BYTE_PIECES = "SELECT CAST(i + 3 AS INTEGER), hex('<0x' || printf('%02X', i) || '>'), 6 FROM range(256) AS t(i)"
#: A byte as the name of its byte piece, in hexadecimal.
BYTE_NAME = "'<3C3078' || hex({b}) || '3E>'"


def _char_pair_sql() -> str:
    """Letters as they are, other bytes as byte pieces; then the merges in their order."""
    start = f"array_to_string(list_transform(regexp_extract_all(hex({_norm('line')}), '..'), lambda b: CASE WHEN b BETWEEN '61' AND '7A' THEN '<' || b || '>' ELSE {BYTE_NAME.format(b='b')} END), '')"
    return f"WITH {LINES} SELECT doc_id, line_no, {_merged_sql(start)} AS pieces FROM lines"


def _ngram_sql() -> str:
    """The best cut of each distinct part, character by character; longer entries come first and must be beaten."""
    names = [u + v for u, v in MERGES] + [chr(97 + i) for i in range(26)] + ["▁", "▁the", "▁and"]
    entries = ", ".join(f"('{n}', {1000 - 7 * i})" for i, n in enumerate(names))
    way = [f"b{k - 1} + d{k}.w" for k in (4, 3, 2)] + ["b0 - 10.0", "b0 + d1.w"]
    best = "greatest(" + ", ".join(f"coalesce({w}, -1e300)" for w in way) + ")"
    taken = " ".join(f"WHEN {way[n]} = {best} THEN s{k - 1} || '<' || hex(substr(part, i + 2 - {k}, {k})) || '>'" for n, k in enumerate((4, 3, 2)))
    joins = " ".join(f"LEFT JOIN entries d{k} ON d{k}.name = substr(part, i + 2 - {k}, {k}) AND i + 1 >= {k}" for k in (1, 2, 3, 4))
    return f"""WITH RECURSIVE {LINES}, named AS (SELECT name, ln(score) - ln(sum(score) OVER ()) AS w FROM (VALUES {entries}) AS e(name, score)), entries AS MATERIALIZED (SELECT * FROM named),
parts AS MATERIALIZED (SELECT doc_id, line_no, unnest(p) AS part, generate_subscripts(p, 1) AS n FROM (SELECT doc_id, line_no, regexp_extract_all({_norm('line')}, '▁[^▁]*|[^▁]+') AS p FROM lines)),
ways AS (SELECT DISTINCT part, 0 AS i, 0.0::DOUBLE AS b0, -1e300::DOUBLE AS b1, -1e300::DOUBLE AS b2, -1e300::DOUBLE AS b3, '' AS s0, '' AS s1, '' AS s2, '' AS s3 FROM parts
UNION ALL SELECT part, i + 1, {best}, b0, b1, b2, CASE {taken} WHEN d1.name IS NOT NULL THEN s0 || '<' || hex(d1.name) || '>'
ELSE s0 || array_to_string(list_transform(regexp_extract_all(hex(substr(part, i + 1, 1)), '..'), lambda b: {BYTE_NAME.format(b='b')}), '') END, s0, s1, s2
FROM ways {joins} WHERE i < length(part)),
cuts AS MATERIALIZED (SELECT part, s0 FROM ways WHERE i = length(part))
SELECT lines.doc_id, lines.line_no, coalesce(string_agg(s0, '' ORDER BY n), '') AS pieces FROM lines LEFT JOIN parts ON parts.doc_id = lines.doc_id AND parts.line_no = lines.line_no LEFT JOIN cuts ON cuts.part = parts.part GROUP BY 1, 2"""


#: Bytes in hexadecimal as marked numbers.
NUMBERED = "array_to_string(list_transform(regexp_extract_all(hex({x}), '..'), lambda b: '<' || CAST('0x' || b AS INTEGER) || '>'), '')"
NEIGHBOURS = "SELECT CAST(x[i] AS INTEGER) AS l, CAST(x[i + 1] AS INTEGER) AS r, i, freq FROM (SELECT x, freq, unnest(range(1, len(x))) AS i FROM (SELECT regexp_extract_all(t, '[0-9]+') AS x, freq FROM w{k}))"


def _rounds(n: int, order: str, limit: str) -> str:
    """n merges, one by one: w has the words, s the symbols, p the round's pair."""
    out = ""
    for k in range(n):
        out += f""", p{k} AS MATERIALIZED (SELECT l, r, a.name || b.name AS name, a.name AS u, b.name AS v FROM (SELECT l, r, sum(freq) AS cnt, min(i) AS place FROM ({NEIGHBOURS.format(k=k)}) GROUP BY l, r) JOIN s{k} a ON a.id = l JOIN s{k} b ON b.id = r WHERE {limit} ORDER BY {order} LIMIT 1),
w{k + 1} AS MATERIALIZED (SELECT replace(t, '<' || l || '><' || r || '>', '<{256 + k}>') AS t, freq FROM w{k}, p{k}), s{k + 1} AS MATERIALIZED (SELECT * FROM s{k} UNION ALL SELECT {256 + k}, name FROM p{k})"""
    return out


def _train_byte_pair_sql(n: int = 24) -> str:
    merges = "".join(f" UNION ALL SELECT {259 + k}, name, {-256 - k}.0, 1, u, v FROM p{k}" for k in range(n))
    return f"""WITH {COUNTS}, w0 AS MATERIALIZED (SELECT {NUMBERED.format(x='word')} AS t, freq FROM counts WHERE freq >= 2), s0 AS MATERIALIZED (SELECT i AS id, printf('%02X', i) AS name FROM range(256) AS t(i))
{_rounds(n, "cnt DESC, greatest(l, r), l, r", "length(a.name) + length(b.name) <= 36")}
SELECT id, piece, 0.0::DOUBLE AS score, type, '' AS u, '' AS v FROM ({META}) UNION ALL SELECT CAST(i + 3 AS INTEGER), printf('%02X', i), CAST(-i AS DOUBLE), 1, '', '' FROM range(256) AS t(i){merges}"""


def _train_sequence_sql(n: int = 24) -> str:
    merges = "".join(f" UNION ALL SELECT {256 + k}, name, {-k}.0, 1, u, v FROM p{k}" for k in range(n))
    return f"""WITH corpus AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM benchmark), one AS (SELECT string_agg(line || chr(10), '' ORDER BY item_id, n) AS text FROM corpus WHERE line <> ''),
w0 AS MATERIALIZED (SELECT {NUMBERED.format(x='text')} AS t, 1 AS freq FROM one), s0 AS MATERIALIZED (SELECT i AS id, printf('%02X', i) AS name FROM range(256) AS t(i))
{_rounds(n, "cnt DESC, place", "cnt > 1")}
SELECT CAST(i AS INTEGER) AS id, printf('%02X', i) AS piece, 0.0::DOUBLE AS score, 6 AS type, '' AS u, '' AS v FROM range(256) AS t(i){merges}"""


def _train_char_pair_sql(size: int = 8000) -> str:
    """Pairs of characters, until characters and merges are ``size``; a string that is made again is passed over.

    The state has words, each symbol a code point from 20000 on; symbols, the characters in their order before the merges in
    theirs; and the counts of pairs that are short enough, null for those passed over. A step merges the best pairs, up to one
    with a symbol that is on its other side in a better pair, or with a string made before: none of them changes another's
    count, and a new pair is no more frequent than, and longer than, one of a symbol with what stands beside it, which comes
    after them. A pair of one symbol is alone, and so is each once some are passed over. Then words are rewritten, and what that changes is added to the counts.
    """
    pairs = "SELECT l, r, sum(n) AS d FROM (SELECT unicode(t[i]) AS l, unicode(t[i + 1]) AS r, n FROM (SELECT t, n, unnest(range(1, length(t))) AS i FROM {of})) GROUP BY l, r"
    short = "JOIN {symbols} u ON u.a = l JOIN {symbols} v ON v.a = r AND strlen(u.name || v.name) <= 18"
    return f"""WITH RECURSIVE {COUNTS}, kept AS MATERIALIZED (SELECT word, freq FROM counts WHERE freq >= 2), {CHARS.format(source='kept')}, {COVERED.format(coverage=0.9995)},
required AS MATERIALIZED (SELECT char, cnt, CAST(20000 + row_number() OVER (ORDER BY char) AS INTEGER) AS id FROM covered),
spelt AS MATERIALIZED (SELECT string_agg(chr(coalesce(required.id, 20000)), '' ORDER BY i) AS t, CAST(freq AS BIGINT) AS n FROM (SELECT word, freq, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM kept) LEFT JOIN required ON required.char = c GROUP BY word, freq),
letters AS (SELECT id AS a, char AS name FROM required),
state(kind, a, b, name, n) USING KEY (kind, a, b) AS (
SELECT 'word', CAST(row_number() OVER () AS INTEGER), 0, t, n FROM spelt WHERE length(t) > 1
UNION ALL SELECT 'symbol', a, 0, name, 0 FROM letters
UNION ALL SELECT 'pair', l, r, '', CAST(d AS BIGINT) FROM ({pairs.format(of='spelt')}) {short.format(symbols='letters')}
UNION (WITH symbols AS MATERIALIZED (SELECT a, name FROM recurring.state WHERE kind = 'symbol'), known AS MATERIALIZED (SELECT a, b, n FROM recurring.state WHERE kind = 'pair'),
frequent AS (SELECT a AS l, b AS r, n FROM known WHERE n > 0 AND n >= (SELECT min(n) FROM (SELECT n FROM known WHERE n > 0 ORDER BY n DESC LIMIT 64))),
best AS (SELECT l, r, n, u.name || v.name AS name FROM frequent JOIN symbols u ON u.a = l JOIN symbols v ON v.a = r ORDER BY n DESC, length(u.name || v.name), u.name || v.name, l, r LIMIT 64),
ranked AS MATERIALIZED (SELECT l, r, name, name IN (SELECT name FROM symbols) AS again, row_number() OVER (ORDER BY n DESC, length(name), name, l, r) AS k FROM best),
step AS MATERIALIZED (SELECT chr(l) || chr(r) AS two, l, r, name, again, CAST(20000 + k + (SELECT count(*) FROM symbols) AS INTEGER) AS id FROM ranked WHERE k + (SELECT count(*) FROM symbols) <= {size} AND k <
(SELECT coalesce(min(c.k), 65) FROM ranked c WHERE c.k > 1 AND (c.again OR c.l = c.r OR EXISTS (SELECT 1 FROM known WHERE n IS NULL) OR EXISTS (SELECT 1 FROM ranked e WHERE e.k < c.k AND (e.r = c.l OR e.l = c.r OR e.l = e.r OR e.again OR e.name = c.name))))),
merges AS MATERIALIZED (SELECT list(two || chr(id) ORDER BY id) AS m FROM step WHERE NOT again),
changed AS MATERIALIZED (SELECT * FROM (SELECT a, w.name AS old, list_reduce(m, lambda t, x: replace(t, x[1:2], x[3]), w.name) AS t, n FROM recurring.state w, merges WHERE m IS NOT NULL AND kind = 'word') WHERE t <> old),
extended AS MATERIALIZED (SELECT a, name FROM symbols UNION ALL SELECT id, name FROM step WHERE NOT again),
differences AS (SELECT l, r, d, known.a IS NOT NULL AS old, n FROM ({pairs.format(of='(SELECT old AS t, -n AS n FROM changed UNION ALL SELECT t, n FROM changed)')}) LEFT JOIN known ON known.a = l AND known.b = r)
SELECT 'word', a, 0, t, n FROM changed
UNION ALL SELECT 'symbol', id, 0, name, 0 FROM step WHERE NOT again
UNION ALL SELECT 'pair', l, r, '', NULL FROM step WHERE again
UNION ALL SELECT 'pair', l, r, '', CAST(CASE WHEN old THEN n + d ELSE d END AS BIGINT) FROM differences {short.format(symbols='extended')} WHERE d <> 0)),
made AS (SELECT name, row_number() OVER (ORDER BY a) - 1 AS k FROM state WHERE kind = 'symbol' AND a > (SELECT 20000 + count(*) FROM required)),
learned AS (SELECT name, k FROM made UNION ALL SELECT char, (SELECT count(*) FROM made) + row_number() OVER (ORDER BY cnt DESC, char) - 1 FROM required)
SELECT id, piece, 0.0::DOUBLE AS score, type, '' AS u, '' AS v FROM ({META} UNION ALL {BYTE_PIECES}) UNION ALL SELECT CAST(259 + k AS INTEGER), hex(name), CAST(-k AS DOUBLE), 1, '', '' FROM learned WHERE k < {size}"""


def oracle_sql() -> dict[str, str]:
    tokens = "SELECT doc_id, line_no, array_to_string({split}, ' ') AS tokens FROM lines"
    wrapped = "regexp_replace(hex({x}), '(..)', '<\\1>', 'g')"
    heading = "regexp_replace(text, '(?m)^#+\\s+[^\\n]*$', '', 'g')"
    spaced = "concat('  ', replace(line, ' ', '   '), '▁ ')"
    digits = "regexp_matches(c, '^[" + DIGITS + "]$')"
    return {
        "raw_count": f"WITH {COUNTS} SELECT word, freq FROM counts",
        "raw_count_maxbytes": f"WITH {COUNTS} SELECT word, freq FROM counts WHERE strlen(word) <= 12",
        "pretokenize_cut0": f"WITH {LINES} " + tokens.format(split=_split(_norm("line"))),
        "pretokenize_cut1": f"WITH {LINES} " + tokens.format(split=_split(_norm("line"), 1)),
        "pretokenize_reconstruct": f"WITH {LINES} " + tokens.format(split=_split("replace(line, ' ', '▁')")),
        "normalize": f"WITH {LINES} SELECT doc_id, line_no, {_norm(spaced)} AS line FROM lines",
        "restore_spaces": f"SELECT conv_id, turn, replace({_norm('text')}, '▁', ' ') AS text FROM conversations",
        "space_runs": f"WITH {LINES}, spaced AS (SELECT doc_id, line_no, '  ' || replace(replace(line, ' ', '   '), ',', chr(9) || ' ▁') || ' ▁ ' AS line FROM lines) SELECT doc_id, line_no, {_norm('line')} AS merged, replace(line, ' ', '▁') AS kept, array_to_string({_split(_norm('line'))}, ' ') AS tokens FROM spaced",
        "word_min_count": f"WITH {COUNTS} SELECT word, freq FROM counts WHERE freq >= 32",
        "first_n_lines": f"WITH {LINES} SELECT doc_id, line_no, line FROM lines WHERE line <> '' ORDER BY doc_id, line_no LIMIT 100",
        "char_freq": f"WITH {COUNTS}, {CHARS.format(source='counts')} SELECT char, cnt FROM chars",
        "char_coverage": f"WITH {COUNTS}, {CHARS.format(source='counts')}, {COVERED.format(coverage=0.9995)} SELECT char, cnt FROM covered",
        "words_with_unk": f"WITH {COUNTS}, kept AS (SELECT row_number() OVER () AS k, word, freq FROM counts WHERE freq >= 2), {CHARS.format(source='kept')}, {COVERED.format(coverage=0.99)}, parts AS (SELECT k, word, freq, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM kept) SELECT string_agg(CASE WHEN covered.char IS NULL THEN '▅' ELSE c END, '' ORDER BY i) AS word, freq FROM parts LEFT JOIN covered ON covered.char = parts.c GROUP BY k, freq",
        "pair_counts": f"WITH {COUNTS}, {PAIRS} SELECT l, r, cnt FROM pairs",
        "best_pair": f"WITH {COUNTS}, {PAIRS} SELECT l, r, cnt FROM pairs ORDER BY cnt DESC, greatest(l, r), l, r LIMIT 1",
        "byte_ngrams": f"WITH {COUNTS}, {_grams(6)} SELECT n, gram, cnt FROM grams",
        "ngram_logprob": f"""WITH {COUNTS}, {_grams(6)}, ones AS (SELECT 1 AS n, every.gram, coalesce(grams.cnt, 1) AS cnt FROM (SELECT printf('%02X', i) AS gram FROM range(256) AS t(i)) every LEFT JOIN grams ON grams.n = 1 AND grams.gram = every.gram),
kept AS (SELECT * FROM ones UNION ALL SELECT n, gram, cnt FROM grams WHERE n > 1 AND cnt >= 32)
SELECT a.n, a.gram, a.cnt, round(ln(a.cnt) - ln(CASE WHEN a.n = 1 THEN (SELECT sum(cnt) FROM ones) ELSE b.cnt END), 9) AS logp FROM kept a LEFT JOIN kept b ON b.n = a.n - 1 AND b.gram = substr(a.gram, 1, 2 * (a.n - 1))""",
        "sentences": """WITH marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([。！？])', '\\1' || chr(1), 'g'), '([.!?])(\\s|$)', '\\1' || chr(1) || '\\2', 'g') AS t FROM documents),
parts AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM marked)
SELECT doc_id, generate_subscripts(p, 1) - 1 AS n, unnest(p) AS sentence FROM parts""",
        "clean_text": f"""WITH d AS (SELECT doc_id, '## title' || chr(10) || replace(text, '. ', '.' || chr(10) || '# a b' || chr(10) || ' ' || chr(9)) AS text FROM documents),
c AS (SELECT doc_id, trim(regexp_replace({heading}, '\\s+', ' ', 'g')) AS text FROM d) SELECT doc_id, text FROM c WHERE text <> ''""",
        "strip_headings": f"WITH d AS (SELECT doc_id, '#' || chr(10) || 'first' || chr(10) || text || chr(10) || '### last' AS text FROM documents) SELECT doc_id, {heading} AS text FROM d",
        "ascii_words": f"WITH {COUNTS} SELECT word, freq FROM counts WHERE regexp_matches(word, '^[A-Za-z][A-Za-z]+$')",
        "byte_pieces": f"WITH {COUNTS}, b AS (SELECT unnest(regexp_extract_all(hex(word), '..')) AS h, freq FROM counts) SELECT ('0x' || h)::BIGINT AS byte, '<0x' || h || '>' AS piece, ('0x' || h)::BIGINT AS back, sum(freq)::BIGINT AS cnt FROM b GROUP BY h",
        "vocab_layout": f"WITH {COUNTS}, {CHARS.format(source='counts')}, {COVERED.format(coverage=0.9995)} SELECT 0 AS id, '<unk>' AS piece, 2 AS type UNION ALL SELECT 1, '<s>', 3 UNION ALL SELECT 2, '</s>', 3 UNION ALL SELECT CAST(i + 3 AS INTEGER), '<0x' || printf('%02X', i) || '>', 6 FROM range(256) AS t(i) UNION ALL SELECT CAST(258 + row_number() OVER (ORDER BY cnt DESC, char) AS INTEGER), char, 1 FROM covered",
        "extra_tokens": """WITH l AS (SELECT '<' || lang || '>' AS piece, row_number() OVER (ORDER BY lang) AS n FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT id, piece, 264 + (SELECT count(*) FROM l)::INT AS vocab_size, 263 AS pad_id FROM (VALUES (1, '<s>'), (2, '</s>'), (263, '<pad>')) AS v(id, piece) UNION ALL SELECT (263 + n)::INT, piece, 264 + (SELECT count(*) FROM l)::INT, 263 FROM l""",
        "piece_to_id": f"WITH {COUNTS}, vocabulary AS (SELECT CAST(i + 3 AS INTEGER) AS id, printf('%02X', i) AS piece FROM range(256) AS t(i) UNION ALL SELECT id, piece FROM (VALUES " + ", ".join(f"({259 + i}, '{(u + v).encode().hex().upper()}')" for i, (u, v) in enumerate(MERGES)) + ") AS v(id, piece)), best AS (SELECT piece, max(id) AS id FROM vocabulary GROUP BY piece) SELECT hex(word) AS piece, freq, coalesce(id, 0) AS id FROM counts LEFT JOIN best ON best.piece = hex(word)",
        "char_classes": f"SELECT id // 256 AS block, han, word, digit, punctuation, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids, CAST(sum(hits) AS BIGINT) AS docs, CAST(sum(id * hits) AS BIGINT) AS doc_ids FROM (SELECT id, hits, regexp_matches(c, '^[{HAN}]$') AS han, regexp_matches(c, '^[{LETTERS}{HAN}{DIGITS}]$') AS word, {digits} AS digit, regexp_matches(c, '^[^{LETTERS}{HAN}{DIGITS}{BLANKS}]$') AS punctuation FROM (SELECT i AS id, coalesce(hits, 0) AS hits, chr(CAST(i AS INTEGER)) AS c FROM range(1, 1114112) AS t(i) LEFT JOIN (SELECT (doc_id * 7919 + n_chars * 104729) % 1114111 + 1 AS p, count(*) AS hits FROM documents GROUP BY p) ON p = i WHERE i NOT BETWEEN 55296 AND 57343)) GROUP BY ALL",
        "escape": "SELECT doc_id, replace(replace(replace(replace(text || '\\' || chr(9) || chr(13), '\\', '\\x5C'), chr(9), '\\x09'), chr(10), '\\x0A'), chr(13), '\\x0D') AS text FROM documents",
        "encode_byte_pair": f"WITH {LINES} SELECT doc_id, line_no, " + _merged_sql(wrapped.format(x=_norm("line"))) + " AS pieces FROM lines",
        "encode_sequence": f"WITH {LINES} SELECT doc_id, line_no, " + _merged_sql(wrapped.format(x="line")) + " AS pieces FROM lines",
        "decode_round_trip": f"SELECT conv_id, turn, replace({_norm('text')}, '▁', ' ') AS text FROM conversations",
        "han_split": f"WITH {LINES}, h AS (SELECT doc_id, line_no, translate({_norm('line')}, 'aeiou', '{HAN_VOWELS}') AS line FROM lines) SELECT doc_id, line_no, array_to_string(flatten(list_transform({_split('line')}, lambda t: CASE WHEN regexp_matches(t, '^[{HAN}]') THEN string_split(t, '') ELSE [t] END)), ' ') AS tokens FROM h",
        "han_dictionary": """WITH d AS (SELECT doc_id, substring(text, 1, 3) AS word, CASE doc_id % 6 WHEN 1 THEN -n_chars WHEN 2 THEN n_chars + 0.5 ELSE n_chars END::DOUBLE AS freq FROM documents WHERE doc_id % 6 <> 0 AND text <> '')
SELECT word, arg_min(freq, doc_id) AS freq FROM d WHERE freq > 0 GROUP BY word""",
        "encode_char_pair": _char_pair_sql(),
        "encode_ngram": _ngram_sql(),
        "decode_char_pair": f"SELECT conv_id, turn, replace({_norm('text')}, '▁', ' ') AS text FROM conversations",
        "decode_ngram": f"SELECT conv_id, turn, replace({_norm('text')}, '▁', ' ') AS text FROM conversations",
        "decode_sequence": "SELECT conv_id, turn, text FROM conversations",
        "han_dictionary_split": f"""WITH {LINES}, h AS (SELECT doc_id, line_no, regexp_replace(translate({_norm('line')}, 'aeiou', '{HAN_VOWELS}'), '([{HAN_VOWELS}]{{2}})', '\\1-', 'g') AS line FROM lines)
SELECT doc_id, line_no, array_to_string(flatten(list_transform({_split('line')}, lambda t: CASE WHEN regexp_matches(t, '^[{HAN}]') AND t NOT IN ('英国', '国人', '人是') THEN string_split(t, '') ELSE [t] END)), ' ') AS tokens FROM h""",
        "unicode_normalize": "SELECT doc_id, replace(lower(text), 'ß', 'ss') AS text FROM documents",
        "model_round_trip": _train_byte_pair_sql(),
        "train_byte_pair": _train_byte_pair_sql(),
        "train_char_pair": _train_char_pair_sql(),
        "train_sequence": _train_sequence_sql(),
        "unescape": "SELECT doc_id, text || '\\' || chr(9) || chr(13) AS text FROM documents",
        "repair_utf8": f"WITH {LINES} SELECT doc_id, line_no, line || '\ufffd' || substring(line, 1, 5) || '\ufffd\ufffd' AS text FROM lines",
        "offset_map": f"""WITH {LINES}, chars AS (SELECT doc_id, line_no, unnest(string_split(line, '')) AS c, generate_subscripts(string_split(line, ''), 1) AS i FROM lines WHERE line <> ''),
sized AS (SELECT *, CASE WHEN c = ' ' THEN 3 ELSE strlen(c) END AS n FROM chars), placed AS (SELECT *, 2 + sum(n) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS e FROM sized),
told AS (SELECT doc_id, line_no, string_agg(rtrim(repeat((e - n)::BIGINT || ',', n), ','), ',' ORDER BY i) || ',' || max(e)::BIGINT AS offsets FROM placed GROUP BY doc_id, line_no)
SELECT lines.doc_id, lines.line_no, {_norm('line')} AS text, coalesce(offsets, '') AS offsets FROM lines LEFT JOIN told ON told.doc_id = lines.doc_id AND told.line_no = lines.line_no""",
        "tokenize_lines": f"WITH {PIECES}, told AS (SELECT doc_id, line_no, string_agg(CASE WHEN piece >= '80' OR piece IN ('09', '0A', '0D', '5C') THEN '\\x' || piece ELSE decode(unhex(piece)) END, ' ' ORDER BY pos) AS value FROM pieces GROUP BY doc_id, line_no) SELECT lines.doc_id, lines.line_no, coalesce(value, '') AS value FROM lines LEFT JOIN told ON told.doc_id = lines.doc_id AND told.line_no = lines.line_no",
        "numbered_lines": f"WITH {LINES} SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS number, line FROM lines WHERE line <> ''",
        "model_source": _train_byte_pair_sql(),
        "sql_encode": f"WITH {LINES} SELECT doc_id, line_no, {_merged_sql(wrapped.format(x=_norm('line')))} AS pieces, array_to_string({_split(_norm('line'))}, ' ') AS tokens, replace({_norm('line')}, '▁', ' ') AS text FROM lines",
        "sql_pieces": f"WITH {PIECES}, {VOCABULARY} SELECT p.piece, id, count(*) AS n, min(pos) AS first FROM pieces p JOIN vocabulary v ON v.piece = p.piece GROUP BY p.piece, id",
        "merge_rank_table": """WITH d AS (SELECT doc_id::INT AS id, substring(text, 1, 1 + doc_id % 4) AS piece, substring(text, 1, 1) AS u, substring(text, 2, 1 + doc_id % 2) AS v FROM documents),
l AS (SELECT d.id, x.id AS l FROM d ASOF JOIN d x ON x.piece = d.u AND d.id >= x.id WHERE d.u <> '' AND d.v <> ''), r AS (SELECT d.id, x.id AS r FROM d ASOF JOIN d x ON x.piece = d.v AND d.id >= x.id WHERE d.u <> '' AND d.v <> '')
SELECT l, r, max(l.id) AS id FROM l JOIN r ON r.id = l.id GROUP BY l, r""",
        "token_spans": f"""WITH {PIECES}, ends AS (SELECT doc_id, line_no, pos, sum(length(piece) // 2) OVER (PARTITION BY doc_id, line_no ORDER BY pos)::BIGINT AS e, length(piece) // 2 AS n FROM pieces),
placed AS (SELECT ends.doc_id, ends.line_no, pos, e, e - n AS s, hex({_norm('line')}) AS h FROM ends JOIN lines ON lines.doc_id = ends.doc_id AND lines.line_no = ends.line_no),
told AS (SELECT doc_id, line_no, string_agg({_source('s')} || ':' || {_source('e')}, ',' ORDER BY pos) AS spans FROM placed GROUP BY doc_id, line_no)
SELECT lines.doc_id, lines.line_no, coalesce(spans, '') AS spans, line AS text FROM lines LEFT JOIN told ON told.doc_id = lines.doc_id AND told.line_no = lines.line_no""",
        "frequency_lines": f"WITH {COUNTS} SELECT word || chr(9) || freq AS value FROM counts WHERE freq >= 2",
    }
