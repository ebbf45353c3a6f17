"""SQL of the queries that SQL can express."""

from __future__ import annotations

from kith.llm.chat import ChatOptions
from kith.llm.mixing import MixOptions
from kith.llm.quality import CLASSES, FAULTS, PRIOR, WEIGHT, start

_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all(coalesce({lower}, ''), '{_TERM}')"


def chat_sql(o: ChatOptions = ChatOptions()) -> str:
    stride = o.budget // 2
    escaped = lambda c, marks: f"(length({c}) + length({c}) - length(translate({c}, '{marks}', '')))"
    return rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, len(regexp_extract_all(text, '{_WORD}')) + {o.overhead} AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    6 + {escaped('role', chr(92) + '<#:')} + {escaped('text', chr(92) + '<#')} + 8 AS chars
  FROM given),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) - tokens AS start FROM t),
f AS (SELECT *, min(start) OVER (PARTITION BY conv_id, start // {stride}) AS first FROM s),
w AS (SELECT *, CASE WHEN start > first AND start + tokens - first > {o.budget} THEN start ELSE first END AS win FROM f),
heads AS (SELECT DISTINCT conv_id, win FROM w WHERE win > 0),
sys AS (SELECT conv_id, min(i) AS i FROM w WHERE role = 'system' GROUP BY conv_id),
repeated AS (
  SELECT h.conv_id, h.win, w.i FROM heads h JOIN w ON w.conv_id = h.conv_id AND w.start < h.win AND h.win <= w.start + {o.history} AND w.win <> h.win
  UNION SELECT h.conv_id, h.win, sys.i FROM heads h JOIN sys USING (conv_id) JOIN w ON w.conv_id = h.conv_id AND w.i = sys.i WHERE w.win <> h.win),
extra AS (SELECT r.conv_id, sum(w.chars) AS chars FROM repeated r JOIN w ON w.conv_id = r.conv_id AND w.i = r.i GROUP BY r.conv_id)
SELECT w.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY w.i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{o.target}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY w.i) FILTER (WHERE role = '{o.target}'), '')) AS loss_sha256,
  CAST(sum(w.chars) + coalesce(any_value(extra.chars), 0) AS BIGINT) AS formatted_chars, count(DISTINCT win) AS n_windows
FROM w LEFT JOIN extra ON extra.conv_id = w.conv_id GROUP BY w.conv_id"""


def hash60_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


def mixing_sql(o: MixOptions = MixOptions()) -> str:
    seed = f"'{o.seed}'"
    weights = f"[{', '.join(map(str, o.weights))}]"
    return rf"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size,
    {hash60_sql(seed, 'doc_id')} AS h, {hash60_sql(seed, 'doc_id')} % {o.blocks} AS block
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * {o.cap} AS cap FROM s0),
s2 AS (SELECT *, {weights}[(rank - 1) % {len(o.weights)} + 1] AS weight FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rank) AS k FROM s2),
s4 AS (SELECT *, CAST((SELECT sum(source_size) FROM s0) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_,
    CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights FROM s3),
lv AS (SELECT k, left_, weights FROM s4 WHERE left_ * weight <= cap * weights ORDER BY k LIMIT 1),
goals AS (SELECT source, source_size, CASE WHEN s4.k < lv.k THEN CAST(cap AS DOUBLE) ELSE CAST(weight * lv.left_ AS DOUBLE) / lv.weights END AS target FROM s4, lv),
b0 AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words FROM rows_ GROUP BY source, block),
b1 AS (SELECT *, CAST(sum(words) OVER (PARTITION BY source ORDER BY {hash60_sql(seed, "'block'", "coalesce(source, '')", 'block')}, block) AS BIGINT) - words AS before FROM b0),
b2 AS (SELECT b1.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS passes
  FROM b1 JOIN goals ON b1.source IS NOT DISTINCT FROM goals.source),
b3 AS (SELECT *, target - passes * source_size - before AS room FROM b2),
d AS (SELECT r.doc_id, r.size, source_size, target, passes, room, words,
    CAST(sum(r.size) OVER (PARTITION BY r.source, r.block ORDER BY r.h, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM rows_ r JOIN b3 ON r.source IS NOT DISTINCT FROM b3.source AND r.block = b3.block)
SELECT doc_id, size, source_size, target,
  size * (passes + CASE WHEN room <= 0 THEN 0 WHEN room >= words THEN 1 WHEN upto - size / 2 <= room THEN 1 ELSE 0 END) AS taken
FROM d"""


def quality_sql(rounds: int = 10) -> str:
    """The statistics, the votes, and the rounds of estimation one by one."""
    share = lambda part, whole="n_words": f"({part} / greatest({whole}, 1))"
    rules = [
        ("false", f"{share('n_symbols')} > 0.1"),
        ("false", f"{share('n_upper', 'word_chars')} > 0.4"),
        ("false", f"{share('n_exclaim')} > 0.25"),
        ("false", f"{share('n_repeat_words')} > 0.2"),
        ("false", "n_words >= 20 AND n_distinct < sqrt(n_words)"),
        ("false", f"({share('word_chars')} < 2 OR {share('word_chars')} > 20)"),
        ("false", f"n_lines >= 4 AND {share('n_dup_lines', 'n_lines')} > 0.3"),
        ("false", "n_words < 10"),
        (f"{share('n_ends')} BETWEEN 0.01 AND 0.34", "false"),
    ]
    letters = " || ".join(f"CASE WHEN ({g}) AND NOT ({b}) THEN 'g' WHEN ({b}) AND NOT ({g}) THEN 'b' ELSE 'a' END" for g, b in rules)
    values = lambda rows: ", ".join(f"({', '.join(map(str, r))})" for r in rows)
    first = [(c, PRIOR if c < 0 else (1 - PRIOR) / len(FAULTS)) for c in CLASSES]
    table = [(c, j + 1, f"'{m}'", start(c, j)[k]) for c in CLASSES for j in range(len(rules)) for k, m in enumerate("gba")]
    ctes = [f"q0(c, prior) AS (VALUES {values(first)})", f"s0(c, j, m, v) AS (VALUES {values(table)})", "e0 AS (SELECT * FROM s0)"]
    for r in range(rounds + 1):
        ctes.append(f"l{r} AS (SELECT votes, n, e.c, any_value(ln(prior)) + sum(ln(v)) AS l FROM patterns JOIN e{r} e ON substr(votes, e.j, 1) = e.m "
                    f"JOIN q{r} q ON q.c = e.c GROUP BY votes, n, e.c)")
        ctes.append(f"x{r} AS (SELECT votes, n, c, exp(l - max(l) OVER w) AS x FROM l{r} WINDOW w AS (PARTITION BY votes))")
        ctes.append(f"p{r} AS (SELECT votes, n, c, x / sum(x) OVER (PARTITION BY votes) AS p FROM x{r})")
        if r < rounds:
            ctes.append(f"q{r + 1} AS (SELECT c, (sum(n * p) + 1) / ((SELECT sum(n) FROM patterns) + {len(CLASSES)}) AS prior FROM p{r} GROUP BY c)")
            ctes.append(f"e{r + 1} AS (SELECT s.c, s.j, s.m, (coalesce(sum(n * p) FILTER (WHERE substr(votes, s.j, 1) = s.m), 0) + {WEIGHT} * s.v) "
                        f"/ (sum(n * p) + {WEIGHT}) AS v FROM s0 s JOIN p{r} ON p{r}.c = s.c GROUP BY s.c, s.j, s.m, s.v)")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 4], 'string_agg', chr(10)) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) > 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest(range(0, 5)) AS o FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct,
    len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, length(t) - length(translate(t, '!', '')) AS n_exclaim,
    len(list_filter(ws, lambda x: right(x, 1) IN ('.', '!', '?'))) AS n_ends
  FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {letters} AS votes FROM m),
patterns AS (SELECT votes, count(*) AS n FROM v GROUP BY votes),
{', '.join(c.replace(' AS (', ' AS MATERIALIZED (', 1) for c in ctes)},
final AS (SELECT votes, p FROM p{rounds} WHERE c = -1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept
FROM v JOIN final USING (votes)"""


def sharding_sql(limit: int) -> str:
    """The definition itself: the shortest prefix of a row's hash whose rows fit, tried depth by depth."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    {hash60_sql('doc_id', "md5(coalesce(text, ''))")} AS h FROM documents),
t AS (SELECT *, unnest(range(0, 61)) AS depth FROM d),
p AS (SELECT *, h >> (60 - depth) AS bits, CAST(sum(n_bytes) OVER (PARTITION BY depth, h >> (60 - depth)) AS BIGINT) AS bytes FROM t)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, bits, 0 AS chain
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS r FROM p WHERE bytes <= {limit}) WHERE r = 1"""


def search_sql(top: int = 10, b: int = 75) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms('text')} AS ts FROM documents),
n AS (SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM n) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {b} + ({b} * n.n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), total GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN n USING (r) WHERE score > 0)
WHERE rank <= {top}"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC of an ASCII text, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {step}), 4294967295)"


def manifest_sql(levels: int = 8, tops: int = 4) -> str:
    """The trees level by level; ``levels`` and ``tops`` are enough for 8^levels rows of a language and 8^tops languages."""
    framed = lambda v: f"coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"""d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(lower)} END AS found FROM documents)""",
            """p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)""",
            """l0 AS (SELECT g, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p)""",
            """c0 AS (SELECT doc_id, g, pos, leaf, coalesce(found, leaf) AS x, '' AS sibs FROM p)"""]

    def climb(first, last, nodes, chain):
        for i in range(first, last):
            ctes.append(f"r{i} AS MATERIALIZED (SELECT g, pos // 8 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {nodes} GROUP BY 1, 2)")
            ctes.append(f"l{i + 1} AS (SELECT g, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n FROM r{i})")
            left, right = f"array_to_string(hs[:{chain}.pos % 8], '')", f"array_to_string(hs[{chain}.pos % 8 + 2:], '')"
            ctes.append(f"""c{i + 1} AS (SELECT {chain}.* EXCLUDE (pos, x, sibs), {chain}.pos // 8 AS pos, CASE WHEN n > 1 THEN sha256({left} || x || {right}) ELSE x END AS x,
                sibs || CASE WHEN n > 1 THEN {left} || {right} ELSE '' END AS sibs FROM {chain} JOIN r{i} ON r{i}.g = {chain}.g AND run = {chain}.pos // 8)""")
            nodes, chain = f"l{i + 1}", f"c{i + 1}"
        return nodes, chain

    nodes, chain = climb(0, levels, "l0", "c0")
    ctes.append(f"t AS (SELECT 0 AS g, g AS pos, h, count(*) OVER () AS n FROM {nodes})")
    ctes.append(f"u AS (SELECT {chain}.doc_id, leaf, t.h AS subroot, 0 AS g, t.pos, x, sibs FROM {chain} JOIN t ON t.pos = {chain}.g)")
    nodes, chain = climb(levels + 1, levels + 1 + tops, "t", "u")
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, h AS root, sha256(sibs) AS proof_sha256, x AS folded_root, x = h AS verified FROM {chain}, {nodes}"""


def decontamination_sql(phrase: int = 10) -> str:
    """Every run of words of every length that a phrase has, beside the phrases."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms('text')} AS ws FROM documents),
b AS (SELECT item_id, {_terms('text')} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), {phrase}) AS k, array_to_string(ws[i:i + {phrase} - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {phrase} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
g AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(ws) >= k)),
f AS (SELECT r, g.i, g.k, item_id FROM g JOIN p ON p.k = g.k AND p.phrase = g.phrase),
hits AS (SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, unnest(range(0, k)) AS o FROM (SELECT DISTINCT r, i, k FROM f)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM f WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""
