"""SQL counterparts of the training-data queries that SQL can express."""

from gridlens.llm import feistel_shards as fs
from gridlens.llm import line_rules as lr
from gridlens.llm import merkle as mk
from gridlens.llm import secret_scan as ss
from gridlens.llm import sorted_lists as sl


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def op2_line_rules() -> str:
    symbols = "[^" + "".join("\\" + c for c in lr.SYMBOLS) + "]"
    separators = ", ".join(_text(s.decode()) for s in sorted(lr.SEPARATORS))
    menu = ", ".join(map(_text, sorted(lr.MENU)))
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    word = r"'[^\x20\x09-\x0D]+'"
    steps = ", ".join(str(i) for i in range(lr.WINDOW))
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
worded AS (SELECT r, doc_id, t, regexp_extract_all(t, {word}) AS w FROM texts),
windows AS (SELECT r, i, array_to_string(w[i : i + {lr.WINDOW - 1}], ' ') AS s
            FROM (SELECT r, w, unnest(range(1, len(w) - {lr.WINDOW - 2})) AS i FROM worded)),
repeated AS (SELECT r, count(DISTINCT i + step) AS n
             FROM (SELECT r, i, unnest([{steps}]) AS step
                   FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1) GROUP BY r),
lines AS (SELECT r, line, w, len(w) AS n, length(array_to_string(w, '')) AS chars,
                 length(regexp_replace(line, '{symbols}', '', 'g')) AS symbols,
                 length(regexp_replace(line, '[^!?]', '', 'g')) AS calls,
                 len(list_filter(w, lambda x: x IN ({separators}))) AS separators, lower(trim(line, {white})) AS plain
          FROM (SELECT r, line, regexp_extract_all(line, {word}) AS w
                FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts)) WHERE len(w) > 0),
ruled AS (SELECT *, separators >= {lr.MIN_SEPARATORS} AND separators >= {lr.SEPARATOR_SHARE} * n AS is_row,
                 symbols > {lr.SYMBOL_SHARE} * n OR calls > greatest(1.0, {lr.SYMBOL_SHARE} * n) OR NOT regexp_matches(line, '\\pL') AS is_odd
          FROM lines),
judged AS (SELECT *, CASE WHEN is_odd AND NOT is_row THEN 'punctuation' WHEN is_odd THEN 'navigation'
                          WHEN n >= {lr.LONG_LINE} AND NOT regexp_matches(line, {_text(lr.MARKS.pattern)}) THEN 'punctuation'
                          WHEN is_row OR n <= 3 AND plain IN ({menu}) THEN 'navigation'
                          WHEN phrase_words > 0 AND phrase_words >= {lr.PHRASE_SHARE} * n THEN 'boilerplate' END AS rule
           FROM (SELECT *, coalesce(list_sum(list_transform(regexp_extract_all(plain, {_text(lr.PHRASES.pattern)}),
                                                            lambda p: len(regexp_extract_all(p, {word})))), 0) AS phrase_words FROM ruled)),
by_text AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(chars) FILTER (WHERE rule IS NOT NULL) AS lost,
                   count(*) FILTER (WHERE rule = 'punctuation') AS punctuation_lines,
                   count(*) FILTER (WHERE rule = 'navigation') AS navigation_lines,
                   count(*) FILTER (WHERE rule = 'boilerplate') AS boilerplate_lines FROM judged GROUP BY r),
facts AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                 length(regexp_replace(t, '{symbols}', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                 coalesce(n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(punctuation_lines, 0) AS punctuation_lines,
                 coalesce(navigation_lines, 0) AS navigation_lines, coalesce(boilerplate_lines, 0) AS boilerplate_lines
          FROM worded LEFT JOIN repeated USING (r) LEFT JOIN by_text USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {lr.MIN_WORDS} OR 100 * n_repeat_words > {lr.MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {lr.MIN_WORDS} OR 100 * n_repeat_words > {lr.MAX_REPEATED} * n_words) AND lost <= {lr.MAX_LOST} * word_chars AS kept,
       punctuation_lines, navigation_lines, boilerplate_lines
FROM facts"""


#: Remainder of the polynomial of CRC-32 for each byte, and the checksum by it.
_CRC_TABLE = """SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT))
                           ORDER BY b) AS crcs FROM (SELECT unnest(range(256)) AS b)"""
_CRC = """xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"""


def op8_feistel_shards(shards: int = 24, seed: int = 8) -> str:
    rounds = "SELECT r, step, x % a AS l, x // a AS g, a, b FROM walk, sides WHERE step = 0 OR x >= n"
    for i, (add, factor) in enumerate(fs.Permutation(1, seed).keys):
        moved, other, side = ("g", "l", "b") if i % 2 else ("l", "g", "a")
        shifted = f"(({other} + {add}) % {fs.PRIME})"
        mixed = f"({shifted} * {shifted} % {fs.PRIME}) * {factor} % {fs.PRIME}"
        rounds = f"SELECT * REPLACE (({moved} + {mixed} % {side}) % {side} AS {moved}) FROM ({rounds})"
    return f"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
texts AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes
          FROM documents),
sized AS (SELECT doc_id, len(bytes) + 8 AS size, {_CRC} AS text_crc32 FROM texts, crc_table),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS r FROM sized),
root AS (SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*), 1) - 1)) AS BIGINT) + 1 AS a FROM documents),
sides AS (SELECT n, a, (n + a - 1) // a AS b FROM root),
walk AS (SELECT r, r AS x, 0 AS step FROM numbered
         UNION ALL SELECT r, l + a * g AS x, step + 1 AS step FROM ({rounds})),
placed AS (SELECT r, arg_max(x, step) AS position FROM walk GROUP BY r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position % {shards} AS INTEGER) AS shard, position // {shards} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, r AS row_number
FROM numbered JOIN placed USING (r)"""


def _tail(z: str) -> str:
    """P(Z > z), by the same approximation as the operator."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    series = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    tail = f"exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * ({series})"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END"


def op10_secret_scan() -> str:
    candidate = f"[A-Za-z0-9+/_=-]{{{ss.MIN_LENGTH},}}"  # leftmost and greedy, so always a whole run
    patterns = {"assign": (ss.ASSIGN, 2), "access": (ss.ACCESS, 0), "hex": (ss.HEX, 0), "random": (candidate, 0)}
    found = " UNION ALL ".join(
        f"""SELECT r, {k} AS kind, string_split_regex(t, {_text(p)}) AS gaps, regexp_extract_all(t, {_text(p)}, 0) AS whole,
            regexp_extract_all(t, {_text(p)}, {g}) AS value FROM texts WHERE regexp_matches(t, {_text(p)})"""
        for k, (p, g) in enumerate(patterns.values())
    )
    encodings = " ".join(
        f"WHEN NOT regexp_matches(body, '[^{alphabet.replace('-', chr(92) + '-')}]') THEN {i}" for i, (_, alphabet, _) in enumerate(ss.ENCODINGS)
    )
    rows = ", ".join(f"({i}, {_text(alphabet)}, {equal})" for i, (_, alphabet, equal) in enumerate(ss.ENCODINGS))
    bands = " ".join(f"WHEN stop - start >= {least} THEN {least}" for least in reversed(ss.BANDS))
    kind = "CASE WHEN c BETWEEN '0' AND '9' THEN 0 WHEN c BETWEEN 'A' AND 'Z' THEN 1 WHEN c BETWEEN 'a' AND 'z' THEN 2 ELSE 3 END"
    names = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(patterns))
    shown = "string_agg(CASE kind " + names + " END || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
matched AS (SELECT r, kind, i, length(gaps[i]) AS gap, length(whole[i]) AS long, length(value[i]) AS value, whole[i] AS match
            FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)),
spans AS (SELECT *, sum(gap + long) OVER (PARTITION BY r, kind ORDER BY i) - long AS start, sum(gap + long) OVER (PARTITION BY r, kind ORDER BY i) AS stop
          FROM matched),
coded AS (SELECT *, CASE {encodings} END AS e FROM (SELECT r, start, stop, regexp_replace(match, '=+$', '') AS body FROM spans WHERE kind = 3)),
letters AS (SELECT r, start, stop, body, alphabet, equal, CAST(length(body) AS DOUBLE) AS n, CAST(length(alphabet) AS DOUBLE) AS k,
                   string_split(body, '') AS chars
            FROM coded JOIN (VALUES {rows}) AS encodings(e, alphabet, equal) USING (e) WHERE body <> ''),
codes AS (SELECT *, list_transform(chars, lambda c: CAST(instr(alphabet, c) AS DOUBLE)) AS code, list_transform(chars, lambda c: {kind}) AS kinds FROM letters),
measured AS (SELECT *, k / n * list_sum(list_transform(list_distinct(chars), lambda c: (n - length(replace(body, c, ''))) ** 2)) - n AS chi,
                    1 + list_sum(list_transform(range(1, len(code)), lambda i: CASE WHEN (code[i] > k / 2) <> (code[i + 1] > k / 2) THEN 1 ELSE 0 END)) AS runs,
                    list_sum(list_transform(range(1, len(code)), lambda i: CASE WHEN kinds[i] <> kinds[i + 1] THEN 1 ELSE 0 END)) AS changes,
                    list_sum(list_transform(range(1, len(code)), lambda i: (code[i] - (k + 1) / 2) * (code[i + 1] - (k + 1) / 2))) AS beside
             FROM codes WHERE n >= {ss.MIN_LENGTH}),
odd AS (SELECT *, (cbrt(chi / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z1,
               abs(runs - (1 + (n - 1) / 2)) / sqrt((n - 1) / 4) AS z2, abs(beside) / ((k * k - 1) / 12) / sqrt(n - 1) AS z3,
               ((k - 1 + n * (k * equal - 1) - chi) / sqrt(2 * (k - 1 + 2 * (n * (k * equal - 1))))
                + (changes - (n - 1) * {ss.CHANGE_RATE}) / sqrt((n - 1) * {ss.CHANGE_RATE} * (1 - {ss.CHANGE_RATE}))) / sqrt(2.0) AS score FROM measured),
scored AS (SELECT r, start, stop, CASE {bands} ELSE 0 END AS band, floor(greatest(-30.0, least(30.0, score)) * {ss.BIN}) AS bin,
                  least({_tail("z1")}, 2 * ({_tail("z2")}), 2 * ({_tail("z3")})) >= {ss.LEVEL / 3} AS is_random FROM odd),
ranked AS (SELECT band, bin, sum(count(*)) OVER (PARTITION BY band ORDER BY bin DESC) AS rank, sum(count(*)) OVER (PARTITION BY band) AS family
           FROM scored GROUP BY band, bin),
limits AS (SELECT band, min(bin) AS lowest FROM ranked WHERE {_tail(f"(bin / {ss.BIN})")} <= {ss.FALSE_SHARE} * rank / family GROUP BY band),
kept AS (SELECT r, kind, start, stop FROM spans WHERE kind IN (1, 2) OR kind = 0 AND value >= {ss.ASSIGN_VALUE}
         UNION ALL SELECT r, 3, start, stop FROM scored JOIN limits USING (band) WHERE is_random AND bin >= lowest),
gathered AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
                    count(*) FILTER (WHERE kind = 2) AS n_hex, {shown} AS spans, {shown} FILTER (WHERE kind < 3) AS base FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN gathered USING (r)"""


def op11_slot_pivot(fanout: int = mk.FANOUT) -> str:
    value = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
    leaf, changed = (
        " || ".join(value.format(f"replace({c}, chr(10), '')" if tampered and c == "text" else c) for c in mk.COLUMNS) for tampered in (False, True)
    )

    def tree(name: str, leaves: str) -> str:
        """All nodes of the trees over (tree, node, nodes, digest)."""
        return f"""{name} AS (SELECT tree, 0 AS level, node, nodes, digest FROM {leaves}
      UNION ALL SELECT tree, level + 1, node // {fanout}, (nodes + {fanout - 1}) // {fanout}, sha256(string_agg(digest, '' ORDER BY node))
      FROM {name} WHERE nodes > 1 GROUP BY tree, level, node // {fanout}, nodes)"""

    def steps(name: str, leaves: str, nodes: str) -> str:
        """left and right siblings of each leaf at each level of more than one node."""
        own, up = f"l.node // CAST({fanout} ** n.level AS BIGINT)", f"l.node // CAST({fanout} ** (n.level + 1) AS BIGINT)"
        beside = lambda sign: f"coalesce(string_agg(s.digest, '' ORDER BY s.node) FILTER (WHERE s.node {sign} {own}), '')"
        return f"""{name} AS (SELECT l.r, n.level, {beside('<')} AS before, {beside('>')} AS after
      FROM {leaves} l JOIN (SELECT DISTINCT tree, level FROM {nodes} WHERE nodes > 1) n USING (tree)
      JOIN {nodes} s ON s.tree = l.tree AND s.level = n.level AND s.node // {fanout} = {up} GROUP BY l.r, n.level, l.node)"""

    return f"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
ids AS (SELECT *, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
hashed AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({leaf}) AS digest,
                  CASE WHEN {_CRC} % 2 = 0 THEN sha256({changed}) ELSE sha256({leaf}) END AS tampered FROM ids, crc_table),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS nodes,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS node FROM hashed),
{tree("lower_nodes", "leaves")},
subroots AS (SELECT 0 AS tree, tree AS r, tree AS node, count(*) OVER () AS nodes, digest FROM lower_nodes WHERE nodes = 1),
{tree("upper_nodes", "subroots")},
{steps("lower_steps", "leaves", "lower_nodes")},
{steps("upper_steps", "subroots", "upper_nodes")},
way AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY part, level) AS step, before, after
        FROM (SELECT r, 0 AS part, level, before, after FROM lower_steps
              UNION ALL SELECT l.r, 1, level, before, after FROM leaves l JOIN upper_steps u ON u.r = l.tree)),
proofs AS (SELECT r, string_agg(before || after, '' ORDER BY step) AS proof FROM way GROUP BY r),
folding AS (SELECT r, 0 AS step, tampered AS digest FROM leaves
            UNION ALL SELECT f.r, f.step + 1, sha256(before || digest || after) FROM folding f JOIN way w ON w.r = f.r AND w.step = f.step + 1),
folds AS (SELECT r, arg_max(digest, step) AS folded_root FROM folding GROUP BY r)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, u.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = u.digest AS verified
FROM leaves l JOIN subroots s ON s.r = l.tree JOIN (SELECT digest FROM upper_nodes WHERE nodes = 1) u ON true
JOIN folds f ON f.r = l.r LEFT JOIN proofs p ON p.r = l.r"""


def op13_sorted_lists(k: int = sl.K, every: int = 50) -> str:
    return f"""
WITH usable AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
width AS (SELECT len(x) AS n FROM usable GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1),
vectors AS (SELECT DISTINCT vec_id, x FROM usable WHERE len(x) = (SELECT n FROM width)),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS score
           FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {k}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_rules": op2_line_rules(),
        "op8_feistel_shards": op8_feistel_shards(),
        "op10_secret_scan": op10_secret_scan(),
        "op11_slot_pivot": op11_slot_pivot(),
        "op13_sorted_lists": op13_sorted_lists(),
    }
