"""Pieces of DuckDB SQL that the queries' oracles are made of."""

from __future__ import annotations

from ..functions import text as T

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SPACE}+', ' ', 'g')"


def norm(x: str) -> str:
    x = f"regexp_replace(nfc_normalize({x}), '\\r\\n|\\r', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def key(x: str) -> str:
    return f"sha1({collapse(f'lower({strip(x)})')})"


def bucket(x: str, modulo: int) -> str:
    return f"(('0x' || substr(sha1({x}), 1, 8))::BIGINT % {modulo})"


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


def hits(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def word_hits(words: str) -> str:
    return f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(w) for w in words.split('|'))})))"


CORPUS = "corpus AS (SELECT doc_id, doc_id AS ordinal, text, CASE WHEN toxic = 1 THEN 'injection' ELSE 'benign' END AS label, source, lang, 'url_text' AS channel, coalesce(quality = 0, false) AS weak_seed FROM documents LEFT JOIN labels USING (doc_id))"
STAGED = f"{CORPUS}, normed AS (SELECT * REPLACE ({norm('text')} AS text) FROM corpus), staged AS (SELECT *, CASE WHEN length({strip('text')}) = 0 OR coalesce(source, '') = '' THEN 'bad' WHEN length(text) BETWEEN 3 AND 4000 THEN 'ok' ELSE 'len' END AS stage, {key('text')} AS dk FROM normed)"
KEPT = f"{STAGED}, kept AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY ordinal) AS r FROM staged WHERE stage = 'ok') WHERE r = 1)"
SPLIT = f"""{KEPT}, marked AS (SELECT *, sha1(text) AS id, label = 'benign' AND {any_of('text', T.FP_HARD_WORDS)} AS fp_hard, 'row-' || dk AS gk FROM kept),
    split AS (SELECT *, CASE WHEN NOT weak_seed AND {bucket('gk', 100)} < CASE WHEN fp_hard THEN 30 ELSE 18 END THEN 'eval' ELSE 'train' END AS side FROM marked)"""
_ALL = "SELECT 0 AS rank, doc_id AS ordinal, text, 'documents' AS source FROM documents UNION ALL SELECT 1, page_id, html, 'pages' FROM pages UNION ALL SELECT 2, conv_id * 1000000 + turn, text, 'conversations' FROM conversations UNION ALL SELECT 3, item_id, text, 'benchmark' FROM benchmark"
UNION = f"u AS ({_ALL}), normed AS (SELECT * REPLACE ({norm('text')} AS text) FROM u), merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key('text')} ORDER BY rank, ordinal) AS r FROM normed WHERE length(text) BETWEEN 3 AND 4000) WHERE r = 1)"
GUESS = f"""counted AS (SELECT *, list_transform(regexp_extract_all(translate(text, 'İıſK', 'iisk'), '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w)) AS ws, greatest({hits('text', '[\\p{L}\\p{Nl}\\p{No}]')}, 1) AS letters, greatest({hits('text', '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+')}, 1) AS words FROM documents),
    points AS (SELECT *, 2 * {hits('text', T.TURKISH_LETTERS)} + {word_hits(T.TURKISH)} AS tr, {hits('text', T.GERMAN_LETTERS)} + {word_hits(T.GERMAN)} AS de, {hits('text', T.FRENCH_LETTERS)} + {word_hits(T.FRENCH)} AS fr, greatest(CASE WHEN length(text) < 80 THEN 2 ELSE 3 END, CAST(floor(CAST(0.04 AS DOUBLE) * words) AS INTEGER)) AS need FROM counted),
    guessed AS (SELECT *, CASE {' '.join(f"WHEN {hits('text', p)} / letters >= 0.3 THEN '{c}'" for c, p in T.SCRIPTS)} WHEN tr >= need AND tr >= greatest(de, fr) THEN 'tr' WHEN de >= need AND de >= greatest(tr, fr) THEN 'de' WHEN fr >= need AND fr >= greatest(tr, de) THEN 'fr' ELSE 'en' END AS guess FROM points)"""
TOKENS = r"regexp_extract_all(lower(nfc_normalize(text)), '[[:punct:]]|[^\s\x0b\x1c-\x1f\x{85}\p{Z}[:punct:]]+')"
WORDS = f"words AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(len(w))) AS i FROM (SELECT doc_id, lang, {TOKENS} AS w FROM documents))"
PIECES = "pieces AS (SELECT freq, list_transform(string_split(word, ''), lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END) AS p FROM (SELECT word, count(*) AS freq FROM words GROUP BY word))"
_COUNT = "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(CAST(ceil((length(text) - 900) / 600.0) AS BIGINT), 0) + 1 END"
WINDOWS = f"windows AS (SELECT doc_id, text, idx, n_windows, substr(text, CAST(idx * 600 + 1 AS BIGINT), 900) AS window_text FROM (SELECT doc_id, text, {_COUNT} AS n_windows, unnest(range({_COUNT})) AS idx FROM documents))"
CWINDOWS = f"{CORPUS}, {WINDOWS}, cw AS (SELECT w.doc_id, w.idx, w.n_windows, w.window_text, c.label, c.lang FROM windows w JOIN corpus c USING (doc_id))"
TRAINING = f"""{CORPUS}, {WINDOWS}, training AS (SELECT w.doc_id, idx, label, window_text FROM windows w JOIN corpus c USING (doc_id) WHERE NOT (label <> 'benign' AND w.doc_id % 5 = 0 AND n_windows > 1)
    OR idx = CASE w.doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN n_windows - 1 ELSE n_windows // 2 END)"""
SCORED = f"{WINDOWS}, scored AS (SELECT doc_id, idx, window_text, {bucket('window_text', 1000)} / 1000.0 AS score FROM windows)"
POOLED = f"{SCORED}, pooled AS (SELECT d.doc_id, coalesce(max(score), 0.0) AS doc_score FROM documents d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id)"


def metrics(table: str, by: str = "") -> str:
    first = f"{by}, " if by else ""
    return f"""SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1,
        CASE WHEN fp + tn > 0 THEN CAST(fp AS DOUBLE) / (fp + tn) ELSE 0 END AS fp_rate, CASE WHEN fp_hard_total > 0 THEN CAST(fp_hard_fp AS DOUBLE) / fp_hard_total ELSE 0 END AS fp_hard_rate
        FROM (SELECT {first}count(*) FILTER (WHERE label = 'injection' AND pred = 'injection') AS tp, count(*) FILTER (WHERE label = 'benign' AND pred = 'injection') AS fp, count(*) FILTER (WHERE label = 'benign' AND pred = 'benign') AS tn, count(*) FILTER (WHERE label = 'injection' AND pred = 'benign') AS fn,
        count(*) FILTER (WHERE pred IS NULL) AS missing, count(*) FILTER (WHERE label = 'benign' AND fp_hard AND pred IS NOT NULL) AS fp_hard_total, count(*) FILTER (WHERE label = 'benign' AND fp_hard AND pred = 'injection') AS fp_hard_fp FROM {table} {f'GROUP BY {by}' if by else ''})"""
