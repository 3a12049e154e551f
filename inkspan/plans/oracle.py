"""DuckDB SQL for the registered queries, written apart from the DataFrame plans.

RE2 has no lookaround, so sentences are found another way here: text is split
at every possible end, and pieces that end with an abbreviation are joined to
the next by a running sum.
"""

from __future__ import annotations

from inkspan.functions import lexicon as lx
from inkspan.operators import compare as cp
from inkspan.operators import profile as pf


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


W = q(lx.WORD)
_AB = "|".join(a.replace(".", r"\.") for a in lx.ABBREVIATIONS)
_GB = r"[A-Za-z](?:\.[A-Za-z.]{0,3}|[A-Za-z.]\.[A-Za-z.]{0,2}|[A-Za-z.]{2}\.[A-Za-z.]?|[A-Za-z.]{3}\.)[A-Za-z]"
NOT_ENDING = q(rf"(?:^|[^A-Za-z.])\.*(?:(?i:{_AB})|{_GB})\.[.!?…]*$")
POSSIBLE_END = q(r"""([.!?…]+)[\s\x0b\x1c-\x1f]+(["'“”‘’(\[]*[A-Z0-9])""")


def r4(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(18,8)), 4) AS DOUBLE)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[\\s\\x0b\\x1c-\\x1f]+', ''), '[\\s\\x0b\\x1c-\\x1f]+$', '')"


def sentences(units: str, keys: str, out: str) -> str:
    """CTEs that turn units(keys, clean) into out(keys, sid, n): words of each sentence."""
    return f"""
{out}_pieces AS (
  SELECT {keys}, unnest(string_split(regexp_replace({strip('clean')}, {POSSIBLE_END}, '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS piece,
         generate_subscripts(string_split(regexp_replace({strip('clean')}, {POSSIBLE_END}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) AS ord FROM {units}),
{out}_ends AS (SELECT *, CASE WHEN regexp_matches(piece, {NOT_ENDING}) THEN 0 ELSE 1 END AS ending FROM {out}_pieces),
{out}_ids AS (SELECT *, coalesce(sum(ending) OVER (PARTITION BY {keys} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM {out}_ends),
{out} AS (SELECT {keys}, sid, sum(len(regexp_extract_all(piece, {W}))) AS n FROM {out}_ids GROUP BY {keys}, sid HAVING sum(len(regexp_extract_all(piece, {W}))) > 0)"""


def syllables(w: str) -> str:
    stem = f"CASE WHEN ends_with({w}, 'e') AND NOT ends_with({w}, 'le') THEN left({w}, length({w}) - 1) ELSE {w} END"
    groups = f"len(regexp_extract_all({stem}, '[aeiouy]+'))"
    return f"CASE WHEN {w} = '' THEN 0 WHEN length({w}) <= 3 THEN 1 ELSE greatest(CASE WHEN (ends_with({w}, 'es') OR ends_with({w}, 'ed')) AND {groups} > 1 THEN {groups} - 1 ELSE {groups} END, 1) END"


def occurrences(m: str) -> str:
    one = f"CAST((length(text) - length(replace(text, {q(m)}, ''))) / {len(m)} AS BIGINT)"
    return "(" + " + ".join([one, *(f"CAST(length(text) - length(replace(text, {q(c)}, '')) AS BIGINT)" for c in lx.CURLY_QUOTES)]) + ")" if m == '"' else one


def transitions(joined: str) -> str:
    return " + ".join(f"len(regexp_extract_all({joined}, ' {c} '))" for c in lx.CONNECTIVES)


#: The texts, where queries over documents and those over conversations differ.
DOCUMENTS = "d AS (SELECT doc_id AS uid, source AS author, text, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS clean FROM documents WHERE text IS NOT NULL)"
CONVERSATIONS = "d AS (SELECT conv_id AS uid, 'all' AS author, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS clean FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"


def features(source: str = DOCUMENTS) -> str:
    lists = "list_avg({0}) AS {1}_mean, list_median({0}) AS {1}_median, list_min({0}) AS {1}_min, list_max({0}) AS {1}_max, list_stddev_pop({0}) AS {1}_std"
    marks = ", ".join(f"{occurrences(m)} AS mark_{i}" for i, m in enumerate(lx.MARKS))
    total = " + ".join(f"mark_{i}" for i in range(len(lx.MARKS)))
    return f"""
WITH {source},
tok AS (SELECT uid, author, text, clean, regexp_extract_all(clean, {W}) AS words, list_transform(regexp_extract_all(clean, {W}), lambda w: lower(w)) AS low FROM d),
paras AS (SELECT uid, unnest(list_filter(list_transform(string_split_regex(clean, '\\n[\\s\\x0b\\x1c-\\x1f]*\\n'), lambda p: {strip('p')}), lambda p: p <> '')) AS clean,
                generate_subscripts(list_filter(list_transform(string_split_regex(clean, '\\n[\\s\\x0b\\x1c-\\x1f]*\\n'), lambda p: {strip('p')}), lambda p: p <> ''), 1) AS pno FROM d),
{sentences('d', 'uid', 'sen')},
{sentences('paras', 'uid, pno', 'psen')},
sl AS (SELECT uid, count(*) AS sentences, avg(n) AS s_mean, median(n) AS s_median, min(n) AS s_min, max(n) AS s_max, stddev_pop(n) AS s_std,
              count(*) FILTER (n <= {lx.SHORT_MAX}) AS short, count(*) FILTER (n > {lx.SHORT_MAX} AND n <= {lx.MEDIUM_MAX}) AS medium, count(*) FILTER (n > {lx.MEDIUM_MAX}) AS long FROM sen GROUP BY uid),
ps AS (SELECT uid, pno, count(*) AS n FROM psen GROUP BY uid, pno),
pl AS (SELECT p.uid, count(*) AS paragraphs, avg(len(regexp_extract_all(p.clean, {W}))) AS pw_mean, median(len(regexp_extract_all(p.clean, {W}))) AS pw_median, min(len(regexp_extract_all(p.clean, {W}))) AS pw_min,
              max(len(regexp_extract_all(p.clean, {W}))) AS pw_max, stddev_pop(len(regexp_extract_all(p.clean, {W}))) AS pw_std, avg(coalesce(ps.n, 0)) AS pn_mean, median(coalesce(ps.n, 0)) AS pn_median, min(coalesce(ps.n, 0)) AS pn_min, max(coalesce(ps.n, 0)) AS pn_max
       FROM paras p LEFT JOIN ps ON p.uid = ps.uid AND p.pno = ps.pno GROUP BY p.uid),
wl AS (SELECT uid, author, text, low, len(words) AS words, length(text) AS characters, length(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f]', '', 'g')) AS characters_no_spaces,
              list_sum(list_transform(words, lambda w: length(w))) AS total_chars, len(list_distinct(low)) AS types,
              list_transform(low, lambda w: length(w)) AS lens, list_transform(list_transform(low, lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: {syllables('w')}) AS syl,
              len(list_filter(low, lambda w: list_contains([{', '.join(map(q, lx.PRONOUNS))}], w))) AS pronoun_count, ' ' || array_to_string(low, ' ') || ' ' AS joined, {marks} FROM tok),
f0 AS (SELECT wl.uid, author, characters, characters_no_spaces, words, coalesce(sentences, 0) AS sentences, coalesce(paragraphs, 0) AS paragraphs, total_chars, types, {lists.format('lens', 'wl')},
              coalesce(list_sum(syl), 0) AS syllables, len(list_filter(syl, lambda s: s >= 3)) AS complex_words, pronoun_count, {transitions('joined')} AS transition_count,
              s_mean, s_median, s_min, s_max, s_std, short, medium, long, pw_mean, pw_median, pw_min, pw_max, pw_std, pn_mean, pn_median, pn_min, pn_max, {', '.join(f'mark_{i}' for i in range(len(lx.MARKS)))}
       FROM wl LEFT JOIN sl ON wl.uid = sl.uid LEFT JOIN pl ON wl.uid = pl.uid),
f AS (SELECT uid, author, characters, characters_no_spaces, words, sentences, paragraphs, {r4('CASE WHEN words > 0 THEN total_chars / words END')} AS average_word_length, {r4('s_mean')} AS average_sentence_length, {r4('s_median')} AS median_sentence_length,
             CAST(s_min AS BIGINT) AS min_sentence_length, CAST(s_max AS BIGINT) AS max_sentence_length, {r4('s_std')} AS sentence_deviation, {r4('s_std / s_mean')} AS sentence_variation, {r4('short / sentences')} AS short_ratio, {r4('medium / sentences')} AS medium_ratio, {r4('long / sentences')} AS long_ratio,
             {r4('pw_mean')} AS average_words_per_paragraph, {r4('pw_median')} AS median_words_per_paragraph, CAST(pw_min AS BIGINT) AS min_words_per_paragraph, CAST(pw_max AS BIGINT) AS max_words_per_paragraph, {r4('pw_std')} AS paragraph_deviation,
             {r4('pn_mean')} AS average_sentences_per_paragraph, {r4('pn_median')} AS median_sentences_per_paragraph, CAST(pn_min AS BIGINT) AS min_sentences_per_paragraph, CAST(pn_max AS BIGINT) AS max_sentences_per_paragraph,
             types AS unique_words, {r4('CASE WHEN words > 0 THEN types / words END')} AS type_token_ratio, {r4('CASE WHEN words > 0 THEN types / sqrt(words) END')} AS guiraud_r, {r4('wl_mean')} AS vocabulary_word_length, {r4('wl_median')} AS median_word_length,
             CAST(wl_min AS BIGINT) AS min_word_length, CAST(wl_max AS BIGINT) AS max_word_length, {r4('wl_std')} AS word_length_deviation, CAST(syllables AS BIGINT) AS syllables, complex_words,
             {r4('CASE WHEN words > 0 AND sentences > 0 THEN 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words) END')} AS flesch_reading_ease,
             {r4('CASE WHEN words > 0 AND sentences > 0 THEN 0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59 END')} AS flesch_kincaid_grade,
             {r4('CASE WHEN words > 0 AND sentences > 0 THEN 0.4 * (words / sentences + 100 * complex_words / words) END')} AS gunning_fog,
             {r4('CASE WHEN words > 0 AND sentences > 0 THEN 0.0588 * (total_chars / words * 100) - 0.296 * (sentences / words * 100) - 15.8 END')} AS coleman_liau,
             {r4('CASE WHEN words > 0 AND sentences > 0 THEN 4.71 * (total_chars / words) + 0.5 * (words / sentences) - 21.43 END')} AS automated_readability_index,
             pronoun_count, transition_count, {', '.join(f'mark_{i}' for i in range(len(lx.MARKS)))}, {', '.join(r4(f'CASE WHEN words > 0 THEN mark_{i} / words * 100 END') + f' AS per_100_{i}' for i in range(len(lx.MARKS)))},
             {total} AS punctuation_total, {r4(f'CASE WHEN words > 0 THEN ({total}) / words END')} AS punctuation_density, {r4('CASE WHEN words > 0 THEN pronoun_count / words END')} AS pronoun_ratio,
             CASE WHEN words > 0 THEN transition_count / words * 100 END AS transitions_per_100_words FROM f0)"""


LONG = ", long_f AS (" + " UNION ALL ".join(f"SELECT uid, author, {q(name)} AS feature, CAST({c} AS DOUBLE) AS value, sqrt(greatest(words, 1)) AS weight, words FROM f WHERE words > 0" for name, c in pf.FEATURES.items()) + ")"
#: Drafts without words have all their figures, null.
DRAFTS = ", long_d AS (" + " UNION ALL ".join(f"SELECT uid, author, {q(name)} AS feature, CAST({c} AS DOUBLE) AS value FROM f" for name, c in pf.FEATURES.items()) + ")"
AGG = ", agg AS (SELECT author, feature, sum(value * weight) / sum(weight) FILTER (value IS NOT NULL) AS mean, median(value) AS median, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(value) AS n FROM long_f GROUP BY author, feature)"
_STAB = "CASE WHEN mean IS NULL OR std IS NULL THEN NULL WHEN mean = 0 THEN CASE WHEN std = 0 THEN 'stable' ELSE 'variable' END WHEN abs(std / mean) < 0.15 THEN 'stable' WHEN abs(std / mean) < 0.35 THEN 'moderate' ELSE 'variable' END"
NUMBERS = f", numbers AS (SELECT author, feature, {', '.join(r4(c) + ' AS ' + c for c in ('mean', 'median', 'std', 'min', 'max'))}, {r4('mean - std')} AS low, {r4('mean + std')} AS high, n, CASE WHEN feature IN ({', '.join(map(q, pf.STABILITY_OF))}) THEN {_STAB} END AS stability FROM agg)"
META = ", meta AS (SELECT author, count(*) FILTER (words > 0) AS sample_count, CAST(sum(words) AS BIGINT) AS total_words, count(*) FILTER (words = 0) AS skipped_samples, CASE WHEN count(*) FILTER (words > 0) < 2 OR sum(words) < 500 THEN 'low' WHEN count(*) FILTER (words > 0) >= 4 AND sum(words) >= 1500 THEN 'high' ELSE 'medium' END AS confidence FROM f GROUP BY author HAVING count(*) FILTER (words > 0) > 0)"


def grams(n: int, source: str = DOCUMENTS) -> str:
    item = "low[i]" if n == 1 else " || ' ' || ".join(f"low[i + {k}]" for k in range(n))
    return f"""
WITH {source},
tok AS (SELECT uid, author, list_transform(regexp_extract_all(clean, {W}), lambda w: lower(w)) AS low FROM d),
g AS (SELECT uid, author, unnest(list_transform(range(1, len(low) - {n} + 2), lambda i: {item})) AS item, unnest(range(1, len(low) - {n} + 2)) AS pos FROM tok),
c AS (SELECT uid, author, item, count(*) AS count, min(pos) AS first_pos FROM g GROUP BY uid, author, item)"""


def top(n: int, k: int, source: str = DOCUMENTS) -> str:
    return grams(n, source) + f""",
t AS (SELECT uid, author, item, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY count DESC, first_pos) AS rank FROM c) WHERE rank <= {k})"""


CONNECTIVE_COUNTS = (
    f"WITH {DOCUMENTS}, tok AS (SELECT uid, author, list_transform(regexp_extract_all(clean, {W}), lambda w: lower(w)) AS low FROM d), j AS (SELECT uid, author, ' ' || array_to_string(low, ' ') || ' ' AS joined FROM tok), t AS ("
    + " UNION ALL ".join(f"SELECT uid, author, {q(c)} AS item, len(regexp_extract_all(joined, ' {c} ')) AS count FROM j WHERE contains(joined, ' {c} ')" for c in lx.CONNECTIVES)
    + ")"
)


def phrases(items: str, top_n: int = pf.TOP_N) -> str:
    return items + f""",
s AS (SELECT uid, author, len(low) AS words FROM tok WHERE len(low) > 0),
z AS (SELECT author, count(*) AS samples FROM s GROUP BY author),
p AS (SELECT t.author, item, CAST(sum(count) AS BIGINT) AS count, sum(count / words) / count(*) AS frequency, count(*) AS holders FROM t JOIN s USING (uid, author) GROUP BY t.author, item),
ph AS (SELECT author, item, count, {r4('frequency')} AS frequency, {r4('holders / samples')} AS sample_presence,
       row_number() OVER (PARTITION BY author ORDER BY holders DESC, round(CAST(frequency AS DECIMAL(20,12)), 10) DESC, item) AS rank FROM p JOIN z USING (author)),
common AS (SELECT * FROM ph WHERE rank <= {top_n})"""


def _score(s: str) -> str:
    return f"CASE {s} WHEN 'close' THEN 0 WHEN 'moderately_different' THEN 1 WHEN 'significantly_different' THEN 2 END"


def _mean_status(m: str) -> str:
    return f"CASE WHEN {m} IS NULL THEN 'unavailable' WHEN {m} < 0.5 THEN 'close' WHEN {m} < 1.25 THEN 'moderately_different' ELSE 'significantly_different' END"


CATALOG = ", catalog(dimension, metric, feature) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in cp.METRICS) + ")"
NUMERIC_ROWS = f""", nrows AS (SELECT uid, l.author, dimension, metric, {r4('value')} AS draft_value, mean AS profile_mean, low, high, {r4('value - mean')} AS difference, {r4('CASE WHEN std > 1e-9 THEN (value - mean) / std END')} AS z_score,
  CASE WHEN value IS NULL OR mean IS NULL THEN 'unavailable' WHEN value BETWEEN low AND high THEN 'close' WHEN std > 1e-9 THEN CASE WHEN abs((value - mean) / std) <= 2 THEN 'moderately_different' ELSE 'significantly_different' END
       WHEN (CASE WHEN mean <> 0 THEN abs((value - mean) / mean) WHEN value = 0 THEN 0 ELSE 1e300 END) <= 0.2 THEN 'close' WHEN (CASE WHEN mean <> 0 THEN abs((value - mean) / mean) WHEN value = 0 THEN 0 ELSE 1e300 END) <= 0.4 THEN 'moderately_different' ELSE 'significantly_different' END AS status
  FROM long_d l JOIN catalog USING (feature) LEFT JOIN numbers nu ON l.author = nu.author AND l.feature = nu.feature)"""
_LABEL = "CASE WHEN variation IS NULL THEN NULL WHEN abs(variation) < 0.15 THEN 'stable' WHEN abs(variation) < 0.35 THEN 'moderate' ELSE 'variable' END"
_ORDER = "list_position(['stable', 'moderate', 'variable'], {})"
STABILITY_ROWS = f""", variations AS (SELECT uid, author, 'sentence_structure' AS dimension, 'sentence_length_variation' AS metric, 'sentence_structure.average_length' AS feature, sentence_variation AS variation FROM f
  UNION ALL SELECT uid, author, 'paragraph_structure', 'paragraph_size_variation', 'paragraph_structure.average_words_per_paragraph', CASE WHEN average_words_per_paragraph > 0 THEN paragraph_deviation / average_words_per_paragraph END FROM f),
labeled AS (SELECT v.*, {_LABEL} AS draft_label, n.stability AS profile_label FROM variations v LEFT JOIN numbers n ON v.author = n.author AND v.feature = n.feature),
srows AS (SELECT uid, author, dimension, metric, draft_label, profile_label, CASE WHEN draft_label IS NULL OR profile_label IS NULL THEN 'unavailable' WHEN abs({_ORDER.format('draft_label')} - {_ORDER.format('profile_label')}) = 0 THEN 'close' WHEN abs({_ORDER.format('draft_label')} - {_ORDER.format('profile_label')}) = 1 THEN 'moderately_different' ELSE 'significantly_different' END AS status FROM labeled)"""
OVERLAP_STATUS = "CASE WHEN words = 0 OR reference_size = 0 THEN 'unavailable' WHEN matched / reference_size >= 0.5 THEN 'close' WHEN matched / reference_size >= 0.2 THEN 'moderately_different' ELSE 'significantly_different' END"


def _overlap_ctes(top_n: int = pf.TOP_N) -> str:
    """orows, and the profiles' phrases common1, common2, common3 and commonc, of a table tok(uid, author, low)."""
    out = [", low_words AS (SELECT uid, author, len(low) AS words FROM tok), z AS (SELECT author, count(*) AS samples FROM low_words WHERE words > 0 GROUP BY author)"]
    rows = []
    for n, (dimension, metric, _) in zip((1, "c", 2, 3), cp.OVERLAPS, strict=True):
        if n == "c":
            one = " UNION ALL ".join(f"SELECT uid, author, {q(c)} AS item, len(regexp_extract_all(joined, ' {c} ')) AS count, 1 AS k FROM j WHERE contains(joined, ' {c} ')" for c in lx.CONNECTIVES)
            out.append(f", j AS (SELECT uid, author, ' ' || array_to_string(low, ' ') || ' ' AS joined FROM tok), kc AS ({one})")
        else:
            item = "low[i]" if n == 1 else " || ' ' || ".join(f"low[i + {k}]" for k in range(n))
            out.append(f""",
g{n} AS (SELECT uid, author, unnest(list_transform(range(1, len(low) - {n} + 2), lambda i: {item})) AS item, unnest(range(1, len(low) - {n} + 2)) AS pos FROM tok),
c{n} AS (SELECT uid, author, item, count(*) AS count, min(pos) AS first_pos FROM g{n} GROUP BY uid, author, item),
k{n} AS (SELECT uid, author, item, count, row_number() OVER (PARTITION BY uid ORDER BY count DESC, first_pos) AS k FROM c{n})""")
        out.append(f""",
p{n} AS (SELECT t.author, item, CAST(sum(count) AS BIGINT) AS count, sum(count / words) / count(*) AS frequency, count(*) AS holders FROM k{n} t JOIN low_words USING (uid, author) WHERE k <= 30 AND words > 0 GROUP BY t.author, item),
common{n} AS (SELECT * FROM (SELECT author, item, {r4('holders / samples')} AS sample_presence, row_number() OVER (PARTITION BY author ORDER BY holders DESC, round(CAST(frequency AS DECIMAL(20,12)), 10) DESC, item) AS rank FROM p{n} JOIN z USING (author)) WHERE rank <= {top_n}),
met{n} AS (SELECT l.uid, l.author, l.words, w.item, w.sample_presence, o.item IS NOT NULL AS has FROM low_words l LEFT JOIN (SELECT * FROM common{n} WHERE sample_presence >= 0.5) w ON l.author = w.author LEFT JOIN (SELECT * FROM k{n} WHERE k <= 50) o ON o.uid = l.uid AND o.item = w.item),
gr{n} AS (SELECT uid, author, words, count(item) AS reference_size, count(*) FILTER (has) AS matched, sum(sample_presence) FILTER (has) AS weight, sum(sample_presence) AS whole FROM met{n} GROUP BY uid, author, words)""")
        rows.append(f"SELECT uid, author, {q(dimension)} AS dimension, {q(metric)} AS metric, reference_size, matched, {r4('CASE WHEN reference_size > 0 THEN matched / reference_size END')} AS overlap, {r4('CASE WHEN reference_size > 0 THEN coalesce(weight, 0) / whole END')} AS weighted_overlap, {OVERLAP_STATUS} AS status FROM gr{n}")
    return "".join(out) + ", orows AS (" + " UNION ALL ".join(rows) + ")"


def overlap(source: str = DOCUMENTS) -> str:
    return f"WITH {source}, tok AS (SELECT uid, author, list_transform(regexp_extract_all(clean, {W}), lambda w: lower(w)) AS low FROM d)" + _overlap_ctes()


OVERLAP = overlap()
DIMENSIONS = f""", every AS (SELECT uid, author, dimension, metric, status FROM nrows UNION ALL SELECT uid, author, dimension, metric, status FROM srows UNION ALL SELECT uid, author, dimension, metric, status FROM orows),
dims AS (SELECT uid, author, dimension, count({_score('status')}) AS available, {r4(f"avg({_score('status')})")} AS mean_score, {_mean_status(f"avg({_score('status')})")} AS status FROM every GROUP BY uid, author, dimension)"""
_WEIGHT = "CASE dimension " + " ".join(f"WHEN {q(k)} THEN {w}" for k, w in lx.DIMENSION_WEIGHTS.items()) + " END"
OVERALL = f""", overall AS (SELECT uid, author, sum({_score('status')} * {_WEIGHT}) / sum({_WEIGHT}) FILTER (status <> 'unavailable') AS mean FROM dims GROUP BY uid, author)"""
COMPARE = features() + LONG + DRAFTS + AGG + NUMBERS + META + CATALOG + NUMERIC_ROWS + STABILITY_ROWS


def whole(source: str = DOCUMENTS) -> str:
    """All 37 rows of each draft, its dimensions and overall mean."""
    return features(source) + LONG + DRAFTS + AGG + NUMBERS + META + CATALOG + NUMERIC_ROWS + STABILITY_ROWS + _overlap_ctes() + DIMENSIONS + OVERALL


WHOLE = whole()


def drift() -> str:
    """Overall status of each text before and after its revision: revised texts are drafts that belong to no profile."""
    texts = """d AS (SELECT doc_id AS uid, source AS author, text, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS clean, false AS revised FROM documents WHERE text IS NOT NULL
UNION ALL SELECT -1 - doc_id, source, t, regexp_replace(t, '\\r\\n?', chr(10), 'g'), true FROM (SELECT doc_id, source, replace(substr(text, 1, CAST(floor(length(text) * 0.8) AS BIGINT)), '7', '') AS t FROM documents WHERE text IS NOT NULL))"""
    sql = whole(texts)
    # profiles are made of the documents as they are
    sql = sql.replace(" FROM f WHERE words > 0 UNION ALL SELECT uid, author, ", " FROM f WHERE words > 0 AND uid >= 0 UNION ALL SELECT uid, author, ").replace("AS weight, words FROM f WHERE words > 0)", "AS weight, words FROM f WHERE words > 0 AND uid >= 0)")
    sql = sql.replace("FROM low_words WHERE words > 0 GROUP BY author", "FROM low_words WHERE words > 0 AND uid >= 0 GROUP BY author").replace("WHERE k <= 30 AND words > 0 GROUP BY", "WHERE k <= 30 AND words > 0 AND uid >= 0 GROUP BY")
    return sql + f""", s AS (SELECT uid, {_mean_status('mean')} AS status FROM overall)
SELECT a.uid, a.status AS before, b.status AS after, coalesce({_score('b.status')} > {_score('a.status')}, false) AS drifted FROM s a JOIN s b ON b.uid = -1 - a.uid WHERE a.uid >= 0"""


_NAMED = "CASE {0} WHEN 'close' THEN 'in line' WHEN 'moderately_different' THEN 'off' WHEN 'significantly_different' THEN 'far off' WHEN 'unavailable' THEN 'not measured' END"


def _fig(x: str) -> str:
    return f"coalesce(regexp_replace(printf('%.4f', {x}), '(\\.\\d+?)0+$', '\\1'), 'unknown')"


def explained() -> str:
    name = "replace(metric, '_', ' ')"
    usual = f"CASE WHEN low IS NULL OR high IS NULL THEN 'no usual range' ELSE 'usually ' || {_fig('low')} || ' to ' || {_fig('high')} END"
    return f"""CASE status WHEN 'unavailable' THEN {name} || ' can''t be judged, as ' || CASE WHEN draft_value IS NULL THEN 'the draft' ELSE 'the profile' END || ' has no such figure.' WHEN 'close' THEN {name} || ' is in line.'
ELSE {name} || ' is ' || {_NAMED.format('status')} || ', ' || CASE WHEN difference > 0 THEN 'higher' ELSE 'lower' END || ' than in the profile: ' || {_fig('draft_value')} || ', ' || {usual} || '.' END"""


def summary() -> str:
    def listed(status: str, title: str) -> str:
        return f"CASE WHEN count(*) FILTER (status = {q(status)}) > 0 THEN {q(title + ': ')} || replace(string_agg(dimension, ', ' ORDER BY dimension) FILTER (status = {q(status)}), '_', ' ') || '.' END"

    low = "CASE WHEN confidence = 'low' OR words < 100 THEN 'low' WHEN confidence = 'medium' OR words < 400 THEN 'medium' ELSE 'high' END"
    return f""", told AS (SELECT uid, author, {listed('close', 'In line')} AS a, {listed('significantly_different', 'Far off')} AS b, {listed('moderately_different', 'Off')} AS c, {listed('unavailable', 'Not measured')} AS u,
max(CASE WHEN dimension = 'ngrams' AND status IN ('moderately_different', 'significantly_different') THEN 'Few phrases are shared, which can be due to the topic.' END) AS topic FROM dims GROUP BY uid, author)
SELECT uid, CASE WHEN words = 0 THEN 'The draft has no words, so nothing was compared.' ELSE concat_ws(' ', a, b, c, 'Evidence: ' || sample_count || ' samples with ' || total_words || ' words; the draft has ' || words || '.', CASE WHEN {low} = 'low' THEN 'Little evidence, so differences mean little.' END, topic) END AS summary,
CASE WHEN words = 0 THEN 'The draft has no words, so nothing was compared. The bands are rules of thumb; they say nothing about who or what wrote a text.' ELSE concat_ws(' ', u, CASE WHEN words < 100 THEN 'Under 100 words: averages and phrases are shaky.' WHEN words < 400 THEN 'Under 400 words: phrases and paragraphs count for less.' END, 'The bands are rules of thumb; they say nothing about who or what wrote a text.') END AS limitations
FROM told JOIN f USING (uid, author) JOIN meta USING (author)"""
