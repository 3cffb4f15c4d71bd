"""The queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from paperloom.functions.dictionaries import ARXIV_BARE, ARXIV_PREFIX, ARXIV_URL, BOILERPLATE_SECTIONS, COVERED_SECTIONS, ENGLISH_STOPS, FIGURE_NAMES, FIGURE_TYPES, FILL_WORDS, GAP_PATTERNS, HEAD_ARXIV, HEAD_DOI, HEAD_YEAR, HEADINGS, METHOD_WORDS, NO_TITLE, PROBLEM_WORDS_EN, PROBLEM_WORDS_ZH, QUESTION_PATTERNS, QUESTION_PATTERNS_SHORT, SECTIONS, TERM_STOPS_INTRO, TERM_STOPS_METHOD, TERM_WORDS

SPACE = r"[\s\x{0b}\x{85}\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else quoted(x) for x in r) + ")" for r in rows) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sentence_list(x: str, least: int) -> str:
    marked = f"regexp_replace(regexp_replace(replace({x}, chr(10), ' '), '([.!?。！？]){SPACE}+', '\\1' || chr(1), 'g'), '([。！？])', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: length(s) >= {least})"


TEXTS = ["source", "title", "doi", *SECTIONS, "full_text", "language"]
P = "p AS (SELECT DISTINCT ON (paper_idx) paper_idx, year, authors, figures, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in TEXTS) + " FROM paper WHERE paper_idx IS NOT NULL)"
SEC = "sec AS (" + " UNION ALL ".join(f"SELECT paper_idx, {i} AS section_ord, '{n}' AS section_name, {n} AS text FROM p WHERE length({n}) > 0" for i, n in enumerate(SECTIONS)) + ")"


def exploded(source: str, items: str, columns: str, value: str = "sentence") -> str:
    return f"(SELECT {columns}, unnest(range(len(l))) AS pos, unnest(l) AS {value} FROM (SELECT *, {items} AS l FROM {source}))"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def ordered_sections(names) -> str:
    return "sec AS (" + " UNION ALL ".join(f"SELECT paper_idx, language, {i} AS section_ord, '{n}' AS section_name, {n} AS text FROM p WHERE length({n}) > 0" for i, n in enumerate(names)) + ")"


def heading_case(x: str, longest: int) -> str:
    return f"CASE WHEN length({x}) > {longest} THEN NULL " + " ".join(f"WHEN regexp_matches({x}, {quoted('(?i)^(?:' + p + ')')}) THEN '{n}'" for p, n in HEADINGS) + " END"


def label(words: int, chars: int, whole: str) -> str:
    parts = f"list_filter(regexp_split_to_array(title, '{SPACE}+'), lambda w: length(w) > 0)"
    return f"CASE WHEN length(title) = 0 THEN left(source, {chars}) WHEN len({parts}) > {words} THEN array_to_string(list_slice({parts}, 1, {words}), ' ') || '...' ELSE {whole.format(parts=parts)} END"


ALL_SECTIONS = "array_to_string(list_filter([" + ", ".join(SECTIONS) + "], lambda s: length(s) > 0), chr(10) || chr(10))"
STATS = f"""SELECT paper_idx, CASE WHEN length(full_text) > 0 THEN length(full_text) ELSE 0 END::BIGINT AS chars,
 CASE WHEN length(full_text) > 0 THEN len(list_filter(regexp_split_to_array(full_text, '{SPACE}+'), lambda w: length(w) > 0)) ELSE 0 END::BIGINT AS words,
 CASE WHEN length(full_text) > 0 THEN len({sentence_list('full_text', 10)}) ELSE 0 END::BIGINT AS sentences,
 CASE WHEN length(full_text) > 0 THEN len(list_filter(string_split(full_text, chr(10) || chr(10)), lambda b: length({strip('b')}) > 0)) ELSE 0 END::BIGINT AS paragraphs FROM p"""

PROBLEM_CTE = f"""{ordered_sections(['abstract', 'introduction', 'discussion', 'conclusion'])},
 ps AS (SELECT *, list_filter(CASE WHEN language IN ('zh', 'mixed') THEN {listed(PROBLEM_WORDS_EN + PROBLEM_WORDS_ZH)} ELSE {listed(PROBLEM_WORDS_EN)} END, lambda w: contains(lower(sentence), lower(w)))[1] AS keyword
   FROM {exploded('sec', sentence_list('text', 6), 'paper_idx, language, section_ord, section_name')}),
 problems AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_idx, lower(left(sentence, 80)) ORDER BY section_ord, pos) AS n FROM ps WHERE keyword IS NOT NULL) WHERE n = 1)"""


def question_cte(patterns) -> str:
    return f"""{ordered_sections(['discussion', 'conclusion', 'introduction'])},
 qs AS (SELECT * FROM {exploded('sec', sentence_list('text', 31), 'paper_idx, section_ord, section_name')} WHERE regexp_matches(sentence, {quoted('(?i)' + '|'.join(patterns))})),
 questions AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_idx, sentence ORDER BY section_ord, pos) AS n FROM qs) WHERE n = 1)"""


GAPS = f"""{ordered_sections(['discussion', 'conclusion', 'introduction'])},
 gaps AS (SELECT paper_idx, section_name, pos, left(sentence, 500) AS text FROM {exploded('sec', sentence_list('text', 31), 'paper_idx, section_ord, section_name')} WHERE regexp_matches(sentence, {quoted('(?i)' + '|'.join(GAP_PATTERNS))}))"""
METHODS = f"""words AS (SELECT * FROM {values([(i, w) for i, w in enumerate(METHOD_WORDS)])} t(method_ord, method)),
 hits AS (SELECT paper_idx, method, contains(lower(full_text), lower(method))::INT AS present FROM p, words),
 presence AS (SELECT method, paper_idx, present FROM hits WHERE method IN (SELECT method FROM hits GROUP BY method HAVING sum(present) >= 2))"""
FIGURES = f"""f AS (SELECT paper_idx, unnest(figures) AS f FROM p),
 figs AS (SELECT paper_idx, coalesce(f.caption, '') AS caption FROM f),
 types AS (SELECT * FROM {values([(i, n, w.lower()) for i, (n, ws) in enumerate(FIGURE_TYPES) for w in ws])} t(type_ord, figure_type, word)),
 numbered AS (SELECT *, row_number() OVER () AS fig FROM figs),
 figure_counts AS (SELECT figure_type, count(DISTINCT paper_idx) AS paper_count, count(DISTINCT fig) AS total_figures FROM numbered, types WHERE contains(lower(caption), word) GROUP BY type_ord, figure_type HAVING count(DISTINCT paper_idx) >= 2)"""


def fill_sql() -> str:
    votes = " UNION ALL ".join(
        f"SELECT paper_idx, '{n}' AS section_name, pos, block, " + " + ".join(f"contains(lower(block), {quoted(w)})::INT" for w in ws) + f" AS score FROM b WHERE length({n}) = 0" for n, ws in FILL_WORDS.items()
    )
    return (
        with_(P, "b AS " + exploded("p", "string_split(full_text, chr(10) || chr(10))", "paper_idx, methods, results, discussion, conclusion", "block"), f"v AS ({votes})")
        + "SELECT paper_idx, section_name, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS text FROM (SELECT *, row_number() OVER (PARTITION BY paper_idx, section_name ORDER BY score DESC, pos) AS rank FROM v WHERE score > 0) WHERE rank <= 5 GROUP BY 1, 2"
    )


def word_cte(texts: str, bigrams: bool, features: int, name: str = "vec") -> str:
    words = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({listed(ENGLISH_STOPS)}, w))"
    terms = "list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))" if bigrams else "ws"
    return f"""src AS ({texts}), tok AS (SELECT idx, {words} AS ws FROM src), trm AS (SELECT idx, unnest({terms}) AS term FROM tok),
 tf AS (SELECT idx, term, count(*) AS tf FROM trm GROUP BY 1, 2),
 voc AS (SELECT term, sum(tf) AS ctf, count(*) AS df FROM tf GROUP BY term ORDER BY ctf DESC, term LIMIT {features}),
 raw AS (SELECT idx, term, tf * (ln((1.0 + (SELECT count(DISTINCT idx) FROM src)) / (df + 1.0)) + 1.0) AS raw FROM tf JOIN voc USING (term)),
 {name} AS (SELECT idx, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY idx)) AS w FROM raw)"""


BLANK = f"CASE WHEN length(regexp_replace(x, '{SPACE}', '', 'g')) = 0 THEN 'placeholder' ELSE x END"


def cosines(text: str, least: float) -> str:
    """CTEs ending in ``cos`` (paper_a, paper_b, c) of word vectors of a text per paper."""
    words = word_cte(f"SELECT paper_idx AS idx, {BLANK} AS text FROM (SELECT paper_idx, {text} AS x FROM p)", True, 5000)
    return f"{words}, cos AS (SELECT a.idx AS paper_a, b.idx AS paper_b, sum(a.w * b.w) AS c FROM vec a JOIN vec b USING (term) WHERE a.idx < b.idx GROUP BY 1, 2 HAVING sum(a.w * b.w) > {least})"


def char_pairs(name: str, items: str, low: int, high: int, features: int, threshold: float, most: int, more: str = "") -> str:
    """CTEs: ``name``_s (idx, paper_idx, pos, text) in reading order and ``name``_p, its first pairs (i, j, c)."""
    grams = " UNION ALL ".join(f"SELECT idx, unnest(list_transform(range(1, length(t) - {n} + 2), lambda i: substring(t, i, {n}))) AS term FROM {name}_t WHERE length(t) >= {n}" for n in range(low, high + 1))
    return f"""{name}_s AS (SELECT row_number() OVER (ORDER BY paper_idx, {more.split(',')[0] + ', ' if more else ''}pos) AS idx, paper_idx, {more}pos::BIGINT AS pos, text FROM {items}),
 {name}_t AS (SELECT idx, regexp_replace(lower(text), '{SPACE}{SPACE}+', ' ', 'g') AS t FROM {name}_s),
 {name}_f AS (SELECT idx, term, count(*) AS tf FROM ({grams}) GROUP BY 1, 2),
 {name}_v AS (SELECT term, sum(tf) AS ctf, count(*) AS df FROM {name}_f GROUP BY term ORDER BY ctf DESC, term LIMIT {features}),
 {name}_r AS (SELECT idx, term, tf * (ln((1.0 + (SELECT count(*) FROM {name}_s)) / (df + 1.0)) + 1.0) AS raw FROM {name}_f JOIN {name}_v USING (term)),
 {name}_w AS (SELECT idx, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY idx)) AS w FROM {name}_r),
 {name}_p AS (SELECT a.idx AS i, b.idx AS j, sum(a.w * b.w) AS c FROM {name}_w a JOIN {name}_w b USING (term) WHERE a.idx < b.idx GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {threshold} - 1e-12 ORDER BY 1, 2 LIMIT {most})"""


def components_cte(name: str, pairs: str) -> str:
    """CTE ``name`` (idx, component) of the pairs (i, j)."""
    return f"{name}_e AS (SELECT i AS u, j AS v FROM {pairs} UNION SELECT j, i FROM {pairs}), {name}_k AS (SELECT u AS idx, u AS low FROM {name}_e UNION SELECT e.v, k.low FROM {name}_k k JOIN {name}_e e ON e.u = k.idx), {name} AS (SELECT idx, min(low) AS component FROM {name}_k GROUP BY 1)"


def boilerplate_cte(sections) -> str:
    """CTEs ending in ``members`` (section_name, component, idx, paper_idx, pos, text)."""
    parts, unions = [], []
    for k, section in enumerate(sections):
        items = exploded("p", sentence_list(section, 20), "paper_idx", "text")
        parts += [char_pairs(f"b{k}", items, 3, 6, 8000, 0.65, 300), components_cte(f"b{k}_c", f"b{k}_p")]
        unions.append(f"SELECT '{section}' AS section_name, component, idx, paper_idx, pos, text FROM b{k}_c JOIN b{k}_s USING (idx)")
    return ", ".join(parts) + f", every AS ({' UNION ALL '.join(unions)}), members AS (SELECT * FROM every WHERE (section_name, component) IN (SELECT (section_name, component) FROM every GROUP BY section_name, component HAVING count(DISTINCT text) > 1 AND count(DISTINCT paper_idx) > 1))"


def boilerplate_sql(sections) -> str:
    words = f"list_filter(regexp_split_to_array(lower(text), '{SPACE}+'), lambda w: length(w) > 0)"
    return (
        "WITH RECURSIVE "
        + ", ".join((P, boilerplate_cte(sections)))
        + f""", own AS (SELECT *, {words} AS ws FROM members),
 runs AS (SELECT section_name, component, idx, i, n, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS phrase FROM (SELECT *, unnest(range(len(ws))) AS i FROM own) o, range(3, 40) r(n) WHERE i + n <= len(ws)),
 shared AS (SELECT r.section_name, r.component, phrase FROM runs r JOIN members b ON b.section_name = r.section_name AND b.component = r.component AND r.idx < b.idx AND contains(lower(b.text), phrase)
  WHERE length(phrase) >= 10 QUALIFY row_number() OVER (PARTITION BY r.section_name, r.component ORDER BY length(phrase) DESC, r.idx, b.idx, i, n) = 1),
 sizes AS (SELECT section_name, component, count(DISTINCT paper_idx) AS paper_count, count(*) AS sentence_count, min_by(paper_idx, idx) AS first_paper, min_by(pos, idx) AS first_pos FROM members GROUP BY 1, 2)
SELECT section_name, first_paper, first_pos, coalesce(phrase, '(similar wording)') AS phrase, paper_count, sentence_count FROM sizes LEFT JOIN shared USING (section_name, component)"""
    )


def key_terms_sql(column: str, stops, top: int, least: int) -> str:
    words = f"regexp_extract_all(lower({column}), {quoted(TERM_WORDS)})"
    return (
        with_(P, f"w AS (SELECT paper_idx AS idx, {words} AS ws FROM p)", "pos AS (SELECT idx, ws, unnest(range(len(ws))) AS i FROM w)")
        + f"""SELECT idx, rank, phrase AS term, score FROM (SELECT idx, phrase, (c * n)::BIGINT AS score, row_number() OVER (PARTITION BY idx ORDER BY c * n DESC, place) AS rank FROM (
 SELECT idx, phrase, n, count(*) AS c, min(i * 3 + n) AS place FROM (SELECT idx, i, n, array_to_string(list_slice(ws, i + 1, i + n), ' ') AS phrase FROM pos, (VALUES (1), (2), (3)) t(n)
 WHERE i + n <= len(ws) AND NOT list_contains({listed(dict.fromkeys(stops))}, ws[i + 1])) WHERE length(phrase) > 4 GROUP BY 1, 2, 3 HAVING count(*) >= {least})) WHERE rank <= {top}"""
    )


METHOD_TEXT = f"CASE WHEN methods <> '' THEN methods WHEN results <> '' THEN results ELSE {ALL_SECTIONS} END"
INTRO_TEXT = "CASE WHEN introduction <> '' THEN introduction WHEN related_work <> '' THEN related_work ELSE abstract END"
LABEL_4 = label(4, 30, "array_to_string({parts}, ' ')")
LABEL_5 = label(5, 40, "left(title, 60)")
BLANKS = r"[\t\x{0b}\f\r \x{85}\p{Z}]"
LETTER = r"[\p{L}\p{M}\p{N}_]"
# no lambda inside the branches: the sentences of texts without a long paragraph in threes
PARAGRAPHS = f"""blocks AS (SELECT paper_idx, section_name, list_filter(list_transform(string_split_regex(text, '\\n{SPACE}*\\n'), lambda x: replace({strip('x')}, chr(10), ' ')), lambda x: length(x) >= 50) AS own, {sentence_list('text', 20)} AS parts FROM sec),
 paras AS (SELECT paper_idx, section_name, CASE WHEN len(own) > 0 THEN own ELSE list_filter(list_transform(range(0, len(parts), 3), lambda k: array_to_string(list_slice(parts, k + 1, k + 3), ' ')), lambda x: length(x) >= 50) END AS l FROM blocks)"""
CLEAN = f"{strip('regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(full_text, ' + quoted(f'({LETTER})-' + chr(92) + f'n({LETTER})') + ', ' + quoted(chr(92) + '1' + chr(92) + '2') + ', ' + quoted('g') + '), ' + quoted(chr(92) + 'r' + chr(92) + 'n?') + ', chr(10), ' + quoted('g') + '), ' + quoted(chr(92) + 'n{3,}') + ', chr(10) || chr(10), ' + quoted('g') + '), ' + quoted(BLANKS + '+') + ', ' + quoted(' ') + ', ' + quoted('g') + '), ' + quoted(' {2,}') + ', ' + quoted(' ') + ', ' + quoted('g') + ')')}"
BOUNDARIES = f"""one AS (SELECT paper_idx, line_no, min(text) AS text, max(font_size) AS font_size FROM ln GROUP BY 1, 2),
 sized AS (SELECT paper_idx, list_sort(list(DISTINCT coalesce(font_size, 10.0))) AS sizes FROM one GROUP BY 1),
 marks AS (SELECT *, {heading_case('text', 50)} AS by_pattern, CASE WHEN coalesce(font_size, 10.0) > sizes[len(sizes) // 2 + 1] * 1.05 THEN {heading_case('text', 60)} END AS by_font FROM one JOIN sized USING (paper_idx)),
 bounds AS (SELECT paper_idx, line_no, text, CASE WHEN count(by_pattern) OVER (PARTITION BY paper_idx) < 2 THEN by_font ELSE by_pattern END AS heading FROM marks)"""
SEGMENTS = """placed AS (SELECT *, count(heading) OVER (PARTITION BY paper_idx ORDER BY line_no) AS part, last_value(heading IGNORE NULLS) OVER (PARTITION BY paper_idx ORDER BY line_no) AS section, count(heading) OVER (PARTITION BY paper_idx) AS headings FROM bounds),
 segs AS (SELECT paper_idx, coalesce(section, 'introduction') AS section_name, part, string_agg(text, chr(10) ORDER BY line_no) AS text FROM placed WHERE heading IS NULL AND (part > 0 OR headings = 0) GROUP BY 1, 2, 3)"""


def pair_terms(column: str) -> str:
    """Words and word pairs of one column, blank texts as the placeholder."""
    found = f"list_filter(regexp_extract_all(lower(CASE WHEN length({strip(column)}) = 0 THEN 'placeholder' ELSE {column} END), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({listed(ENGLISH_STOPS)}, w))"
    return f"(SELECT paper_idx, term, count(*) AS n FROM (SELECT paper_idx, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM (SELECT paper_idx, {found} AS ws FROM p)) GROUP BY 1, 2)"


TWO_TEXTS = f"""x AS {pair_terms('abstract')}, y AS {pair_terms('conclusion')},
 twos AS (SELECT paper_idx, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b, CASE WHEN x.n IS NULL OR y.n IS NULL THEN ln(1.5) + 1 ELSE 1.0 END AS idf FROM x FULL JOIN y USING (paper_idx, term)),
 dots AS (SELECT paper_idx, sum(a * b * idf * idf) AS dot, sqrt(sum(a * a * idf * idf)) AS na, sqrt(sum(b * b * idf * idf)) AS nb FROM twos GROUP BY 1)"""
TITLE_CASE = "array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN i = 1 OR substring(t, i - 1, 1) IN (' ', '-') THEN upper(substring(t, i, 1)) ELSE substring(t, i, 1) END), '')"

LINES = "ln AS (SELECT DISTINCT paper_idx, line_no, text, font_size FROM line)"
META_TITLE = f"list_filter(list_transform(list_slice(string_split(full_text, chr(10)), 1, 30), lambda x: {strip('x')}), lambda x: length(x) > 20 AND NOT ({' OR '.join(f'starts_with(x, {quoted(n)})' for n in NO_TITLE)}))[1]"
HEAD = "left(full_text, 2000)"

ORACLE: dict[str, str] = {
    "lines": with_(P) + f"SELECT paper_idx, pos::BIGINT AS line_no, {strip('raw')} AS text FROM {exploded('p', 'string_split(full_text, chr(10))', 'paper_idx', 'raw')} WHERE length({strip('raw')}) > 0",
    "sentences": with_(P, SEC) + f"SELECT paper_idx, section_name, pos::BIGINT AS pos, sentence FROM {exploded('sec', sentence_list('text', 10), 'paper_idx, section_name')}",
    "sentences_short": with_(P, SEC) + f"SELECT paper_idx, section_name, pos::BIGINT AS pos, sentence FROM {exploded('sec', sentence_list('text', 6), 'paper_idx, section_name')}",
    "text_stats": with_(P) + STATS,
    "detect_language": with_(P)
    + f"SELECT paper_idx, CASE WHEN k = 0 THEN 'en' WHEN z / k > 0.5 THEN 'zh' WHEN z / k > 0.2 THEN 'mixed' ELSE 'en' END AS detected FROM (SELECT paper_idx, length(regexp_replace(full_text, '{SPACE}', '', 'g'))::DOUBLE AS k, length(regexp_replace(full_text, '[^一-鿿]', '', 'g'))::DOUBLE AS z FROM p)",
    "text_hash": with_(P) + "SELECT paper_idx, md5(full_text) AS text_hash FROM p",
    "short_label_4": with_(P) + "SELECT paper_idx, " + LABEL_4 + " AS label FROM p",
    "short_label_5": with_(P) + "SELECT paper_idx, " + LABEL_5 + " AS label FROM p",
    "all_section_text": with_(P) + f"SELECT paper_idx, {ALL_SECTIONS} AS text FROM p",
    "batches_of_papers": with_(P) + "SELECT (paper_idx // 64)::BIGINT AS batch, count(*) AS n, min(paper_idx) AS first_idx FROM p GROUP BY 1",
    "normalize_sentence": with_(P, SEC)
    + f"SELECT paper_idx, section_name, pos::BIGINT AS pos, regexp_replace(regexp_replace({strip('lower(sentence)')}, '{SPACE}+', ' ', 'g'), '^[^\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+$', '', 'g') AS text FROM {exploded('sec', sentence_list('text', 10), 'paper_idx, section_name')}",
    "heading_match": with_(LINES) + f"SELECT DISTINCT paper_idx, line_no::BIGINT AS line_no, {heading_case('text', 50)} AS section_name FROM ln WHERE {heading_case('text', 50)} IS NOT NULL",
    "no_heading_papers": with_(LINES) + f"SELECT paper_idx FROM ln GROUP BY paper_idx HAVING count({heading_case('text', 50)}) = 0",
    "missing_section_fill": fill_sql(),
    "section_coverage": with_(P) + " UNION ALL ".join(f"SELECT paper_idx, '{n}' AS section_name, (length({n}) > 0)::INT AS present FROM p" for n in COVERED_SECTIONS),
    "paper_metadata": with_(P)
    + f"""SELECT paper_idx, {META_TITLE} AS title, nullif(regexp_extract({HEAD}, {quoted(HEAD_DOI)}, 1), '') AS doi,
 CASE WHEN regexp_extract({HEAD}, {quoted(HEAD_ARXIV)}, 1) <> '' AND NOT starts_with(source, '10.') THEN 'arXiv:' || regexp_extract({HEAD}, {quoted(HEAD_ARXIV)}, 1) ELSE source END AS source,
 nullif(regexp_extract({HEAD}, {quoted(HEAD_YEAR)}, 1), '')::INT AS year FROM p""",
    "loaded_papers": with_(P) + "SELECT paper_idx, coalesce(nullif(left(title, 100), ''), '(unknown)') AS title, left(source, 40) AS source, language, (" + " + ".join(f"(length({c}) > 0)::BIGINT" for c in COVERED_SECTIONS) + ")::BIGINT AS sections FROM p",
    "dedup_by_source": with_(P) + "SELECT min(paper_idx) AS paper_idx, source FROM p GROUP BY source",
    "incremental_dedup": with_(P) + "SELECT source, min(paper_idx) AS paper_idx FROM p WHERE (year IS NULL OR year >= 2015) AND source NOT IN (SELECT source FROM p WHERE year < 2015) GROUP BY source",
    "figure_discussions": with_(P)
    + f"""SELECT paper_idx, idx AS index, pos::BIGINT AS pos, {strip('block')} AS paragraph FROM (SELECT * FROM {exploded('p', 'string_split(full_text, chr(10) || chr(10))', 'paper_idx', 'block')}) b
 JOIN (SELECT DISTINCT paper_idx, f.index::BIGINT AS idx FROM (SELECT paper_idx, unnest(figures) AS f FROM p) WHERE f.index IS NOT NULL) USING (paper_idx)
 WHERE {" OR ".join(f"contains(block, {quoted(n)} || idx)" for n in FIGURE_NAMES)}""",
    "parse_arxiv_id": f"""SELECT input_id, coalesce(nullif(replace(regexp_extract(t, {quoted(ARXIV_URL)}, 1), '.pdf', ''), ''), nullif(regexp_extract(t, {quoted(ARXIV_PREFIX)}, 1), ''), nullif(regexp_extract(t, {quoted(ARXIV_BARE)}, 1), '')) AS arxiv_id FROM (SELECT input_id, {strip('raw')} AS t FROM arxiv_id_input)""",
    "arxiv_input_parts": f"SELECT input_id, pos::BIGINT AS pos, {strip('x')} AS part FROM {exploded('arxiv_id_input', 'string_split(replace(raw, chr(10), chr(44)), chr(44))', 'input_id', 'x')} WHERE length({strip('x')}) > 0",
    "metadata_papers": "SELECT 'arXiv:' || arxiv_id AS source, coalesce(title, '') AS title, year, coalesce(doi, '') AS doi, coalesce(abstract, '') AS abstract, coalesce(abstract, '') AS introduction, coalesce(abstract, '') AS full_text FROM arxiv_meta WHERE arxiv_id IS NOT NULL",
    "map_errors": "SELECT input_id, CASE WHEN x <> '' THEN (x::HUGEINT % 97)::VARCHAR END AS value, CASE WHEN x = '' THEN 'ValueError' END AS error FROM (SELECT input_id, regexp_extract(coalesce(raw, ''), '(\\d+)', 1) AS x FROM arxiv_id_input)",
    "problem_sentences": with_(P, PROBLEM_CTE) + "SELECT paper_idx, section_name, pos::BIGINT AS pos, sentence, keyword FROM problems",
    "problems_per_paper": with_(P, PROBLEM_CTE) + "SELECT p.paper_idx, " + label(4, 30, "array_to_string({parts}, ' ')") + " AS label, source, coalesce(c, 0)::BIGINT AS problem_count FROM p LEFT JOIN (SELECT paper_idx, count(*) AS c FROM problems GROUP BY 1) k ON k.paper_idx = p.paper_idx",
    "open_questions": with_(P, question_cte(QUESTION_PATTERNS)) + "SELECT paper_idx, section_name, pos::BIGINT AS pos, sentence FROM questions",
    "open_questions_alt": with_(P, question_cte(QUESTION_PATTERNS_SHORT)) + "SELECT paper_idx, section_name, pos::BIGINT AS pos, sentence FROM questions",
    "research_gaps": with_(P, GAPS) + "SELECT paper_idx, section_name, pos::BIGINT AS pos, text FROM gaps",
    "method_presence": with_(P, METHODS) + "SELECT method, paper_idx, present FROM presence",
    "figure_types": with_(P, FIGURES) + "SELECT figure_type, paper_count, total_figures FROM figure_counts",
    "char_tfidf_vocab": with_(
        P,
        f"src AS (SELECT paper_idx AS idx, regexp_replace(lower({BLANK}), '{SPACE}{SPACE}+', ' ', 'g') AS t FROM (SELECT paper_idx, full_text AS x FROM p))",
        "g AS (" + " UNION ALL ".join(f"SELECT idx, unnest(list_transform(range(1, length(t) - {n} + 2), lambda i: substring(t, i, {n}))) AS term FROM src WHERE length(t) >= {n}" for n in (3, 4, 5, 6)) + ")",
    )
    + "SELECT term, sum(tf)::BIGINT AS ctf, count(*) AS df FROM (SELECT idx, term, count(*) AS tf FROM g GROUP BY 1, 2) GROUP BY term ORDER BY ctf DESC, term LIMIT 8000",
    "word_tfidf": with_(P, word_cte(f"SELECT paper_idx AS idx, {BLANK} AS text FROM (SELECT paper_idx, full_text AS x FROM p)", True, 5000)) + "SELECT idx AS paper_idx, term, round(w, 6) AS w FROM vec",
    "section_similarity": with_(P, cosines(METHOD_TEXT, 0)) + "SELECT paper_a, paper_b, round(c, 4) AS similarity FROM cos WHERE round(c, 4) > 0",
    "intro_similarity": with_(P, cosines(INTRO_TEXT, 0)) + "SELECT paper_a, paper_b, round(c, 4) AS similarity FROM cos WHERE round(c, 4) > 0",
    "intro_edges": with_(P, cosines(INTRO_TEXT, 0.55)) + "SELECT paper_a, paper_b, round(c, 3) AS weight FROM cos",
    "pair_groups": "WITH RECURSIVE " + ", ".join((P, cosines(INTRO_TEXT, 0.55), "pr AS (SELECT paper_a AS i, paper_b AS j FROM cos)", components_cte("comp", "pr"))) + " SELECT idx, component FROM comp",
    "text_similarity": with_(P, TWO_TEXTS) + "SELECT p.paper_idx, round(CASE WHEN na > 0 AND nb > 0 THEN dot / (na * nb) ELSE 0.0 END, 4) AS similarity FROM p LEFT JOIN dots ON dots.paper_idx = p.paper_idx",
    "similar_pairs": with_(P, SEC, char_pairs("c", exploded("sec", sentence_list("text", 20), "paper_idx, section_ord, section_name", "text"), 3, 6, 8000, 0.65, 500, "section_ord, section_name, "))
    + "SELECT a.paper_idx AS paper_a, a.section_name AS section_name_a, a.pos AS pos_a, b.paper_idx AS paper_b, b.section_name AS section_name_b, b.pos AS pos_b, round(c, 4) AS similarity, left(a.text, 300) AS text_a, left(b.text, 300) AS text_b FROM c_p JOIN c_s a ON a.idx = i JOIN c_s b ON b.idx = j",
    "background_overlap": with_(P, char_pairs("c", exploded("p", sentence_list("introduction", 25), "paper_idx", "text"), 4, 7, 5000, 0.72, 200))
    + "SELECT a.paper_idx AS paper_a, a.pos AS pos_a, b.paper_idx AS paper_b, b.pos AS pos_b, round(c, 4) AS similarity, left(a.text, 300) AS text_a, left(b.text, 300) AS text_b FROM c_p JOIN c_s a ON a.idx = i JOIN c_s b ON b.idx = j WHERE a.paper_idx <> b.paper_idx ORDER BY round(c, 4) DESC, i, j LIMIT 50",
    "boilerplate_groups": boilerplate_sql(BOILERPLATE_SECTIONS),
    "boilerplate_by_section": boilerplate_sql(["methods"]),
    "boilerplate_items": "WITH RECURSIVE " + ", ".join((P, boilerplate_cte(BOILERPLATE_SECTIONS))) + " SELECT section_name, paper_idx, pos, left(text, 400) AS text FROM members",
    "boilerplate_summary": "WITH RECURSIVE " + ", ".join((P, boilerplate_cte(BOILERPLATE_SECTIONS))) + " SELECT count(DISTINCT (section_name, component)) AS total_groups, count(*) AS total_sentences FROM members",
    "paragraphs": with_(P, SEC, PARAGRAPHS) + "SELECT paper_idx, section_name, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS text FROM paras",
    "clean_text": with_(P) + f"SELECT paper_idx, {CLEAN} AS text FROM p",
    "font_headings": with_(LINES, BOUNDARIES) + "SELECT paper_idx, line_no::BIGINT AS line_no, heading FROM bounds WHERE heading IS NOT NULL",
    "section_segments": with_(LINES, BOUNDARIES, SEGMENTS) + "SELECT paper_idx, section_name, max_by(text, part) AS text FROM segs GROUP BY 1, 2",
    "section_coverage_matrix": with_(P) + "SELECT paper_idx, " + ", ".join(f"(length({n}) > 0)::INT AS {n}" for n in COVERED_SECTIONS) + " FROM p",
    "term_labels": f"WITH kt AS ({key_terms_sql('introduction', TERM_STOPS_INTRO, 8, 2)}), named AS (SELECT idx, string_agg({TITLE_CASE}, ' | ' ORDER BY rank) AS label FROM (SELECT *, term AS t FROM kt WHERE rank <= 2) GROUP BY 1) SELECT i.paper_idx AS cluster, coalesce(label, 'Unlabeled cluster') AS label FROM (SELECT DISTINCT paper_idx FROM paper WHERE paper_idx IS NOT NULL) i LEFT JOIN named ON named.idx = i.paper_idx",
    "questions_per_paper": with_(P, question_cte(QUESTION_PATTERNS)) + f"SELECT p.paper_idx, {LABEL_4} AS label, source, coalesce(c, 0)::BIGINT AS question_count FROM p LEFT JOIN (SELECT paper_idx, count(*) AS c FROM questions GROUP BY 1) k ON k.paper_idx = p.paper_idx",
    "chart_similarity": with_(P, cosines(METHOD_TEXT, 0), f"lab AS (SELECT paper_idx, {LABEL_5} AS label FROM p)")
    + "SELECT paper_a, a.label AS label_a, paper_b, b.label AS label_b, round(round(c, 4), 3) AS similarity FROM cos JOIN lab a ON a.paper_idx = paper_a JOIN lab b ON b.paper_idx = paper_b WHERE round(c, 4) > 0",
    "chart_network": with_(P, cosines(INTRO_TEXT, 0.55), f"lab AS (SELECT paper_idx, left({LABEL_4}, 40) AS label FROM p)") + "SELECT paper_a, a.label AS label_a, paper_b, b.label AS label_b, round(c, 3) AS weight FROM cos JOIN lab a ON a.paper_idx = paper_a JOIN lab b ON b.paper_idx = paper_b",
    "problem_focus": with_(P, word_cte("SELECT paper_idx AS idx, abstract || ' ' || introduction AS text FROM p", False, 200))
    + "SELECT idx AS paper_idx, rank, term, round(w, 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY round(w, 9) DESC, term DESC) AS rank FROM vec) WHERE rank <= 10",
    "key_terms_method": key_terms_sql("methods", TERM_STOPS_METHOD, 5, 1),
    "key_terms_intro": key_terms_sql("introduction", TERM_STOPS_INTRO, 8, 2),
    "corpus_counts": with_(P, PROBLEM_CTE.replace("sec AS", "sec1 AS").replace("FROM sec)", "FROM sec1)"), question_cte(QUESTION_PATTERNS).replace("sec AS", "sec2 AS").replace("FROM sec)", "FROM sec2)"), GAPS.replace("sec AS", "sec3 AS").replace("FROM sec)", "FROM sec3)"), METHODS, FIGURES)
    + " UNION ALL ".join(
        f"SELECT '{n}' AS item, count(*) AS n FROM {t}"
        for n, t in (("papers", "p"), ("problem_statements", "problems"), ("open_questions", "questions"), ("research_gaps", "gaps"), ("figures", "figs"), ("shared_methods", "(SELECT DISTINCT method FROM presence)"), ("figure_types", "figure_counts"))
    ),
    "chart_method_presence": with_(P, METHODS) + "SELECT method, sum(present)::BIGINT AS papers FROM presence GROUP BY 1",
    "chart_problem_counts": with_(P, PROBLEM_CTE) + f"SELECT p.paper_idx, left({LABEL_4}, 40) AS label, coalesce(c, 0)::BIGINT AS problem_count FROM p LEFT JOIN (SELECT paper_idx, count(*) AS c FROM problems GROUP BY 1) k ON k.paper_idx = p.paper_idx",
    "chart_question_counts": with_(P, question_cte(QUESTION_PATTERNS)) + "SELECT section_name, count(*) AS questions, count(DISTINCT paper_idx) AS papers FROM questions GROUP BY 1",
    "chart_figure_types": with_(P, FIGURES) + "SELECT figure_type, paper_count FROM figure_counts",
    "chart_section_coverage": with_(P) + "SELECT section_name, sum(present)::BIGINT AS papers FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS section_name, (length({n}) > 0)::INT AS present FROM p" for n in COVERED_SECTIONS) + ") GROUP BY 1",
}
