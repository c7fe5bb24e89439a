"""The queries in DuckDB's SQL, written from the operators' definitions: building blocks first, then one statement per query."""

from __future__ import annotations

from ..functions import lexicon as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(e: str, pattern: str, by: str) -> str:
    return f"regexp_replace({e}, {q(pattern)}, {q(by)}, 'g')"


def strip(e: str) -> str:
    return rep(e, r"^\s+|\s+$", "")


def words(e: str) -> str:
    return rf"list_filter(regexp_split_to_array({e}, '\s+'), lambda w: w <> '')"


def tokens(e: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_]+'))"


def names(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


NOT_WORD = r"[^\p{L}\p{N}_]"


def from_text(e: str) -> str:
    for pattern in (r"\[\[?\d+\]?\([^)]*\)\]?", r"\[https?://[^\]]+\]", r"https?://\S+"):
        e = rep(e, pattern, "")
    return strip(rep(rep(e, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def fix_encoding(e: str) -> str:
    return f"replace(translate(nfc_normalize({e}), '‘’“” ', '''''\"\" '), '—', ' — ')"


def strip_noise(e: str) -> str:
    for pattern, by in (
        (r"\[Slide \d+[^\]]*\]", " "),
        (r"https?://\S+", ""),
        (r"(?m)^#+\s+", " "),
        (r"\[[^\]]{0,60}\]", ""),
        (r"\(\d+\)", ""),
        (r"\d+\s*[×x]\s*\d+[\d\s×x]+", " "),
        (r"\.{3,}", "."),
        (r"-{2,}", " "),
    ):
        e = rep(e, pattern, by)
    e = rep(f"replace({e}, ':', ': ')", r": (\s)", r":\1")  # no lookahead here: a space after each colon, then out where one was
    return strip(rep(rep(e, r"[ \t]+", " "), r"\n{2,}", "\n\n"))


def clean_fragment(e: str) -> str:
    e = rep(strip(e), rf"^[{L.BULLETS} ]+", "")
    e = rep(e, r"^[(\[]?[a-zA-Z0-9]{1,2}[.)\]]\s+", "")
    return strip(rep(e, r"\s+\d+\.\s*$", ""))


def expand_bullets(e: str) -> str:
    points = rf"list_filter(list_transform(regexp_split_to_array({e}, '\s*[{L.SPLITTING_BULLETS}]\s*'), lambda c: {clean_fragment('c')}), lambda c: c <> '')"
    return f"(CASE WHEN regexp_matches({e}, '[{L.BULLETS}]') AND len({points}) > 0 THEN {points} ELSE [{e}] END)"


def protect(e: str) -> str:
    for a in L.ABBREVIATIONS:
        pattern = a.replace(".", r"\.")
        e = rep(e, rf"(^|{NOT_WORD})(?i:{pattern})\.", rf"\1{a}<DOT>")
    for _ in range(2):  # neighbours share the white space between them
        e = rep(e, rf"(^|{NOT_WORD})([A-Z])\.\s", r"\1\2<DOT> ")
    return e


def split_sentences(e: str) -> str:
    paragraphs = f"list_filter(list_transform(regexp_split_to_array({e}, '\n\n+'), lambda p: {strip('p')}), lambda p: p <> '')"
    chunks = f"flatten(list_transform({paragraphs}, lambda p: {expand_bullets('p')}))"
    parts = rf"""flatten(list_transform({chunks}, lambda k: string_split(regexp_replace({protect("k")}, '([.!?])\s+([A-Z"(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))))"""
    restored = "replace(f, '<DOT>', '.')"
    return f"list_filter(list_transform({parts}, lambda f: {clean_fragment(restored)}), lambda f: f <> '')"


def all_sentences(source: str) -> str:
    """CTEs up to all_s(doc_id, sent_idx, sentence) from source(doc_id, text)."""
    return f"""c0 AS (SELECT doc_id, {fix_encoding(from_text("text"))} AS t FROM {source}), c1 AS (SELECT doc_id, {strip_noise("t")} AS t FROM c0),
c2 AS (SELECT doc_id, {split_sentences("t")} AS l FROM c1),
all_s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS sent_idx FROM c2)"""


def flags(e: str, w: str) -> dict[str, str]:
    bare = f"""list_transform({w}, lambda x: {rep("lower(x)", r'^[.,;:!?"]+|[.,;:!?"]+$', "")})"""
    verbless = f"NOT list_has_any({bare}, {names(L.HEADING_VERBS)})"
    capitals = rf"(len(list_filter({w}, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / greatest(len({w}), 1))"
    math = rf"len(regexp_extract_all({e}, '[\p{{Sm}}\p{{So}}\p{{Mn}}\x{{1D400}}-\x{{1D7FF}}\x{{0D80}}-\x{{0DFF}}]')) / greatest(length({e}), 1) > 0.015"
    listed = rf"regexp_matches({e}, '[\x{{1D400}}-\x{{1D7FF}}\x{{0D80}}-\x{{0DFF}}{L.MATH_SYMBOLS}]')"
    equation = rf"(regexp_matches({e}, '\d+\s*[=+\-×÷/]\s*\d+') AND len(regexp_extract_all({e}, '[=+×÷]')) / greatest(len({w}), 1) > 0.3)"
    commas = f"length({e}) - length(replace({e}, ',', ''))"
    return {
        "n_words": f"len({w})",
        "letter_share": rf"length(regexp_replace({e}, '[^\p{{L}}]', '', 'g')) / greatest(length({e}), 1)",
        "math": f"({math} OR {listed} OR {equation})",
        "heading": f"""({verbless} AND ((len({w}) <= 15 AND {capitals} > 0.45) OR (len({w}) > 8 AND NOT regexp_matches({e}, '[.!?]$') AND {capitals} > 0.55 AND {commas} >= 2)
                     OR (contains({e}, '"') AND len({w}) <= 12) OR ends_with({e}, ']')))""",
        "numbered": rf"(regexp_matches({e}, '\s+\d+\.\s*$') OR regexp_matches({e}, '^\d+\.\s+[a-z]'))",
        "architecture": rf"(len(list_filter({w}, lambda x: regexp_matches(x, '^[\d×x\-]+$') OR list_contains({names(L.LAYER_NAMES)}, x))) / greatest(len({w}), 1) > 0.35)",
        "numeric": rf"(len(list_filter({w}, lambda x: regexp_matches(regexp_replace(x, '[.,]', '', 'g'), '^\d+$'))) > 0.4 * len({w}))",
    }


_F = flags("sentence", "w")
_GOOD = f"n_words BETWEEN {L.MIN_WORDS} AND {L.MAX_WORDS} AND letter_share >= {L.MIN_LETTER_SHARE} AND distinct_words >= {L.MIN_DISTINCT_WORDS} AND NOT (math OR heading OR numbered OR architecture OR numeric)"
JUDGED = f"""{all_sentences("documents")}, s1 AS (SELECT *, {words("sentence")} AS w FROM all_s),
s2 AS (SELECT doc_id, sent_idx, sentence, {", ".join(f"{e} AS {n}" for n, e in _F.items())}, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS distinct_words FROM s1),
judged AS (SELECT *, {_GOOD} AS good FROM s2)"""
SENTENCES = f"""{JUDGED}, firsts AS (SELECT doc_id, sent_idx, sentence FROM judged WHERE good
            QUALIFY row_number() OVER (PARTITION BY doc_id, left({strip("lower(sentence)")}, 70) ORDER BY sent_idx) = 1),
sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS sent_idx, count(*) OVER (PARTITION BY doc_id) AS n_sentences, sentence FROM firsts)"""

_ENTITY = r"(?i)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b\d{4}\b|\b\d+(?:\.\d+)?\s*%|\b(?:such as|including|for example)\b"
POSITION = "greatest(0.0, 1.0 - CAST(sent_idx AS DOUBLE) * 0.03)"
LENGTH = f"CAST(CASE WHEN len({words('sentence')}) BETWEEN 8 AND 40 THEN 1.0 WHEN len({words('sentence')}) < 8 THEN 0.5 + 0.5 * (len({words('sentence')}) / 8) ELSE greatest(0.4, 1.0 - (len({words('sentence')}) - 40) * 0.02) END AS DOUBLE)"
DENSITY = rf"(len(list_filter({words('lower(sentence)')}, lambda x: regexp_matches(x, '^\p{{L}}+$') AND NOT list_contains({names(L.RANK_STOP_WORDS)}, x))) / greatest(len({words('sentence')}), 1))"
DEFINITION = f"(CASE WHEN regexp_matches(lower(sentence), '(^|{NOT_WORD})({L.DEFINITION_CUES})({NOT_WORD}|$)') THEN CAST(0.15 AS DOUBLE) ELSE 0.0 END)"

TERMS = rf"""{SENTENCES}, with_terms AS (SELECT *, list_filter(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({names(L.RANK_STOP_WORDS)}, x)) AS k FROM sents),
termed AS (SELECT doc_id, sent_idx, n_sentences, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS term FROM with_terms),
tf AS (SELECT doc_id, sent_idx, n_sentences, term, count(*) AS tf FROM termed GROUP BY ALL),
raw AS (SELECT *, (1 + ln(tf)) * (ln((1 + n_sentences) / (1 + count(*) OVER (PARTITION BY doc_id, term))) + 1) AS r FROM tf),
unit AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id, sent_idx)) AS w FROM raw)"""
CENTRAL = f"""{TERMS}, summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, term) AS total FROM unit),
central AS (SELECT s.doc_id, s.sent_idx, s.n_sentences, any_value(s.sentence) AS sentence, count(u.term) AS n_terms,
            coalesce(CASE WHEN s.n_sentences > 1 THEN sum(u.w * u.total - u.w * u.w) / (s.n_sentences - 1) END, 0) AS centrality
            FROM sents s LEFT JOIN summed u ON u.doc_id = s.doc_id AND u.sent_idx = s.sent_idx GROUP BY s.doc_id, s.sent_idx, s.n_sentences)"""


def entity_count(e: str) -> str:
    """Java's and Python's word boundaries know accented letters, RE2's don't: these count as word characters here, too."""
    plain = rep(e, r"[^\x00-\x7F]", "_")
    return f"len(regexp_extract_all({plain}, {q(_ENTITY)}))"


ENTITY = f"least(0.20, CAST({entity_count('sentence')} AS DOUBLE) * 0.05)"
SCORED = f"""{CENTRAL}, summed_up AS (SELECT *, 0.45 * centrality + 0.15 * {POSITION} + 0.15 * {LENGTH} + 0.10 * {DENSITY} + 0.10 * {ENTITY} + 0.05 * {DEFINITION} AS raw_score FROM central),
scored AS (SELECT doc_id, sent_idx, n_sentences, sentence, CASE WHEN n_sentences = 1 THEN 1.0 WHEN max(n_terms) OVER (PARTITION BY doc_id) = 0 THEN 0.5
           ELSE coalesce(raw_score / nullif(max(raw_score) OVER (PARTITION BY doc_id), 0), 0) END AS score FROM summed_up)"""

# The derived sentences.
FACTS = r"""n AS (SELECT n_regionkey, list_sort(list(n_name)) AS n FROM nation GROUP BY 1),
r AS (SELECT CAST(r_regionkey AS BIGINT) AS k, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') AS name, n FROM region JOIN n ON n_regionkey = r_regionkey),
regions AS (SELECT k, unnest(['The region has nations such as ' || n[1] || ', ' || n[2] || ' and ' || n[3] || '.',
   'Trade covers many goods including steel, ' || lower(n[1]) || ' timber, wool in ' || name || '.',
   'Ports of the coast (' || name || ' Port) are busy all year long.',
   'The market is widely known as ' || name || ' exchange floor, or the pit.',
   'Customs stay low - free ' || name || ' harbour rules. They were set in 1984 and cut 12.5% in March 2019.']) AS sentence, unnest(range(0, 5)) AS sent_idx FROM r),
facts AS (SELECT -1 - k AS doc_id, sent_idx, sentence FROM regions UNION ALL
   SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1,
          'The order of the ' || c_mktsegment || ' segment was placed on ' || strftime(o_orderdate, '%B %-d') || ' with ' || lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) || ' priority.'
   FROM orders JOIN customer ON o_custkey = c_custkey)"""
BULLETS = r"""bullets AS (SELECT c_custkey AS doc_id, 'Accounts of ' || c_name || ' • a) open balance ' || CAST(trunc(c_acctbal) AS INT) || ' • 1. Segment ' || c_mktsegment || ' 2.▪ last – point
 
No bullets here. Dr. X. Y. Smith vs. ' || c_name || ' wins. And so on.' AS text FROM customer)""".replace("point\n \nNo", "point\n\nNo")

NO_SPANS = "CAST([] AS VARCHAR[])"


def split_list(e: str) -> str:
    e = rep(rep(e, r"(?i),?\s+and\s+", ", "), r"(?i),?\s+or\s+", ", ")
    return f"list_filter(list_transform(string_split({e}, ','), lambda p: {rep(strip('p'), r'[.,;]+$', '')}), lambda p: length(p) >= 2)"


_SUCH_AS = r"(?i)such as\s+(.+?)(?:\.|,\s+(?:and|but|or)\s+\w+|\s+–|\s+—|\s*$)"
_INCLUDING = r"(?i)including\s+(.+?)(?:\.|,\s+(?:and|but)\s+[a-z]|\s*$)"
_KNOWN_AS = r"(?i)(?:known|referred to|called)\s+as\s+([^,.;]+)"
_DASH = r"[–—-]\s+([^–—.,;]{5,80})"
_DATE = rf"(?i)\b(?:{'|'.join(L.MONTHS)})(?:\s+\d{{1,2}})?(?:,\s*\d{{4}})?\b"


def first(pattern: str) -> str:
    return f"regexp_extract_all(sentence, {q(pattern)}, 1)[1:1]"


_ITEMS = f"flatten(list_transform({first(_INCLUDING)}, lambda m: {split_list('m')}))"
SPANS = {
    "such_as": (f"flatten(list_transform({first(_SUCH_AS)}, lambda m: {split_list('m')}))", "PROPER_NOUN"),
    "including": (f"(CASE WHEN len({_ITEMS}) < 2 THEN {NO_SPANS} ELSE list_concat({_ITEMS}[1:3], CASE WHEN length(array_to_string({_ITEMS}[1:3], ', ')) <= 80 THEN [array_to_string({_ITEMS}[1:3], ', ')] ELSE {NO_SPANS} END) END)", "CONCEPT"),
    "parentheses": (rf"list_transform(regexp_extract_all(sentence, '\(([^)]{{3,60}})\)', 1), lambda m: {strip('m')})", "PROPER_NOUN"),
    "known_as": (f"list_transform({first(_KNOWN_AS)}, lambda m: {strip('m')})", "CONCEPT"),
    "dash": (f"list_transform({first(_DASH)}, lambda m: {strip('m')})", "CONCEPT"),
}
_DATED = rf"list_concat(regexp_extract_all(sentence, '(?i)\bthe\s+\d{{4}}s\b'), regexp_extract_all(sentence, {q(_DATE)}))"
_YEARS = rf"list_filter(regexp_extract_all(sentence, '\b(?:1[5-9]\d{{2}}|20[0-3]\d)\b'), lambda y: len(list_filter({_DATED}, lambda x: contains(x, y))) = 0)"
SPANS["dates"] = (f"list_concat({_DATED}, {_YEARS})", "DATE")
SPANS["percentages"] = (r"regexp_extract_all(sentence, '\b\d+(?:\.\d+)?\s*%')", "NUMBER")


def spans(*kinds: str) -> str:
    each = [f"SELECT doc_id, sent_idx, unnest({SPANS[k][0]}) AS span, '{SPANS[k][1]}' AS type FROM facts" for k in kinds]
    return f"WITH {FACTS} " + " UNION ALL ".join(each)


_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def bare(e: str) -> str:
    return rep(e, f"^{_PUNCTUATION}+|{_PUNCTUATION}+$", "")


def from_first_good(e: str) -> str:
    good = f"list_position(list_transform({e}, lambda b: NOT list_contains({names(L.BAD_LEADS)}, lower(b))), true)"
    return f"(CASE WHEN {good} > 0 THEN {e}[CAST({good} AS BIGINT):] ELSE {NO_SPANS} END)"


def subject(e: str) -> str:
    w = words(e)
    at = f"list_position(list_transform({w}, lambda v: list_contains({names(L.ANSWER_VERBS)}, lower({bare('v')}))), true)"
    before = f"list_filter(list_transform(CASE WHEN {at} > 0 THEN {w}[1:CAST({at} AS BIGINT) - 1] ELSE {w} END, lambda v: {bare('v')}), lambda v: v <> '')"
    return f"array_to_string({from_first_good(before)}, ' ')"


def trim(e: str) -> str:
    lead = from_first_good(words(e))
    tail = f"list_position(list_transform(list_reverse({lead}), lambda t: NOT list_contains({names(L.BAD_TAILS)}, lower(t))), true)"
    kept = f"(CASE WHEN {tail} > 0 THEN {lead}[1:len({lead}) - CAST({tail} AS BIGINT) + 1] ELSE {NO_SPANS} END)"
    return rep(f"array_to_string({kept}, ' ')", r"^[.,;:!?()\-– ]+|[.,;:!?()\-– ]+$", "")


def valid(e: str) -> str:
    w = words(e)
    verb = f"len(list_filter({w}, lambda v: list_contains({names(L.ANSWER_VERBS)}, lower({bare('v')})))) > 0"
    content = rf"len(list_filter({w}, lambda v: regexp_matches(v, '^\p{{L}}{{3,}}$') AND NOT list_contains({names(L.ANSWER_STOP_WORDS)}, lower(v)))) > 0"
    return f"coalesce(length({e}) >= 2 AND NOT {verb} AND NOT list_contains({names(L.BAD_LEADS)}, lower({w}[1])) AND {content} AND NOT (len({w}) = 1 AND list_contains({names(L.JUNK_ANSWERS)}, lower({w}[1]))), false)"


_KINDS = ("such_as", "including", "parentheses", "known_as", "dash")


def accepted(subjects: bool, given: str = FACTS) -> str:
    """CTEs up to kept(doc_id, sent_idx, answer, type, source, score, place): accepted answers without overlaps."""
    layers = [f"list_transform({SPANS[k][0]}, lambda s: {{'span': s, 'type': '{SPANS[k][1]}', 'source': 'PATTERN'}})" for k in _KINDS]
    if subjects:
        layers.append(f"CASE WHEN length({subject('sentence')}) >= 3 THEN [{{'span': {subject('sentence')}, 'type': 'CONCEPT', 'source': 'SUBJECT'}}] ELSE [] END")
    layers += [f"list_transform({SPANS[k][0]}, lambda s: {{'span': s, 'type': '{SPANS[k][1]}', 'source': 'RULE'}})" for k in ("dates", "percentages")]
    joined = layers[0]
    for more in layers[1:]:
        joined = f"list_concat({joined}, {more})"
    n = f"len({words('answer')})"
    base = "0.35 + CASE WHEN type IN ('DATE', 'NUMBER') THEN 0.30 WHEN type = 'CONCEPT' THEN 0.20 ELSE 0.0 END"
    size = f"CASE WHEN {n} BETWEEN 2 AND 6 THEN 0.20 WHEN {n} = 1 AND length(answer) >= 5 THEN 0.08 WHEN {n} > 8 THEN -0.10 ELSE 0.0 END"
    capital = r"CASE WHEN regexp_matches(answer, '^\p{Lu}') AND NOT starts_with(sentence, answer) THEN 0.05 ELSE 0.0 END"
    return f"""{given}, layered AS (SELECT doc_id, sent_idx, sentence, {joined} AS l FROM facts),
proposed AS (SELECT doc_id, sent_idx, sentence, unnest(l) AS c, generate_subscripts(l, 1) AS place FROM layered),
trimmed AS (SELECT doc_id, sent_idx, sentence, place, c.type AS type, c.source AS source, {trim("c.span")} AS answer FROM proposed),
usable AS (SELECT * FROM trimmed WHERE {valid("answer")} QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, answer ORDER BY place) = 1),
graded AS (SELECT *, round_even(greatest(0.0, least(1.0, CAST({base} AS DOUBLE) + {size} + {capital})), 4) AS score FROM usable),
enough AS (SELECT * FROM graded WHERE score >= 0.25),
kept AS (SELECT * FROM enough e WHERE NOT EXISTS (SELECT 1 FROM enough o WHERE o.doc_id = e.doc_id AND o.sent_idx = e.sent_idx AND lower(o.answer) <> lower(e.answer)
         AND contains(lower(o.answer), lower(e.answer))))"""


_CHOSEN = f"""{SCORED}, place AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_idx) AS p FROM scored),
facts AS (SELECT doc_id, sent_idx, sentence FROM place WHERE n_sentences <= 30 OR (p <= 30 AND score >= 0.05))"""
TOPK_DOCUMENTS = f"""{accepted(True, _CHOSEN)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY score DESC, length(answer) DESC, place) - 1 AS ans_rank FROM kept)"""
TOPK = f"""{accepted(True)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY score DESC, length(answer) DESC, place) - 1 AS ans_rank FROM kept),
best AS (SELECT * FROM ranked WHERE ans_rank < 3)"""


def starts(e: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({e}, {q(p)})" for p in prefixes) + ")"


def template(answer: str, kind: str) -> str:
    cases = " ".join(f"WHEN {kind} = '{k}' THEN {q(a)} || {answer} || {q(b)}" for k, (a, b) in L.TEMPLATES.items())
    return f"(CASE {cases} ELSE {q(L.DEFAULT_TEMPLATE[0])} || {answer} || {q(L.DEFAULT_TEMPLATE[1])} END)"


def question_score(question: str, answer: str, score: str, kind: str) -> str:
    expected = "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {q(w)}" for k, w in L.EXPECTED_WORD.items()) + " ELSE 'what' END"
    total = f"""CAST(0.50 AS DOUBLE) + CASE WHEN {starts(f"lower({question})", L.QUESTION_WORDS)} THEN 0.15 ELSE 0.0 END + CASE WHEN ends_with({question}, '?') THEN 0.05 ELSE 0.0 END
 + CASE WHEN len({words(question)}) < 5 THEN -0.15 ELSE 0.0 END + CASE WHEN length({question}) > 120 THEN -0.10 ELSE 0.0 END
 + CASE WHEN starts_with(lower({question}), {expected}) THEN 0.10 ELSE 0.0 END + CASE WHEN NOT contains(lower({question}), lower({answer})) THEN 0.05 ELSE 0.0 END + {score} * 0.10"""
    return f"round_even(greatest(0.0, least(1.0, {total})), 4)"


ASKED = f"""{TOPK}, worded AS (SELECT *, {template("answer", "type")} AS question FROM best),
questions AS (SELECT *, {question_score("question", "answer", "score", "type")} AS question_score FROM worded
              QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, lower(question) ORDER BY ans_rank) = 1)"""

_STEM = strip(rep(rep("lower(question)", r"^(what|who|when|where|which|how|why)\s+(is|are|was|were|does|do|did|has|have)?\s*", ""), r"\?+$", ""))
_TYPE = f"(CASE WHEN {starts('lower(question)', ('who', 'when', 'where', 'which'))} THEN 'factual' WHEN {starts('lower(question)', ('why', 'how', 'explain', 'in what'))} THEN 'analytical' ELSE 'conceptual' END)"


def grade(e: str) -> str:
    w = words(e)
    syllables = f"list_sum(list_transform({w}, lambda v: greatest(1, len(regexp_extract_all(v, '[aeiouAEIOU]+')))))"
    return f"(CASE WHEN len({w}) = 0 THEN 0.0 ELSE greatest(0.0, 0.39 * (len({w}) / greatest(1, len(regexp_extract_all({e}, '[.!?]+')))) + 11.8 * ({syllables} / len({w})) - 15.59) END)"


_DIFFICULTY = f"""(CASE WHEN {starts('lower(question)', L.HARD_PHRASES)} OR (type IN ('CONCEPT', 'OTHER') AND {grade('question')} > 12) THEN 'hard'
 WHEN type IN ('DATE', 'NUMBER', 'PERSON') AND {starts('lower(question)', L.EASY_WORDS)} THEN 'easy' ELSE 'medium' END)"""
_CLAUSES = rf"list_filter(string_split(regexp_replace(regexp_replace(sentence, '([.!?])\s+', '\1' || chr(1), 'g'), ';', chr(1), 'g'), chr(1)), lambda c: contains(lower(c), lower(answer)) AND length({strip('c')}) > 15)"
_EXPLANATION = f"'According to the text: ' || coalesce({rep(strip(_CLAUSES + '[1]'), r'[.,;]+$', '')} || '.', {strip('sentence')})"
_KEY = strip(rep("lower(question)", r"[^\p{L}\p{N}_]+", " "))

FIXED = f"""{ASKED}, only_first AS (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY doc_id, {_KEY} ORDER BY sent_idx, ans_rank) = 1),
optioned AS (SELECT *, [answer, 'April 1', 'early ' || lower(answer), 'the tenth of June'] AS o FROM only_first),
ordered AS (SELECT *, list_transform(list_sort(list_transform(range(1, 5), lambda i: {{'k': md5(question || '|' || o[i]), 'i': i, 'o': o[i]}})), lambda s: s.o) AS options FROM optioned),
built AS (SELECT doc_id, sent_idx, ans_rank, question, options, ['A', 'B', 'C', 'D'][CAST(list_position(options, answer) AS BIGINT)] AS answer, answer AS answer_text, {_EXPLANATION} AS explanation,
          {_TYPE} AS type, {_DIFFICULTY} AS difficulty, question_score AS score, type AS answer_type, sentence AS source_sentence FROM ordered)"""


def similar(o: str) -> str:
    pairs = [(i, j) for i in range(1, 5) for j in range(i + 1, 5)]
    return "(" + " AND ".join(f"{jaccard(tokens(f'{o}[{i}]'), tokens(f'{o}[{j}]'))} >= 0.40" for i, j in pairs) + ")"


_BODY = rep(rep("lower(question)", r"^(what|who|when|where|which|how|why)\b", ""), r"^[ ?]+|[ ?]+$", "")
GOOD = f"""{FIXED}, good AS (SELECT * FROM built WHERE len({words("question")}) >= 5 AND ends_with({strip("question")}, '?') AND NOT {jaccard(tokens(_STEM), tokens("lower(answer_text)"))} > 0.65
 AND NOT {similar("options")} AND NOT (contains({_BODY}, lower(answer_text)) AND len({words("answer_text")}) >= 3))"""


def capped(most: int) -> str:
    return f"""{GOOD}, early AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, ans_rank) AS n FROM good QUALIFY n <= {2 * most}),
items AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n) AS q_idx FROM early QUALIFY q_idx <= {most})"""


ITEMS = capped(20)
_SIZES = f"list_transform(list_filter(options, lambda x: x <> ''), lambda x: len({words('x')}))"
_MEAN = f"(list_sum({_SIZES}) / len({_SIZES}))"
_VARIANCE = f"(list_sum(list_transform({_SIZES}, lambda x: (x - {_MEAN}) * (x - {_MEAN}))) / len({_SIZES}))"
MEASURED = f"""{ITEMS}, each_item AS (SELECT doc_id, score, {_KEY} AS k, CAST(contains(lower(source_sentence), lower(answer_text)) AS INT) AS e, {_VARIANCE} AS v FROM items)"""
_WH = "(CASE " + " ".join(f"WHEN starts_with(lower(question), '{w}') THEN '{w}'" for w in ("what", "who", "when", "where", "why", "how", "which")) + " ELSE 'other' END)"


def stats(key: str) -> str:
    by = f"GROUP BY {key}" if key else ""
    return f"""SELECT {key + "," if key else ""} total, round(a, 3) AS avg_score, round(a * 40 + (1 - d) * 20 + least(1.0, v / 5) * 20 + e * 20, 1) AS quality_score, round(e, 3) AS extractive_rate,
 round(d, 3) AS duplicate_rate, round(v, 2) AS avg_option_length_variance FROM (SELECT {key + "," if key else ""} count(*) AS total, avg(score) AS a, avg(e) AS e, avg(v) AS v, 1 - count(DISTINCT k) / count(*) AS d FROM each_item {by})"""


def title(e: str) -> str:
    return f"(upper(left({e}, 1)) || lower(substr({e}, 2)))"


RESPONSES = f"""{ITEMS}, responses AS (SELECT doc_id, q_idx, answer, ['A', 'B', 'C', 'D'][CAST(((doc_id + q_idx) % 4 + 4) % 4 AS BIGINT) + 1] AS chosen FROM items WHERE ((doc_id + q_idx) % 7 + 7) % 7 <> 0)"""

USERS = "asked AS (SELECT conv_id * 1000 + turn AS q_id, conv_id AS doc_id, min(text) AS question FROM conversations WHERE role = 'user' GROUP BY ALL)"
_PAGE_TERMS = f"list_filter({tokens('question')}, lambda t: NOT list_contains({names(L.PAGE_COMMON_WORDS)}, t))"
_SECTION_TERMS = f"list_filter({tokens('question')}, lambda t: NOT list_contains({names(L.SECTION_COMMON_WORDS)}, t))"


def sentence_ends(e: str) -> str:
    return rf"string_split(regexp_replace({e}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


SECTIONS = f"""{USERS}, about AS (SELECT a.q_id, a.doc_id, a.question, d.text, {_SECTION_TERMS} AS terms, list_filter(list_transform({sentence_ends("d.text")}, lambda s: {strip("s")}), lambda s: length(s) > 20) AS l
           FROM asked a JOIN documents d ON d.doc_id = a.doc_id WHERE {strip("d.text")} <> ''),
each_section AS (SELECT q_id, unnest(l) AS s, generate_subscripts(l, 1) AS i, terms FROM about),
shares AS (SELECT q_id, s, i, len(list_intersect(terms, {tokens("s")})) AS n FROM each_section),
picked AS (SELECT q_id, left(string_agg(s, ' ' ORDER BY n DESC, i), 2500) AS c FROM (SELECT * FROM shares WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY n DESC, i) <= 5) GROUP BY q_id),
contexts AS (SELECT a.q_id, a.doc_id, a.question, CASE WHEN coalesce(c, '') <> '' THEN c ELSE left(text, 2000) END AS context FROM about a LEFT JOIN picked p ON p.q_id = a.q_id)"""
HITS = f"""{USERS}, wanted AS (SELECT q_id, {_PAGE_TERMS} AS t FROM asked), each_term AS (SELECT q_id, len(t) AS n, unnest(t) AS term FROM wanted),
plain AS (SELECT page_id, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages), page_words AS (SELECT page_id, unnest({tokens("text")}) AS term FROM plain),
shared AS (SELECT q_id, page_id, count(*) / any_value(n) AS relevance FROM each_term JOIN page_words USING (term) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY relevance DESC, page_id) AS hit FROM shared QUALIFY hit <= 4)"""


def domain(e: str) -> str:
    return f"(CASE WHEN contains({e}, '//') THEN coalesce(string_split({e}, '/')[3], '') ELSE '' END)"


def skipped(url: str) -> str:
    return "(" + " OR ".join(f"contains({domain(url)}, {q(s)})" for s in L.SKIPPED_SITES) + ")"


_KEYS = ["train a model", "deep neural layer", "a word and its token", "pixel photo vision", "logic agent", "nothing", "model text image"]
_COUNTS = {d: " + ".join(f"CAST(contains(lower(t), {q(k)}) AS INT)" for k in keys) for d, keys in L.DOMAIN_KEYS.items()}
_TOP = "greatest(" + ", ".join(f"n_{d}" for d in _COUNTS) + ")"
_CASES = " ".join(f"WHEN n_{d} = top THEN '{d}'" for d in _COUNTS)
_KINDS6 = "['PERSON', 'LOCATION', 'DATE', 'NUMBER', 'ORGANIZATION', 'CONCEPT']"


def has_verb(w: str) -> str:
    return f"len(list_filter({w}, lambda v: list_contains({names(L.DISTRACTOR_VERBS)}, lower({bare('v')})))) > 0"


def bucket(e: str) -> str:
    return f"(CASE WHEN len({words(e)}) <= 2 THEN 0 WHEN len({words(e)}) <= 5 THEN 1 ELSE 2 END)"


_COMPATIBLE = "CASE " + " ".join(f"WHEN q.type = '{k}' THEN {names((k, *v))}" for k, v in L.COMPATIBLE_TYPES.items()) + " ELSE [q.type] END"
_RAW = "['question: ', '  ''who ', '\"Which ', ''][CAST(sent_idx % 4 AS BIGINT) + 1] || lower(sentence) || ['??', '''', '!', ' '][CAST(sent_idx % 3 AS BIGINT) + 1]"
_C1 = rep(strip("raw"), r"(?i)^question:\s*", "")
_C2 = rep(strip(_C1), "^[\"']+|[\"']+$", "")
_C3 = f"upper(left({_C2}, 1)) || substr({_C2}, 2)"
_CLEAN = rep(rep(_C3, r"[.!?]+$", "") + " || '?'", r"\?{2,}", "?")
_RAW_QUESTION = "'When was segment ' || sent_idx || ' mentioned?'"

ORACLES: dict[str, str] = {
    "source_kind": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'pdf' WHEN p_partkey % 5 IN (1, 4) THEN 'pptx' WHEN p_partkey % 3 = 0 THEN 'pdf' WHEN p_partkey % 3 = 1 THEN 'pptx' ELSE 'text' END AS kind FROM part""",
    "normalise_text": f"SELECT doc_id, {from_text('text')} AS text FROM documents",
    "fix_encoding": f"SELECT doc_id, {fix_encoding('text')} AS text FROM documents",
    "noise_strip": f"WITH d AS (SELECT doc_id, '# Head\n[Slide 3: a:b] see https://x.org/y (12) 13×13 ×256 wait.... a--b c:d\n\n\n\n' || text AS t FROM documents) SELECT doc_id, {strip_noise('t')} AS text FROM d",
    "bullet_expand": f"WITH {BULLETS}, p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\n+')) AS p FROM bullets) SELECT doc_id, unnest({expand_bullets('p')}) AS point FROM p",
    "abbrev_protect": f"SELECT doc_id, {protect('text')} AS text FROM documents",
    "sentence_split": f"WITH {all_sentences('documents')} SELECT doc_id, sent_idx, sentence FROM all_s",
    "sentence_split_bullets": f"WITH {BULLETS}, {all_sentences('bullets')} SELECT doc_id, sent_idx, sentence FROM all_s",
    "sentence_quality": f"WITH {JUDGED} SELECT doc_id, sent_idx, n_words, round(letter_share, 6) AS letter_share, math, heading, numbered, architecture, numeric, good FROM judged",
    "sentence_dedup": f"WITH {SENTENCES} SELECT doc_id, sent_idx, n_sentences, sentence FROM sents",
    "surface_scores": f"WITH {SENTENCES} SELECT doc_id, sent_idx, round({POSITION}, 6) AS position, round({LENGTH}, 6) AS length, round({DENSITY}, 6) AS density, round({ENTITY}, 6) AS entity, round({DEFINITION}, 6) AS definition FROM sents",
    "tfidf_weights": f"WITH {TERMS} SELECT doc_id, sent_idx, term, round(w, 6) AS w FROM unit",
    "sentence_centrality": f"WITH {CENTRAL} SELECT doc_id, sent_idx, round(centrality, 6) AS centrality FROM central",
    "sentence_rank_topk": f"WITH {SCORED} SELECT doc_id, sent_idx, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_idx) <= 5",
    "sentence_selection": f"WITH {SCORED}, place AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_idx) AS p FROM scored) SELECT doc_id, sent_idx FROM place WHERE n_sentences <= 30 OR (p <= 30 AND score >= 0.05)",
    "list_answers": spans("such_as"),
    "including_answers": spans("including"),
    "paren_answers": spans("parentheses"),
    "known_as_answers": spans("known_as"),
    "dash_answers": spans("dash"),
    "date_answers": spans("dates", "percentages"),
    "subject_answers": f"WITH {SENTENCES}, x AS (SELECT doc_id, sent_idx, {subject('sentence')} AS subject FROM sents), y AS (SELECT *, {trim('subject')} AS trimmed FROM x WHERE length(subject) >= 3) SELECT *, {valid('trimmed')} AS valid FROM y",
    "answer_overlap": f"WITH {accepted(False)} SELECT doc_id, sent_idx, answer, type, source, score FROM kept",
    "answer_topk": f"WITH {TOPK} SELECT doc_id, sent_idx, ans_rank, answer, type, source, score FROM best",
    "answer_topk_documents": f"WITH {TOPK_DOCUMENTS} SELECT type, source, count(*) AS n, round(avg(score), 6) AS avg_score FROM ranked WHERE ans_rank < 3 GROUP BY ALL",
    "highlight_input": f"""WITH {TOPK}, x AS (SELECT *, position(lower(answer) IN lower(sentence)) AS pos FROM best) SELECT doc_id, sent_idx, ans_rank, 'generate question: ' || CASE WHEN pos > 0 THEN left(sentence, pos - 1) || '<hl> '
 || substr(sentence, pos, length(answer)) || ' <hl>' || substr(sentence, pos + length(answer)) ELSE sentence || ' <hl> ' || answer || ' <hl>' END AS input FROM x""",
    "question_clean": f"""WITH {FACTS}, x AS (SELECT doc_id, sent_idx, {_RAW} AS raw FROM facts), y AS (SELECT doc_id, sent_idx, {_CLEAN} AS question FROM x)
 SELECT *, len({words("question")}) >= 4 AND ends_with(question, '?') AND {starts("lower(question)", L.QUESTION_WORDS)} AND NOT contains(lower(question), 'the order of the') AS valid FROM y""",
    "question_template": f"""WITH x AS (SELECT s_suppkey, s_name, {_KINDS6}[CAST(s_suppkey % 6 AS BIGINT) + 1] AS type FROM supplier), y AS (SELECT *, {template("s_name", "type")} AS question FROM x)
 SELECT *, {question_score("question", "s_name", "0.6", "type")} AS score FROM y""",
    "question_score": f"WITH {ASKED} SELECT doc_id, sent_idx, ans_rank, question, question_score FROM questions",
    "question_dedup": f"""WITH {TOPK}, worded AS (SELECT *, {_RAW_QUESTION} AS question FROM best) SELECT doc_id, sent_idx, ans_rank, question, {question_score("question", "answer", "score", "type")} AS question_score FROM worded
 QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, lower(question) ORDER BY ans_rank) = 1""",
    "domain_detect": f"""WITH x AS (SELECT doc_id, {names(_KEYS)}[CAST(doc_id % 7 AS BIGINT) + 1] || ' ' || coalesce(text, '') AS t FROM documents), y AS (SELECT doc_id, {", ".join(f"{e} AS n_{d}" for d, e in _COUNTS.items())} FROM x),
 z AS (SELECT *, {_TOP} AS top FROM y) SELECT doc_id, CASE WHEN top = 0 THEN 'ai_general' {_CASES} END AS domain FROM z""",
    "shape_match": f"""WITH {FACTS}, x AS (SELECT doc_id, sent_idx, sentence, r_name, array_to_string({words("sentence")}[5:4 + sent_idx % 7 + 1], ' ') AS span FROM facts JOIN region ON r_regionkey = sent_idx % 5)
 SELECT doc_id, sent_idx, abs({bucket("span")} - {bucket("r_name")}) <= 1 AND regexp_matches(span, '^\\p{{Lu}}') = regexp_matches(r_name, '^\\p{{Lu}}') AND regexp_matches(span, '\\d') = regexp_matches(r_name, '\\d') AND NOT {has_verb(words("span"))} AS same,
 round({jaccard(tokens("span"), tokens("sentence"))}, 6) AS overlap FROM x""",
    "type_pool": f"""WITH {ASKED}, usable_spans AS (SELECT doc_id, sent_idx, ans_rank, answer, type FROM questions WHERE length(answer) >= 3 AND NOT {has_verb(words("answer"))}),
 pooled AS (SELECT q.doc_id, q.sent_idx, q.ans_rank, list(u.answer ORDER BY u.sent_idx, u.ans_rank) FILTER (u.answer IS NOT NULL) AS pool FROM questions q LEFT JOIN usable_spans u ON u.doc_id = q.doc_id AND list_contains({_COMPATIBLE}, u.type)
            AND lower(u.answer) <> lower(q.answer) GROUP BY ALL)
 SELECT doc_id, sent_idx, ans_rank, coalesce(len(pool), 0) AS n, md5(coalesce(array_to_string(pool, '|'), '')) AS pool FROM pooled""",
    "bank_distractors": f"""WITH {ASKED}, counted AS (SELECT doc_id, sent_idx, ans_rank, answer, type, sentence AS t FROM questions), y AS (SELECT *, {", ".join(f"{e} AS n_{d}" for d, e in _COUNTS.items())} FROM counted),
 z AS (SELECT *, {_TOP} AS top FROM y), banked AS (SELECT *, CASE {" ".join(f"WHEN type = '{k}' THEN {names(v)}" for k, v in L.TYPED_BANKS.items())} ELSE CASE CASE WHEN top = 0 THEN 'ai_general' {_CASES} END
 {" ".join(f"WHEN '{k}' THEN {names(v)}" for k, v in L.CONCEPT_BANKS.items())} END END AS items FROM z)
 SELECT doc_id, sent_idx, ans_rank, array_to_string(list_transform(list_sort(list_transform(items, lambda i: {{'k': md5(answer || '|' || i), 'i': i}})), lambda x: x.i), '|') AS bank FROM banked""",
    "embedding_rank": """WITH p AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))
 / sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS c FROM embeddings a JOIN embeddings b USING (label)),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, CAST(other AS VARCHAR)) AS n FROM p WHERE c BETWEEN 0.20 AND 0.82),
 k AS (SELECT vec_id, string_agg(CAST(other AS VARCHAR), '|' ORDER BY n) AS best FROM r WHERE n <= 3 GROUP BY vec_id)
 SELECT e.vec_id, coalesce(best, '') AS best FROM embeddings e LEFT JOIN k USING (vec_id)""",
    "fk_grade": f"WITH {SENTENCES} SELECT doc_id, sent_idx, round({grade('sentence')}, 9) AS grade FROM sents",
    "difficulty_type": f"WITH {ASKED} SELECT doc_id, sent_idx, ans_rank, {_TYPE} AS question_type, {_DIFFICULTY} AS difficulty FROM questions",
    "explanation": f"WITH {ASKED} SELECT doc_id, sent_idx, ans_rank, {_EXPLANATION} AS explanation FROM questions",
    "stem_overlap": f"WITH {ASKED} SELECT doc_id, sent_idx, ans_rank, {_STEM} AS stem, round({jaccard(tokens(_STEM), tokens('answer'))}, 6) AS overlap FROM questions",
    "option_similarity": f"WITH {FIXED} SELECT doc_id, sent_idx, ans_rank, {similar('o')} AS similar FROM optioned",
    "option_order": f"WITH {FIXED} SELECT doc_id, sent_idx, ans_rank, array_to_string(options, '|') AS options, answer FROM built",
    "mcq_quality_filter": f"WITH {GOOD} SELECT doc_id, sent_idx, ans_rank, question, answer, answer_text, type, difficulty, score FROM good",
    "mcq_topk": f"WITH {capped(3)} SELECT doc_id, q_idx, question, answer, score FROM items",
    "mcq_stats": f"WITH {MEASURED} {stats('doc_id')}",
    "mcq_stats_total": f"WITH {MEASURED} {stats('')}",
    "mcq_distributions": f"""WITH {ITEMS}, l AS (SELECT doc_id, unnest([{{'kind': 'type_dist', 'value': type}}, {{'kind': 'difficulty_dist', 'value': difficulty}}, {{'kind': 'wh_word_dist', 'value': {_WH}}}]) AS x FROM items)
 SELECT doc_id, x.kind AS kind, x.value AS value, count(*) AS n FROM l GROUP BY ALL""",
    "mcq_meta": f"""WITH {ITEMS}, t AS (SELECT doc_id, length({from_text("string_agg(sentence, ' ' ORDER BY sent_idx)")}) AS raw_chars, count(*) AS total_sentences FROM facts GROUP BY doc_id),
 a AS (SELECT doc_id, count(*) AS total_answers FROM questions GROUP BY doc_id), i AS (SELECT doc_id, count(*) AS total_questions, avg(score) AS s FROM items GROUP BY doc_id),
 d AS (SELECT doc_id, kind, string_agg(value || ':' || n, ',' ORDER BY value) AS dist FROM (SELECT doc_id, 't' AS kind, type AS value, count(*) AS n FROM items GROUP BY ALL UNION ALL SELECT doc_id, 'd', difficulty, count(*) FROM items GROUP BY ALL) GROUP BY ALL)
 SELECT t.doc_id, coalesce((SELECT dist FROM d WHERE d.doc_id = t.doc_id AND kind = 't'), '') AS type_dist, coalesce((SELECT dist FROM d WHERE d.doc_id = t.doc_id AND kind = 'd'), '') AS diff_dist, raw_chars, total_sentences, coalesce(total_answers, 0) AS total_answers, coalesce(total_questions, 0) AS total_questions, round(coalesce(s, 0), 6) AS avg_score, 'ok' AS status FROM t LEFT JOIN a USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "quiz_score": f"""WITH {RESPONSES}, t AS (SELECT doc_id, count(*) AS answered, count(*) FILTER (chosen = answer) AS correct FROM responses GROUP BY doc_id), p AS (SELECT *, CAST(floor(100 * correct / answered) AS BIGINT) AS percent FROM t)
 SELECT *, CASE WHEN percent >= 80 THEN 'excellent' WHEN percent >= 60 THEN 'good' ELSE 'practice' END AS grade FROM p""",
    "answer_review": f"WITH {RESPONSES} SELECT doc_id, q_idx, chosen, answer, chosen = answer AS correct FROM responses",
    "item_filter": f"WITH {ITEMS} SELECT doc_id, q_idx, type, difficulty FROM items WHERE type = 'factual' AND difficulty = 'easy'",
    "quality_bands": f"WITH {MEASURED} SELECT doc_id, CASE WHEN quality_score >= 70 THEN 'high' WHEN quality_score >= 50 THEN 'medium' ELSE 'low' END AS band FROM ({stats('doc_id')})",
    "export_text_rows": f"""WITH {ITEMS} SELECT doc_id, q_idx, repeat('─', 64) || chr(10) || printf('Q%02d', q_idx) || '  [' || {title("type")} || ']  Difficulty: ' || {title("difficulty")} || '  Score: ' || printf('%.2f', score) || chr(10) || chr(10) || question || chr(10)
 || chr(10) || array_to_string(list_transform(range(1, 5), lambda i: '   ' || ['A', 'B', 'C', 'D'][i] || '.  ' || options[i] || CASE WHEN answer = ['A', 'B', 'C', 'D'][i] THEN '  ✓' ELSE '' END), chr(10)) || chr(10) || chr(10) || '   💡 ' || explanation || chr(10) AS value FROM items""",
    "export_json_rows": f"WITH {ITEMS} SELECT doc_id, q_idx, question, options[1] AS a, options[4] AS d, answer, answer_text, explanation, type, difficulty, round(score, 3) AS score FROM items",
    "export_csv_rows": f"""WITH {ITEMS} SELECT doc_id, q_idx AS "#", question AS "Question", options[1] AS "A", options[2] AS "B", options[3] AS "C", options[4] AS "D", answer AS "Answer", answer_text AS "Answer Text", explanation AS "Explanation",
 type AS "Type", difficulty AS "Difficulty", round(score, 3) AS "Score" FROM items""",
    "export_anki_rows": f"""WITH {ITEMS} SELECT doc_id, q_idx, '<b>' || question || '</b><br>A. ' || options[1] || '<br>B. ' || options[2] || '<br>C. ' || options[3] || '<br>D. ' || options[4] || chr(9) || '<b>Answer: ' || answer || '. '
 || options[CAST(list_position(['A', 'B', 'C', 'D'], answer) AS BIGINT)] || '</b><br><br><i>' || explanation || '</i>' AS value FROM items""",
    "export_gift_rows": f"""WITH {ITEMS} SELECT doc_id, q_idx, '// Question ' || q_idx || chr(10) || '::' || {title("type")} || ' Q' || q_idx || '::[html]' || question || '{{' || chr(10)
 || array_to_string(list_transform(range(1, 5), lambda i: CASE WHEN answer = ['A', 'B', 'C', 'D'][i] THEN '  =' ELSE '  ~' END || options[i]), chr(10)) || chr(10) || '}}' || chr(10) AS value FROM items""",
    "query_terms": f"WITH {USERS} SELECT q_id, len({_PAGE_TERMS}) AS for_pages, len({_SECTION_TERMS}) AS for_sections FROM asked",
    "qa_sections": f"WITH {SECTIONS} SELECT q_id, doc_id, context FROM contexts",
    "qa_keyword_fallback": f"""WITH {SECTIONS}, parts AS (SELECT q_id, question, list_filter({sentence_ends("context")}, lambda s: length(s) >= 20) AS l FROM contexts), each_part AS (SELECT q_id, question, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM parts),
 rated AS (SELECT q_id, s, i, len(list_intersect({tokens("question")}, {tokens("s")})) / greatest(len({tokens("question")}), 1) AS share FROM each_part), top AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY share DESC, i) = 1)
 SELECT c.q_id, CASE WHEN share > 0.1 THEN s ELSE {q(L.NO_ANSWER)} END AS answer FROM contexts c LEFT JOIN top USING (q_id)""",
    "page_domain": f"SELECT page_id, {domain('url')} AS domain, {skipped('url')} AS skipped, {skipped(rep('url', 'example', 'netflix'))} AS skipped_netflix FROM pages",
    "page_relevance": f"WITH {HITS} SELECT q_id, page_id, round(relevance, 6) AS relevance, hit FROM hits",
    "web_context": f"WITH {HITS} SELECT q_id, left(string_agg(text, chr(10) || chr(10) ORDER BY hit), 5000) AS web FROM hits JOIN plain USING (page_id) WHERE hit <= 3 AND relevance > 0.2 GROUP BY q_id",
    "pdf_words": f"""WITH w AS (SELECT l_orderkey AS doc_id, l_suppkey % 2 AS page, l_returnflag || l_partkey AS t, CAST(l_partkey AS DOUBLE) AS x, round_even(l_quantity * 3 / 10, 0) AS band FROM lineitem),
 p AS (SELECT doc_id, page, string_agg(t, ' ' ORDER BY band, x, t) AS t FROM w GROUP BY ALL) SELECT doc_id, {strip("string_agg(t, chr(10) || chr(10) ORDER BY page)")} AS text FROM p GROUP BY doc_id""",
    "slides": """WITH o AS (SELECT *, o_orderkey % 3 + 1 AS slide FROM orders), s AS (SELECT o_custkey AS doc_id, slide, '[Slide ' || slide || ': ' || min(o_orderpriority) || ']' || chr(10)
 || string_agg(o_orderstatus || chr(10) || 'order ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS t FROM o GROUP BY o_custkey, slide) SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY slide) AS text FROM s GROUP BY doc_id""",
}
