"""Suffix stripping (Porter, 1980) in SQL, over a vocabulary, for the stemmed ROUGE statement.

Written from the published rules and their common amendments, apart from
``kurzwerk.functions.stem``: every step is a table of (word, w), w being what is left.
"""

from __future__ import annotations

# The rules of the published steps, longest suffix first.
STEP_2 = (
    "ational ate, ization ize, iveness ive, fulness ful, ousness ous, tional tion, biliti ble, "
    "ation ate, alism al, aliti al, iviti ive, entli ent, ousli ous, fulli ful, enci ence, "
    "anci ance, izer ize, alli al, ator ate, logi log, bli ble, eli e"
)
STEP_3 = "icate ic, ative, alize al, iciti ic, ical ic, ness, ful"
STEP_4 = (
    "ement, ance, ence, able, ible, ment, ant, ent, ion, ism, ate, iti, ous, ive, ize, al, er, ic, ou"
)
IRREGULAR = (
    "sky sky, skies sky, dying die, lying lie, tying tie, news news, innings inning, "
    "inning inning, outings outing, outing outing, cannings canning, canning canning, "
    "howe howe, proceed proceed, exceed exceed, succeed succeed"
)


def table(rules: str) -> list[tuple[str, str]]:
    pairs = (rule.split() for rule in rules.split(","))
    return [(p[0], p[1] if len(p) > 1 else "") for p in pairs]


#: Consonants and vowels of w, letter by letter.
SHAPE = (
    "list_reduce(list_concat([''], string_split(w, '')), lambda s, x: s || "
    "CASE WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND s LIKE '%c') THEN 'v' ELSE 'c' END)"
)


def cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def measure(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'v+c+'))"


def short(w: str, shape: str) -> str:
    return f"({shape} = 'vc' OR ({shape} LIKE '%cvc' AND right({w}, 1) NOT IN ('w', 'x', 'y')))"


def step(name: str, before: str, result: str) -> str:
    return f"{name} AS (SELECT word, {result} AS w FROM (SELECT word, w, {SHAPE} AS s FROM {before}))"


def replaced(rules: str, condition) -> str:
    """The first rule whose suffix fits decides; it applies if its condition holds."""
    cases = (
        f"WHEN w LIKE '%{end}' THEN CASE WHEN {condition(end)} "
        f"THEN {cut('w', len(end))} || '{new}' ELSE w END"
        for end, new in table(rules)
    )
    return f"CASE {' '.join(cases)} ELSE w END"


def step_2_condition(end: str) -> str:
    return f"{measure(cut('s', 3 if end == 'logi' else len(end)))} > 0"


def step_4_condition(end: str) -> str:
    letter = " AND regexp_matches(w, '[st]ion$')" if end == "ion" else ""
    return f"{measure(cut('s', len(end)))} > 1{letter}"


def vowel_before(n: int) -> str:
    return f"contains({cut('s', n)}, 'v')"


def stem_ctes(vocabulary: str) -> str:
    """``stems(word, w)`` of all words of the table ``vocabulary(word)``."""
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table(IRREGULAR))
    known = ", ".join(f"'{a}'" for a, _ in table(IRREGULAR))
    plural = f"""CASE WHEN w LIKE '%sses' THEN {cut('w', 2)}
      WHEN w LIKE '%ies' THEN CASE length(w) WHEN 4 THEN {cut('w', 1)} ELSE {cut('w', 2)} END
      WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {cut('w', 1)} ELSE w END"""
    stripped = f"""CASE
      WHEN w LIKE '%ied' THEN CASE length(w) WHEN 4 THEN {cut('w', 1)} ELSE {cut('w', 2)} END
      WHEN w LIKE '%eed' THEN CASE WHEN {measure(cut('s', 3))} > 0 THEN {cut('w', 1)} ELSE w END
      WHEN w LIKE '%ed' AND {vowel_before(2)} THEN {cut('w', 2)} || '|'
      WHEN w LIKE '%ing' AND {vowel_before(3)} THEN {cut('w', 3)} || '|' ELSE w END"""
    # A bar marks what lost its ending; the letters before it are mended.
    mended = f"""CASE WHEN NOT marked THEN w
      WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
      WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND s LIKE '%c'
        THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE {cut('w', 1)} END
      WHEN {measure('s')} = 1 AND {short('w', 's')} THEN w || 'e' ELSE w END"""
    y = f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND {cut('s', 1)} LIKE '%c' THEN {cut('w', 1)} || 'i' ELSE w END"
    # The ending alli becomes al before the other rules of its step are looked at.
    alli = f"CASE WHEN w LIKE '%alli' AND {measure(cut('s', 4))} > 0 THEN {cut('w', 2)} ELSE w END"
    without_e = cut("s", 1)
    e = f"""CASE WHEN w LIKE '%e' AND ({measure(without_e)} > 1
      OR ({measure(without_e)} = 1 AND NOT {short(cut('w', 1), without_e)})) THEN {cut('w', 1)} ELSE w END"""
    ll = f"CASE WHEN w LIKE '%ll' AND {measure(without_e)} > 1 THEN {cut('w', 1)} ELSE w END"
    return ",\n".join(
        [
            f"long_words AS (SELECT word, word AS w FROM {vocabulary} "
            f"WHERE length(word) > 3 AND word NOT IN ({known}))",
            step("stem_1a", "long_words", plural),
            step("stem_1b", "stem_1a", stripped),
            f"stem_1m AS (SELECT word, {mended} AS w FROM (SELECT *, {SHAPE} AS s FROM "
            "(SELECT word, rtrim(w, '|') AS w, w LIKE '%|' AS marked FROM stem_1b)))",
            step("stem_1c", "stem_1m", y),
            step("stem_2a", "stem_1c", alli),
            step("stem_2", "stem_2a", replaced(STEP_2, step_2_condition)),
            step("stem_3", "stem_2", replaced(STEP_3, lambda end: f"{measure(cut('s', len(end)))} > 0")),
            step("stem_4", "stem_3", replaced(STEP_4, step_4_condition)),
            step("stem_5a", "stem_4", e),
            step("stem_5b", "stem_5a", ll),
            f"stems AS (SELECT word, w FROM stem_5b UNION ALL SELECT word, CASE word {irregular} "
            f"ELSE word END FROM {vocabulary} WHERE length(word) <= 3 OR word IN ({known}))",
        ]
    )
