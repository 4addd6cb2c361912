"""The registered queries of the phonetic operators, and the SQL that checks them.

All run over whole tables.  Words are the distinct runs of a-z in a text column; marks are appended to some of them so
that every rule of the notation is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoscope.functions import glyphs, notation, prosody, simplify
from phonoscope.functions import syllable_patterns as patterns
from phonoscope.functions.ipa_reader import ipa_to_notation
from phonoscope.functions.rhyme_table import WEIGHTS
from phonoscope.functions.xsampa_table import PAIRS
from phonoscope.operators.lookup import phonetic_lookup, rhyme_score
from phonoscope.plans.ranked import ranked_views
from phonoscope.sources import samples
from phonoscope.sources.tables import glyph_table, simplify_levels, spread, words, xsampa_table

#: Marks appended to words, by length of the word.
SUFFIXES = ("", "^", "_", "h~", "+", "--a&", "u$", "G~", "o$++", "E\\/^", "!", "h!")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.length("word") % len(SUFFIXES) + 1).cast("int"))
    return _words(spark, sf_dir).select(F.concat("word", suffix).alias("word"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = notation.tokens(F.coalesce("text", F.lit("")))
    return _documents(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n_tokens"), F.array_join(parts, " - ").alias("tokens"))


def readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", notation.readable(F.col("text")).alias("readable"))


def machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", notation.machine(F.col("text")).alias("machine"))


def readable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return _marked(spark, sf_dir).select("word", F.array_join(notation.readable_tokens(w), " - ").alias("readable"), F.array_join(notation.machine_tokens(w), " - ").alias("machine"))


def glyph_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyph_table(spark)


def xsampa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xsampa_table(spark)


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simplify_levels(spark)


def ipa_to_xsampa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", notation.ipa_to_xsampa(F.col("text")).alias("xsampa"))


def xsampa_to_ipa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", notation.xsampa_to_ipa(F.col("text")).alias("ipa"))


def xsampa_to_ipa_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", notation.xsampa_to_ipa(F.col("text"), longest_match=True).alias("ipa"))


def notation_to_ipa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("word", notation.notation_to_ipa(F.col("word")).alias("ipa"))


def notation_to_xsampa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("word", notation.notation_to_xsampa(F.col("word")).alias("xsampa"))


def _simplify_query(**level: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        case = simplify.simplify_case(simplify.without_escapes(F.col("word")), **level)
        return _marked(spark, sf_dir).select("word", case.alias("view")).select("word", "view.*")

    return query


CASES = {
    "simplify_consonants": {"consonant": "simplified"},
    "simplify_vowel_none": {"vowel": "none"},
    "simplify_vowel_one": {"vowel": "one"},
    "simplify_vowel_basic": {"vowel": "basic"},
    "simplify_tone": {"tone": "no"},
    "simplify_duration": {"duration": "no"},
    "simplify_aspiration": {"aspiration": "no"},
    "simplify_all_kept": {},
    "simplify_all_reduced": {"vowel": "none", "consonant": "simplified", "tone": "no", "duration": "no", "aspiration": "no"},
}


def _flat_views(views: DataFrame) -> DataFrame:
    named = [F.col("load")[f].alias(f) for f in simplify.CHOICES]
    return views.select("word", "text", "code", F.col("mass").cast("decimal(5,4)").alias("mass"), *named, "place")


def simplify_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_views(ranked_views(_marked(spark, sf_dir).distinct(), ["word"], "word"))


def simplify_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _marked(spark, sf_dir).distinct().select("word", F.posexplode(simplify.simplify(F.col("word"))).alias("at", "v"))
    return _flat_views(views.select("word", "v.*", (F.col("at") + 1).alias("place")))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations that sound like words of part names, by keys of at least half weight."""
    asked = words(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    named = words(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name")
    found = phonetic_lookup(asked, named, min_mass=0.5)
    return found.select("word", "entry", F.col("score").cast("decimal(5,4)").alias("score"))


def lookup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that sound like one another, by all keys; it has no SQL."""
    asked = words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return phonetic_lookup(asked, asked).select("word", "entry", F.col("score").cast("decimal(5,4)").alias("score"))


def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _words(spark, sf_dir).select("word", prosody.syllables(F.col("word")).alias("s"))
    return found.select("word", F.array_join("s", " - ").alias("syllables"), F.size("s").alias("n_syllables"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sounds of each word, and the word written from them."""
    found = _words(spark, sf_dir).select("word", prosody.marks(F.col("word")).alias("m"))
    kinds = F.array_join(F.transform("m", lambda m: F.concat(m["value"], F.lit(":"), m["kind"])), " ")
    return found.select("word", kinds.alias("marks"), prosody.written(F.col("m")).alias("written"))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", notation.escaped(F.col("text")).alias("escaped"))


def ipa_to_notation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("word", ipa_to_notation(F.col("word")).alias("notation"))


def rhyme_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the consonants of each word and its mirror image are."""
    return _words(spark, sf_dir).select("word", F.round(rhyme_score(F.col("word"), F.reverse("word")), 6).alias("score"))


def sample_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine codes of sample words; the results are known, and its SQL holds nothing but them."""
    given = spark.createDataFrame([r[:1] for r in samples.CODES], "word string")
    return given.select("word", F.hex(F.encode(notation.machine(F.col("word")), "UTF-16BE")).alias("codes"))


def sample_ipa(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([r[:1] for r in samples.IPA], "ipa string")
    return given.select("ipa", ipa_to_notation(F.col("ipa")).alias("notation"), notation.ipa_to_xsampa(F.col("ipa")).alias("xsampa"))


def sample_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([r[:1] for r in samples.SYLLABLES], "word string")
    found = given.select("word", prosody.syllables(F.col("word")).alias("s"), notation.notation_to_ipa(F.col("word")).alias("ipa"), prosody.marks(F.col("word")).alias("m"))
    return found.select("word", F.array_join("s", " - ").alias("syllables"), F.size("s").alias("n_syllables"), "ipa", prosody.written(F.col("m")).alias("written"))


def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(w,) for w in dict.fromkeys(r[0] for r in samples.KEYS)], "word string")
    return ranked_views(given, ["word"], "word").select("word", "text", F.col("mass").cast("decimal(5,4)").alias("mass"))


def syllable_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many patterns of consonants and vowels each place in a syllable has."""
    places = (("opening", patterns.OPENING, "OPENING"), ("closing", patterns.CLOSING, "CLOSING"), ("whole", patterns.WHOLE, ""), ("vowels", patterns.VOWELS, ""))
    return spark.createDataFrame([(name, len(patterns.patterns(listed, kind))) for name, listed, kind in places], "place string, n int")


QUERIES = {
    "sample_codes": sample_codes,
    "sample_ipa": sample_ipa,
    "sample_syllables": sample_syllables,
    "sample_keys": sample_keys,
    "syllable_pattern_counts": syllable_pattern_counts,
    "tokens": tokens,
    "readable": readable,
    "machine": machine,
    "readable_words": readable_words,
    "glyph_inventory": glyph_inventory,
    "xsampa_pairs": xsampa_pairs,
    "simplify_levels": levels,
    "ipa_to_xsampa": ipa_to_xsampa,
    "xsampa_to_ipa": xsampa_to_ipa,
    "xsampa_to_ipa_longest": xsampa_to_ipa_longest,
    "notation_to_ipa": notation_to_ipa,
    "notation_to_xsampa": notation_to_xsampa,
    **{name: _simplify_query(**level) for name, level in CASES.items()},
    "simplify_ranked": simplify_ranked,
    "simplify_array": simplify_array,
    "phonetic_lookup": lookup,
    "phonetic_lookup_documents": lookup_documents,
    "marks": marks,
    "syllables": syllables,
    "escaped": escaped,
    "ipa_to_notation": ipa_to_notation_words,
    "rhyme_likeness": rhyme_likeness,
}


# ---- the same in SQL ----


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(value: str, pairs: dict[str, str], otherwise: str) -> str:
    return f"coalesce(MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in pairs.items())}}}[{value}], {otherwise})"


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents"
_MARKED = f"SELECT DISTINCT word || [{', '.join(_q(s) for s in SUFFIXES)}][length(word) % {len(SUFFIXES)} + 1] AS word FROM ({_WORDS})"


def _tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {_q(notation.TOKEN_PATTERN)})"


def _has(mark: str) -> str:
    return f"contains(t, {_q(mark)})"


def _comb(there: str, key: str) -> str:
    return f"CASE WHEN {there} THEN {_q(glyphs.COMBINING[key])} ELSE '' END"


_IS_VOWEL = f"contains('{glyphs.VOWEL_LETTERS}', t[1])"
_TONE = r"regexp_extract(t, '[-+/\\]+')"
_DOTLESS = f"({_has('^')} AND lower(t[1]) = 'i')"
_RHOTIC = f"({_has('$')} AND t[1] = 'u')"
_BASE = f"CASE WHEN {_DOTLESS} THEN 'ï' WHEN {_RHOTIC} THEN 'r' WHEN lower(t[1]) = t[1] THEN t[1] ELSE lower(t[1]) || {_q(glyphs.DOT_BELOW)} END"
_ACCENT = _comb(f"{_has('^')} AND NOT {_DOTLESS}", "^")
_VARIETY = _comb(f"{_has('$')} AND t[1] <> 'u'", "$")
_MIDDLE = " || ".join([*(_comb(_has(m), m) for m in "_!&@"), _case(_TONE, {t: glyphs.COMBINING[t] for t in glyphs.TONES}, "''")])
_READABLE = f"CASE WHEN {_IS_VOWEL} THEN CASE WHEN {_has('!')} THEN {_BASE} || {_ACCENT} || {_MIDDLE} || {_VARIETY} ELSE {_BASE} || {_MIDDLE} || {_VARIETY} || {_ACCENT} END ELSE {_case('t', glyphs.READABLE, 't')} END"


def _absent(mark: str) -> str:
    return f"CASE WHEN {_has(mark)} THEN 0 ELSE 1 END"


_LENGTH = f"CASE WHEN {_has('_')} THEN 0 WHEN {_has('!')} THEN 1 ELSE 2 END"
_TONE_NUMBER = f"coalesce(list_position([{', '.join(map(_q, glyphs.TONES))}], {_TONE}), {len(glyphs.TONES) + 1}) - 1"
_ORDINAL = f"((((((strpos('{glyphs.VOWEL_LETTERS}', t[1]) - 1) * 2 + {_absent('^')}) * 3 + {_LENGTH}) * 2 + {_absent('@')}) * 2 + {_absent('&')}) * 2 + {_absent('$')}) * 11 + {_TONE_NUMBER}"
_MACHINE = f"CASE WHEN {_IS_VOWEL} THEN chr(CAST({_ORDINAL} + {glyphs.FIRST_VOWEL} AS INTEGER)) ELSE {_case('t', glyphs.MACHINE, 't')} END"


def _joined_sql(text: str, form: str) -> str:
    return f"array_to_string(list_transform({_tokens_sql(text)}, lambda t: {form}), '')"


_SOUND = f"(?:{notation._SOUND.replace('(?!h!|[GQ]~)', '')})"
_POST = notation._POSTFIX
#: Without a look ahead: a postfix that follows nothing comes first, so h! and the like are never sounds.
_IPA_TOKENS = rf"(?:{notation._SOUND.replace('(?!h!|[GQ]~)', '')}){_POST}*|{_POST}+|[\s\S]"
_IPA_SPLIT = rf"^({_SOUND})({_POST}*)$"


def _ipa_sql(word: str) -> str:
    core = f"regexp_extract(t, {_q(_IPA_SPLIT)}, 1)"
    ending = f"regexp_extract(t, {_q(_IPA_SPLIT)}, 2)"
    vowel = f"regexp_extract({core}, '^(?:[aeiou]\\$?|[AEIOU])')"
    run = f"regexp_extract({core}, '^(?:[aeiou]\\$?|[AEIOU])&?(-+|\\++)$', 1)"
    tone = f"CASE WHEN {run} = '' THEN '' ELSE {_case(f'{run}[1:2]', notation.IPA_MARKS, 'NULL')} END"
    stress = f"repeat('ˈ', length({ending}) - length(replace({ending}, '^', '')))"
    behind = f"replace({ending}, '^', '')"
    for mark, ipa in notation.IPA_POSTFIXES.items():
        behind = f"replace({behind}, {_q(mark)}, {_q(ipa)})"
    nasal = f"CASE WHEN {core}[length({vowel}) + 1] = '&' THEN {_q(notation.IPA_POSTFIXES['&'])} ELSE '' END"
    voiced = f"{_case(vowel, notation.IPA_VOWELS, 'NULL')} || {nasal}"
    sound = _case(core, notation.IPA_CONSONANTS | notation.IPA_MARKS, "NULL")
    one = f"CASE WHEN {vowel} <> '' AND {run} = '' THEN {stress} || {voiced} || {behind} WHEN {vowel} <> '' THEN {voiced} || {stress} || {tone} || {behind} WHEN regexp_full_match(t, {_q(_POST + '+')}) THEN '' ELSE {stress} || {sound} || {behind} END"
    parts = f"list_transform(regexp_extract_all({word}, {_q(_IPA_TOKENS)}), lambda t: {one})"
    return f"CASE WHEN list_count({parts}) = len({parts}) THEN array_to_string({parts}, '') END"


def _by_character(text: str, pairs: dict[str, str]) -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: {_case('c', pairs, 'c')}), '')"


def _from_xsampa(keys: list[str]) -> str:
    many = "|".join("".join("\\" + c if not c.isalnum() and c not in "_<" else c for c in k) for k in keys if len(k) > 1)
    pattern = _q(rf"{many}|[\s\S]")
    return f"array_to_string(list_transform(regexp_extract_all(text, {pattern}), lambda c: {_case('c', {k: notation.XSAMPA_TO_IPA[k] for k in keys}, 'c')}), '')"


def _rewrite_sql(feature: str, choice: str, t: str) -> str:
    sub = lambda t, p, r, flags="g": f"regexp_replace({t}, {_q(p)}, {_q(r)}, '{flags}')"
    rep = lambda t, a, b: f"replace({t}, {_q(a)}, {_q(b)})"
    if feature == "consonant":
        for a, b in simplify.CONSONANT_TEXTS:
            t = rep(t, a, b)
        for p, r in simplify.CONSONANT_PATTERNS:
            t = sub(t, p, r, "gi")
        return t
    if feature == "vowel":
        t = rep(t, simplify.RHOTIC, simplify.HELD)
        if choice == "none":
            return rep(sub(t, r"[aeiou][$^&_+\-!@]*", "", "gi"), simplify.HELD, simplify.RHOTIC)
        t = sub(t, r"([aeiou])\$", r"\1", "gi")
        if choice == "one":
            return sub(rep(sub(t, r"[aeiou][\^&_+\-!@]*", "a", "gi"), simplify.HELD, simplify.RHOTIC), "a+", "a")
        t = f"translate({sub(t, r'([aeiou])[\^&_+\-!@]*', r'\1', 'gi')}, 'AEIOU', 'aeiou')"
        for v in "aeiou":
            t = sub(t, f"{v}+", v)
        for a, b in simplify.DIPHTHONGS:
            t = rep(t, a, b)
        return rep(t, simplify.HELD, simplify.RHOTIC)
    return sub(t, "[-+]+", "") if feature == "tone" else rep(t, "h~" if feature == "aspiration" else "_", "")


def _levels_sql(source: str, word: str = "word") -> str:
    """CTEs that expand a relation of words to its levels, feature by feature; the last is named levels."""
    escaped = _q("=[^\\n\\r  ]")
    ctes = [f"l0 AS (SELECT {word} AS word, regexp_replace({word}, {escaped}, '', 'g') AS text, 1::BIGINT AS raw, 0 AS ordinal FROM ({source}))"]
    for n, feature in enumerate(simplify.ORDER):
        arms = []
        for k, choice in enumerate(simplify.CHOICES[feature]):
            step, weight = k * simplify.step_size(feature), simplify.WEIGHTS[feature][choice]
            if choice == simplify.KEPT[feature]:
                arms.append(f"SELECT word, text, raw * {weight} AS raw, ordinal + {step} AS ordinal FROM l{n}")
            else:
                arms.append(f"SELECT word, new AS text, CASE WHEN new <> text THEN raw * {weight} ELSE raw END AS raw, ordinal + {step} AS ordinal FROM (SELECT *, {_rewrite_sql(feature, choice, 'text')} AS new FROM l{n})")
        ctes.append(f"l{n + 1} AS ({' UNION ALL '.join(arms)})")
    return ", ".join([*ctes, f"levels AS (SELECT * FROM l{len(simplify.ORDER)})"])


def _choice_sql(feature: str) -> str:
    return f"[{', '.join(map(_q, simplify.CHOICES[feature]))}][ordinal // {simplify.step_size(feature)} % {len(simplify.CHOICES[feature])} + 1] AS {feature}"


def _views_sql(prefix: str) -> str:
    """CTEs from levels to views: word, text, raw, ordinal, seen, mass."""
    return f"""{prefix}best AS (SELECT word, text, max(raw) AS raw, min(ordinal) AS seen FROM {prefix}levels GROUP BY word, text HAVING text <> ''),
{prefix}views AS (SELECT b.word, b.text, b.raw, b.seen, (SELECT min(l.ordinal) FROM {prefix}levels l WHERE l.word = b.word AND l.text = b.text AND l.raw = b.raw) AS ordinal,
  CAST(floor((20000 * (b.raw - min(b.raw) OVER w + 1) + (max(b.raw) OVER w - min(b.raw) OVER w + 1)) / (2 * (max(b.raw) OVER w - min(b.raw) OVER w + 1))) / 10000.0 AS DECIMAL(5,4)) AS mass
  FROM {prefix}best b WINDOW w AS (PARTITION BY b.word))"""


_RANKED = f"""
WITH {_levels_sql(_MARKED)}, {_views_sql('')}
SELECT word, text, {_joined_sql('text', _MACHINE)} AS code, mass, {', '.join(_choice_sql(f) for f in simplify.CHOICES)},
       row_number() OVER (PARTITION BY word ORDER BY raw DESC, seen) AS place
FROM views
"""


def _case_sql(level: dict[str, str]) -> str:
    ctes = [f"c0 AS (SELECT word, word AS text, 1::BIGINT AS raw FROM ({_MARKED}))"]
    for n, feature in enumerate(simplify.ORDER):
        choice = level.get(feature, simplify.KEPT[feature])
        weight = simplify.WEIGHTS[feature][choice]
        if choice == simplify.KEPT[feature]:
            ctes.append(f"c{n + 1} AS (SELECT word, text, raw * {weight} AS raw FROM c{n})")
        else:
            ctes.append(f"c{n + 1} AS (SELECT word, new AS text, CASE WHEN new <> text THEN raw * {weight} ELSE raw END AS raw FROM (SELECT *, {_rewrite_sql(feature, choice, 'text')} AS new FROM c{n}))")
    return f"WITH {', '.join(ctes)} SELECT word, text, {_joined_sql('text', _MACHINE)} AS code, raw FROM c{len(simplify.ORDER)}"


def _keys_sql(name: str, source: str) -> str:
    plain = _levels_sql(source).replace("levels AS", f"{name}levels AS")
    for n in range(len(simplify.ORDER), -1, -1):
        plain = plain.replace(f"l{n} AS (", f"{name}{n} AS (").replace(f"FROM l{n})", f"FROM {name}{n})").replace(f"FROM l{n} ", f"FROM {name}{n} ").replace(f"FROM l{n}", f"FROM {name}{n}")
    return f"{plain}, {_views_sql(name)}"


_ASKED = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations"
_NAMED = "SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS word FROM part"
_LOOKUP = f"""
WITH {_keys_sql('a', _ASKED)}, {_keys_sql('b', _NAMED)}
SELECT a.word, b.word AS entry, max(least(a.mass, b.mass)) AS score
FROM aviews a JOIN bviews b ON a.text = b.text AND a.mass >= 0.5 AND b.mass >= 0.5
GROUP BY a.word, b.word
"""

_LETTERS_AS_IPA = {"y": "i$", "x": "H", "c": "ky~", "q": "K", "j": "y"}
_RHYME_SOUNDS = "regexp_extract_all({}, '[mnNgbptdkslrhfvwz]')"
_RHYME = f"""
SELECT word, CASE WHEN len(a) > 0 THEN round(list_sum(list_transform(list_zip(a, b), lambda p: {_case('p[1] || p[2]', {p + q: str(w) for p, q, w in WEIGHTS}, "'0'")}::DOUBLE)) / len(a), 6) END AS score
FROM (SELECT word, {_RHYME_SOUNDS.format('word')} AS a, {_RHYME_SOUNDS.format('reverse(word)')} AS b FROM ({_WORDS}))
"""


def _inventory_sql() -> str:
    marks = [("",), tuple(glyphs.VARIANT), tuple(glyphs.NASAL), tuple(glyphs.SYLLABIC), glyphs.TONES, glyphs.LENGTHS, tuple(glyphs.ACCENT)]
    froms = ", ".join(f"(SELECT unnest([{', '.join(map(_q, ('', *m) if k else tuple(glyphs.VOWEL_LETTERS)))}]) AS m{k})" for k, m in enumerate(marks))
    vowels = f"SELECT {' || '.join(f'm{k}' for k in range(len(marks)))} AS t FROM {froms}"
    others = f"SELECT unnest([{', '.join(map(_q, glyphs.READABLE))}]) AS t"
    return f"SELECT t AS key, {_READABLE} AS readable, {_MACHINE} AS machine FROM ({vowels} UNION ALL {others})"


def _values(rows: list[tuple] | tuple, columns: str) -> str:
    value = lambda v: "NULL" if v is None else _q(v) if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) t({columns})"


ORACLES = {
    "sample_codes": _values(samples.CODES, "word, codes"),
    "sample_ipa": _values(samples.IPA, "ipa, notation, xsampa"),
    "sample_syllables": f"SELECT *, replace(syllables, ' - ', '') AS written FROM ({_values(samples.SYLLABLES, 'word, syllables, n_syllables, ipa')})",
    "sample_keys": f"SELECT word, text, CAST(mass AS DECIMAL(5,4)) AS mass FROM ({_values(samples.KEYS, 'word, text, mass')})",
    "syllable_pattern_counts": "SELECT * FROM (VALUES ('opening', 276), ('closing', 1128), ('whole', 48), ('vowels', 75)) t(place, n)",
    "tokens": f"SELECT doc_id, len({_tokens_sql('text')}) AS n_tokens, array_to_string({_tokens_sql('text')}, ' - ') AS tokens FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "readable": f"SELECT doc_id, {_joined_sql('text', _READABLE)} AS readable FROM documents",
    "machine": f"SELECT doc_id, {_joined_sql('text', _MACHINE)} AS machine FROM documents",
    "readable_words": f"SELECT word, {_joined_sql('word', _READABLE)[:-3]}' - ') AS readable, {_joined_sql('word', _MACHINE)[:-3]}' - ') AS machine FROM ({_MARKED})",
    "glyph_inventory": _inventory_sql(),
    "xsampa_pairs": f"SELECT * FROM (VALUES {', '.join(f'({k}, {_q(x)}, {_q(i)})' for k, (x, i) in enumerate(PAIRS))}) t(place, xsampa, ipa)",
    "simplify_levels": f"SELECT ordinal, {', '.join(_choice_sql(f) for f in simplify.CHOICES)} FROM (SELECT unnest(range(64))::INTEGER AS ordinal)",
    "ipa_to_xsampa": f"SELECT doc_id, {_by_character('text', notation.IPA_TO_XSAMPA)} AS xsampa FROM documents",
    "xsampa_to_ipa": f"SELECT doc_id, {_from_xsampa(notation.live_keys())} AS ipa FROM documents",
    "xsampa_to_ipa_longest": f"SELECT doc_id, {_from_xsampa(sorted(notation.XSAMPA_TO_IPA, key=len, reverse=True))} AS ipa FROM documents",
    "notation_to_ipa": f"SELECT word, {_ipa_sql('word')} AS ipa FROM ({_MARKED})",
    "notation_to_xsampa": f"SELECT word, CASE WHEN ipa IS NOT NULL THEN {_by_character('ipa', notation.IPA_TO_XSAMPA)} END AS xsampa FROM (SELECT word, {_ipa_sql('word')} AS ipa FROM ({_MARKED}))",
    **{name: _case_sql(level) for name, level in CASES.items()},
    "simplify_ranked": _RANKED,
    "simplify_array": _RANKED,
    "phonetic_lookup": _LOOKUP,
    "marks": f"SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c: c || CASE WHEN contains('aeiou', c) THEN ':vowel' ELSE ':consonant' END), ' ') AS marks, word AS written FROM ({_WORDS})",
    "escaped": r"SELECT doc_id, regexp_replace(text, '([-/\\^$*+?.()|\[\]{}])', '\\\1', 'g') AS escaped FROM documents",
    "ipa_to_notation": f"SELECT word, {_by_character('word', _LETTERS_AS_IPA)} AS notation FROM ({_WORDS})",
    "rhyme_likeness": _RHYME,
}
