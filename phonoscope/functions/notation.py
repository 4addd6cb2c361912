"""The ASCII notation as column expressions: tokens, readable and machine forms, IPA and X-SAMPA.

Everything here is a Catalyst expression over one string column; a null gives null, the empty string an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonoscope.functions import glyphs
from phonoscope.functions.xsampa_table import PAIRS

TONE_PATTERN = r"(?:--|-|\+\+|\+|//|/\\|/|\\/|\\\\|\\)"
VOWEL_PATTERN = rf"[{glyphs.VOWEL_LETTERS}]\$?&?@?{TONE_PATTERN}?[_!]?\^?"
_OTHERS = "|".join(re.sub(r"([^A-Za-z0-9 '@=<>~!])", r"\\\1", k) for k in sorted(glyphs.READABLE, key=len, reverse=True))
#: The longest glyph at each place, or else any one character.
TOKEN_PATTERN = rf"{VOWEL_PATTERN}|{_OTHERS}|[\s\S]"
#: What becomes of a character that begins no glyph.
KEEP, NULL, ERROR = "keep", "null", "error"


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _lookup(token: Column, pairs: dict[str, str]) -> Column:
    """The value of a token or null: by code for one ASCII character, which most tokens are, else in a small map."""
    by_code = F.array(*[F.lit(pairs.get(chr(c))) for c in range(128)])
    others = {k: v for k, v in pairs.items() if len(k) != 1 or ord(k) > 127}
    return F.when((F.length(token) == 1) & (F.ascii(token) < 128), F.get(by_code, F.ascii(token))).otherwise(_literal_map(others)[token])


def _has(token: Column, mark: str) -> Column:
    return F.instr(token, mark) > 0


def _is_vowel(token: Column) -> Column:
    return F.instr(F.lit(glyphs.VOWEL_LETTERS), F.substring(token, 1, 1)) > 0


def _tone(token: Column) -> Column:
    return F.regexp_extract(token, r"[-+/\\]+", 0)


def _unmatched(token: Column, policy: str) -> Column:
    if policy == KEEP:
        return token
    if policy == NULL:
        return F.lit(None).cast("string")
    return F.raise_error(F.concat(F.lit("no glyph begins with: "), token)).cast("string")


def tokens(text: Column) -> Column:
    """Keys of the glyphs in a text; a character that begins none is a token of its own."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def _readable_vowel(token: Column) -> Column:
    letter = F.substring(token, 1, 1)
    small = F.lower(letter)
    accented, variant = _has(token, glyphs.ACCENT), _has(token, glyphs.VARIANT)
    dotless = accented & (small == "i")
    base = F.when(dotless, glyphs.STRESSED_I).when(variant & (letter == "u"), glyphs.RHOTIC).when(letter == small, letter).otherwise(F.concat(small, F.lit(glyphs.DOT_BELOW)))
    mark = lambda there, key: F.when(there, glyphs.COMBINING[key]).otherwise("")
    accent = mark(accented & ~dotless, glyphs.ACCENT)
    variety = mark(variant & (letter != "u"), glyphs.VARIANT)
    short = _has(token, "!")
    tone = F.coalesce(_literal_map({t: glyphs.COMBINING[t] for t in glyphs.TONES})[_tone(token)], F.lit(""))
    middle = F.concat(mark(_has(token, "_"), "_"), mark(short, "!"), mark(_has(token, glyphs.NASAL), glyphs.NASAL), mark(_has(token, glyphs.SYLLABIC), glyphs.SYLLABIC), tone)
    return F.when(short, F.concat(base, accent, middle, variety)).otherwise(F.concat(base, middle, variety, accent))


def readable_token(token: Column, unmatched: str = KEEP) -> Column:
    """The form of one token with letters and combining marks."""
    bare = {c: c if c.islower() else c.lower() + glyphs.DOT_BELOW for c in glyphs.VOWEL_LETTERS}
    return F.coalesce(_lookup(token, glyphs.READABLE | bare), F.when(_is_vowel(token), _readable_vowel(token)), _unmatched(token, unmatched))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def vowel_ordinal(token: Column) -> Column:
    """The place of a vowel's marks among all combinations, in the order in which machine codes are given out."""
    letter = F.instr(F.lit(glyphs.VOWEL_LETTERS), F.substring(token, 1, 1)) - 1
    absent = lambda mark: F.when(_has(token, mark), 0).otherwise(1)
    length = F.when(_has(token, "_"), 0).when(_has(token, "!"), 1).otherwise(len(glyphs.LENGTHS))
    tone = F.coalesce(F.create_map(*[F.lit(x) for k, t in enumerate(glyphs.TONES) for x in (t, k)])[_tone(token)], F.lit(len(glyphs.TONES)))
    place = letter * 2 + absent(glyphs.ACCENT)
    for choices, digit in ((3, length), (2, absent(glyphs.SYLLABIC)), (2, absent(glyphs.NASAL)), (2, absent(glyphs.VARIANT)), (len(glyphs.TONES) + 1, tone)):
        place = place * choices + digit
    return place


def _bare_codes() -> dict[str, str]:
    """The codes of vowels without marks."""
    unmarked = 2 * 3 * 2 * 2 * 2 * (len(glyphs.TONES) + 1)  # codes for each letter, the last without any mark
    return {c: chr(glyphs.FIRST_VOWEL + (k + 1) * unmarked - 1) for k, c in enumerate(glyphs.VOWEL_LETTERS)}


def machine_token(token: Column, unmatched: str = KEEP) -> Column:
    """The one-character code of one token."""
    coded = F.when(_is_vowel(token), _character(vowel_ordinal(token) + glyphs.FIRST_VOWEL))
    return F.coalesce(_lookup(token, glyphs.MACHINE | _bare_codes()), coded, _unmatched(token, unmatched))


def readable_tokens(text: Column, unmatched: str = KEEP) -> Column:
    return F.transform(tokens(text), lambda t: readable_token(t, unmatched))


def machine_tokens(text: Column, unmatched: str = KEEP) -> Column:
    return F.transform(tokens(text), lambda t: machine_token(t, unmatched))


def _joined(parts: Column, policy: str) -> Column:
    """One string; under the policy NULL a null part makes it null."""
    whole = F.array_join(parts, "")
    return F.when(~F.exists(parts, lambda p: p.isNull()), whole) if policy == NULL else whole


#: Characters that come second in some glyph: before any of them a character may begin a longer glyph.
_SECOND = "".join(sorted({k[1] for k in glyphs.READABLE if len(k) > 1} | set(glyphs.VARIANT + glyphs.NASAL + glyphs.SYLLABIC + glyphs.ACCENT + "".join(glyphs.TONES) + "".join(glyphs.LENGTHS))))


def _class(characters: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in characters)


def _by_stretch(text: Column, single: dict[str, str], form: Callable[[Column], Column]) -> Column:
    """Stretches of characters that stand for themselves as one token each, rewritten at once; all else token by token.

    single: what becomes of glyphs of one character where no mark follows; characters that begin no glyph stay.
    A stretch ends before a character that a mark follows, so it never cuts a glyph.
    """
    plain = {k: v for k, v in single.items() if len(v) == 1}
    stops = _SECOND + "=" + "".join(k for k in single if k not in plain)
    parts = F.regexp_extract_all(text, F.lit(rf"[^{_class(stops)}]+(?![{_class(_SECOND)}])|{TOKEN_PATTERN}"), F.lit(0))
    moved = {k: v for k, v in plain.items() if k != v}
    rewritten = lambda t: F.translate(t, "".join(moved), "".join(moved.values())) if moved else t
    glyph = lambda t: (F.instr(F.lit(stops), F.substring(t, 1, 1)) > 0) | ((F.length(t) > 1) & (F.instr(F.lit(_SECOND), F.substring(t, 2, 1)) > 0))
    return F.array_join(F.transform(parts, lambda t: F.when(glyph(t), form(t)).otherwise(rewritten(t))), "")


def readable(text: Column, unmatched: str = KEEP) -> Column:
    """A text of the notation with letters and combining marks."""
    if unmatched != KEEP:
        return _joined(readable_tokens(text, unmatched), unmatched)
    bare = {c: c if c.islower() else c.lower() + glyphs.DOT_BELOW for c in glyphs.VOWEL_LETTERS}
    return _by_stretch(text, {k: v for k, v in (glyphs.READABLE | bare).items() if len(k) == 1}, readable_token)


def machine(text: Column, unmatched: str = KEEP) -> Column:
    """A text of the notation with one character for each glyph."""
    if unmatched != KEEP:
        return _joined(machine_tokens(text, unmatched), unmatched)
    return _by_stretch(text, {k: v for k, v in (glyphs.MACHINE | _bare_codes()).items() if len(k) == 1}, machine_token)


# IPA of vowels, of consonants, and of marks that are sounds or tones of their own.
IPA_VOWELS = {"a": "a", "a$": "œ", "A": "æ", "e": "e", "e$": "ø", "E": "ɛ", "i": "i", "i$": "ɨ", "I": "ɪ", "o": "o", "o$": "ɔ", "O": "ʊ", "u": "u", "u$": "ɹ", "U": "ə"}
IPA_CONSONANTS = {
    "b?": "ɓ", "d?": "ɗ", "d*": "ǂ", "g?": "ɠ", "h~": "ʰ", "k*": "ǃ", "l*": "ǁ", "p*": "ʘ", "t*": "ǀ", "w~": "ʷ", "y~": "ʲ", "C~": "ð",
    "b": "b", "c": "θ", "C": "ð", "d": "d", "D": "ɖ", "f": "f", "F": "ɸ", "g": "g", "G": "ʁ", "h": "h", "H": "χ", "j": "ʒ", "J": "ʐ", "k": "k",
    "K": "q", "l": "l", "L": "ɭ", "m": "m", "n": "n", "N": "ɳ", "p": "p", "q": "ŋ", "Q": "ʕ", "r": "r", "R": "ɽ", "s": "s", "S": "ɬ", "t": "t",
    "T": "ʈ", "v": "v", "V": "ʋ", "w": "w", "W": "ɰ", "x": "ʃ", "X": "ʂ", "y": "j", "z": "z", "Z": "ɮ", "'": "ʔ",
}
IPA_MARKS = {
    "--": "˩", "-": "˨", "++": "˥", "+": "˦", "//": "˩˥", "/\\": "˩˥˩", "/": "˧˥", "\\\\": "˥˩", "\\/": "˥˩˥", "\\": "˥˧",
    "!": "ʼ", ".": "̚", "~": "̪", "@": "͈", "_": "ː",
}
#: Marks that change the sound before: stress goes before it, the others behind.
IPA_STRESS = "ˈ"
IPA_POSTFIXES = {"&": "̰", "G~": "ˠ", "Q~": "ˤ", "h!": "̥"}
# End of fixed values.

_POSTFIX = r"(?:[&^]|G~|Q~|h!)"
_SOUND = r"(?:[aeiou]\$?|[AEIOU])&?(?:-+|\++)?|[bdg]\?|[dklpt]\*|[hwyC]~|(?!h!|[GQ]~)[bcCdDfFgGhHjJkKlLmnNpqQrRsStTvVwWxXyzZ']|--|-|\+\+|\+|//|/\\|/|\\\\|\\/|\\|[!.~@_]"
#: A sound with the marks that change it; marks at the beginning of a text, which change nothing; any other character.
IPA_TOKEN_PATTERN = rf"(?:{_SOUND}){_POSTFIX}*|{_POSTFIX}+|[\s\S]"


def _ipa_token(token: Column, on_error: str) -> Column:
    ending = F.regexp_extract(token, rf"^(?:{_SOUND})({_POSTFIX}*)$", 1)
    core = F.substring(token, F.lit(1), F.length(token) - F.length(ending))
    vowel = F.regexp_extract(core, r"^(?:[aeiou]\$?|[AEIOU])", 0)
    run = F.regexp_extract(core, r"^(?:[aeiou]\$?|[AEIOU])&?(-+|\++)$", 1)
    tone = F.when(run == "", "").when(F.length(run) == 1, _literal_map(IPA_MARKS)[run]).otherwise(_literal_map(IPA_MARKS)[F.substring(run, 1, 2)])
    sound = _literal_map(IPA_CONSONANTS | IPA_MARKS)[core]
    stressed = F.when(_has(ending, "^"), F.repeat(F.lit(IPA_STRESS), F.length(ending) - F.length(F.replace(ending, F.lit("^"), F.lit(""))))).otherwise("")
    behind = F.replace(ending, F.lit("^"), F.lit(""))
    for mark, ipa in IPA_POSTFIXES.items():
        behind = F.replace(behind, F.lit(mark), F.lit(ipa))
    nasal = F.when(F.substring(core, F.length(vowel) + 1, F.lit(1)) == "&", IPA_POSTFIXES["&"]).otherwise("")
    voiced = F.concat(_literal_map(IPA_VOWELS)[vowel], nasal)
    spoken = F.when(run == "", F.concat(stressed, voiced, behind)).otherwise(F.concat(voiced, stressed, tone, behind))
    missing = F.lit(None).cast("string") if on_error == NULL else F.raise_error(F.concat(F.lit("Error with part: "), token)).cast("string")
    return (
        F.when(vowel != "", spoken)
        .when(sound.isNotNull(), F.concat(stressed, sound, behind))
        .when(token.rlike(rf"^{_POSTFIX}+$"), F.lit(""))
        .otherwise(missing)
    )


def notation_to_ipa(text: Column, on_error: str = NULL) -> Column:
    """IPA of a text of the notation; a character without a sound makes it null, or an error where on_error says so.

    A postfix mark changes the sound or tone right before it, so stress after a long vowel stands before the
    length mark.  Marks before any sound are dropped.
    """
    parts = F.transform(F.regexp_extract_all(text, F.lit(IPA_TOKEN_PATTERN), F.lit(0)), lambda t: _ipa_token(t, on_error))
    return _joined(parts, NULL)


#: The later of repeated symbols counts, and symbols without a counterpart vanish.
IPA_TO_XSAMPA = {ipa: xsampa for xsampa, ipa in PAIRS if ipa}
XSAMPA_TO_IPA = {xsampa: ipa for xsampa, ipa in PAIRS if xsampa}


def live_keys() -> list[str]:
    """X-SAMPA keys that an ordered alternation can reach: digits come first, and a key behind one of its prefixes never matches."""
    keys = sorted((k for k in XSAMPA_TO_IPA if k.isdigit()), key=int) + [k for k in XSAMPA_TO_IPA if not k.isdigit()]
    return [k for n, k in enumerate(keys) if not any(k.startswith(p) for p in keys[:n])]


def ipa_to_xsampa(text: Column) -> Column:
    """X-SAMPA of IPA, character by character; unknown characters stay."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(_lookup(c, IPA_TO_XSAMPA), c)), "")


def xsampa_to_ipa(text: Column, longest_match: bool = False) -> Column:
    """IPA of X-SAMPA; unknown characters stay.

    Keys are tried in table order, so most keys of several characters are hidden by their first character;
    longest_match, an extension, reaches all keys.
    """
    keys = sorted(XSAMPA_TO_IPA, key=len, reverse=True) if longest_match else live_keys()
    many = "|".join(r"\Q" + k + r"\E" for k in keys if len(k) > 1)
    known = {k: XSAMPA_TO_IPA[k] for k in keys}
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rf"{many}|[\s\S]"), F.lit(0)), lambda c: F.coalesce(_lookup(c, known), c)), "")


def notation_to_xsampa(text: Column, on_error: str = NULL) -> Column:
    """X-SAMPA of a text of the notation, by way of IPA."""
    return ipa_to_xsampa(notation_to_ipa(text, on_error))


def escaped(text: Column) -> Column:
    """The text with a backslash before each sign that means something in a regular expression."""
    return F.regexp_replace(text, r"[-/\\^$*+?.()|\[\]{}]", r"\\$0")
