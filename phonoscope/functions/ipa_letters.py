"""What each IPA letter does when IPA is read.

A program is a row of steps: V:x begins a vowel, C:x a consonant, P:x punctuation; F:x gives a feature to the sound that the
feature is about; T:x begins a run of tones (T alone: with the letter itself); X ends the run of vowels that
tones reach; S marks the next vowel as stressed; G:x begins a consonant unless the last one is the same; B and R:x
are the marks below that stand for a retracted and a voiced sound.  The empty program skips the letter.
"""

from __future__ import annotations

# Program -> letters.
PROGRAMS = {
    "P: ": " ",
    "": "\u200c!|\u0302\u030c\u031d\u031e\u0326\u0339ˌ\u0329˽\u033a+'()\u0318\u0319\u0349\u033b\u033c˖ḁ\u033d\u0324\u0308\u031f.\u0361\u035c",
    "F:aspirated": "ʰ",
    "B": "\u0331\u0320",
    "V:u F:nasal": "ũṵ",
    "V:o F:nasal": "õ",
    "V:i F:nasal": "ĩḭ",
    "V:e F:nasal": "ẽḛ",
    "V:I": "ɪɘ",
    "V:i$": "ʏɨyÿ",
    "V:e": "eĕêě",
    "V:E": "ɛε",
    "V:e$": "œɶ",
    "V:a": "aɐɑɒäâǎ",
    "V:A": "æ",
    "V:a$": "ø",
    "V:O": "ɜɵʊɤɯü",
    "V:o$": "ɔ",
    "V:u": "ʉuǔû",
    "V:U": "ʌəǝɞᵊ",
    "V:u$": "ɹɻɚɝʴ",
    "C:b?": "ɓ",
    "C:bb": "ʙ",
    "C:D": "ɖ",
    "C:d*": "ǂ",
    "C:c": "θ",
    "C:C": "ð",
    "C:F": "ɸ",
    "C:g": "ɡɢg",
    "C:g?": "ɠʛ",
    "C:g F:palatal": "ɟ",
    "C:g? F:palatal": "ʄ",
    "C:H F:aspirated": "ħ",
    "C:h F:aspirated": "ɦ",
    "C:H": "xχɧ",
    "C:h F:palatal": "ç",
    "C:k F:palatal": "c",
    "C:J": "ʐ",
    "C:j": "ʒ",
    "C:Z": "ɮ",
    "C:j F:palatal": "ʑ",
    "C:k*": "ǃ",
    "C:K": "q",
    "C:m": "m",
    "C:n": "nⁿ",
    "C:N": "ɳ",
    "C:q": "ŋɴ",
    "C:n F:palatal": "ɲ",
    "C:L": "ɭ",
    "C:l F:palatal": "ʎ",
    "C:l*": "ǁ",
    "C:p*": "ʘ",
    "C:r": "rɾŕ",
    "C:R": "ɽ",
    "C:G": "ɣʁ",
    "C:GG": "ʀ",
    "C:S": "ɬ",
    "C:s": "sˢ",
    "C:t": "t",
    "C:T": "ʈ",
    "C:t*": "ǀ",
    "C:V": "ʋⱱβ",
    "C:u T:˧˥": "ŭ",
    "C:w": "w",
    "P:=-": "–-",
    "V:a F:nasal": "ã",
    "V:o": "ọŏôǒo",
    "C:w F:voiceless": "ʍ",
    "C:W": "ɰ",
    "C:x": "ʃ",
    "C:X": "ʂ",
    "C:x F:palatal": "ɕ",
    "C:y": "jʝýŷ",
    "C:yw~": "ɥ",
    "C:d F:implosive": "ɗ",
    "G:'": "ʔˀ",
    "C:Q": "ʕ",
    "C:hh~": "ʱ",
    "C:l F:velar": "ɫ",
    "F:voiceless": "\u030a˳\u0325",
    "F:nasal": "\u0330\u0303",
    "F:stop": "\u031a",
    "V:i": "ǐîiï",
    "V:o T:˦ X": "ó",
    "F:short": "\u0306",
    "C:m F:dental": "ɱ",
    "F:dental": "\u032a",
    "F:ejective": "ʼ",
    "F:palatal": "ʲ",
    "F:labial": "ʷ",
    "F:velar": "ˠ",
    "F:pharyngeal": "ˤ",
    "R:vzgbdj": "\u032c",
    "V:o F:long": "ō",
    "V:e F:long": "ē",
    "C:l": "ɺl",
    "V:u F:long": "ū",
    "F:long": ":ːˑ",
    "C:b": "b",
    "C:d": "d",
    "C:f": "f",
    "C:h": "h",
    "C:k": "k",
    "C:p": "p",
    "C:v": "v",
    "C:z": "z",
    "F:tense": "\u0348",
    "F:non-syllabic": "\u032f",
    "V:e T:˨ X": "è",
    "V:i T:˨ X": "ì",
    "T:˨ X": "\u0300",
    "T:˦ X": "\u0301",
    "V:i X": "ī",
    "V:e T:˦ X": "é",
    "V:a T:˨ X": "à",
    "V:o T:˨ X": "ò",
    "V:a X": "ā",
    "V:a T:˦ X": "á",
    "V:i T:˦ X": "í",
    "V:u T:˨ X": "ù",
    "V:u T:˦ X": "ú",
    "V:a F:short": "ă",
    "X": "\u0304",
    "S": "ˈ",
    "T": "˥˦˧˨˩",
}
#: Tone letters and the notation's marks for them.
TONE_MARKS = {"˥": "++", "˦": "+", "˧": "", "˨": "-", "˩": "--"}
# End of fixed values.



def _steps(program: str) -> tuple[tuple[str, str], ...]:
    """(operation, argument) of each step; a program of one space is punctuation and keeps its argument."""
    words = [program] if program.startswith("P:") else program.split()
    return tuple((w[0], w[2:]) for w in words)


LETTERS = {letter: _steps(program) for program, letters in PROGRAMS.items() for letter in letters}
