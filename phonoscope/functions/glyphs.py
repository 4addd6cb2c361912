"""The glyphs of the ASCII notation: keys, readable forms and machine codes."""

from __future__ import annotations

# Keys and readable forms, in the order in which machine codes are given out.

#: Letters of vowels, by ordinal; a capital is read as its small letter with a dot below.
VOWEL_LETTERS = "IEAOUieaou"
#: Marks that may follow a vowel's letter, in the order in which they are written; the last choice is no mark.
VARIANT, NASAL, SYLLABIC = "$", "&", "@"
TONES = ("--", "-", "++", "+", "/", "//", "\\/", "/\\", "\\\\", "\\")
LENGTHS = ("_", "!")
ACCENT = "^"
#: Combining characters of the marks.
COMBINING = {
    "--": "\u030f", "-": "\u0300", "++": "\u030b", "+": "\u0301", "//": "\u0328\u030b", "/": "\u0328\u0301", "\\/": "\u030c", "/\\": "\u0302",
    "\\\\": "\u0328\u030f", "\\": "\u0328\u0300", "^": "\u0307", "$": "\u0324", "&": "\u0330", "_": "\u0304", "@": "\u0316", "!": "\u0331",
}
DOT_BELOW, STRESSED_I, RHOTIC = "\u0323", "\u00ef", "r"

CONSONANTS = (
    ("@", "@"), ("h~", "ɦ"), ("m", "m"), ("N", "n\u0323"), ("n", "n"), ("q", "n\u0307"), ("G~", "g\u0303"), ("G", "g\u0307"), ("g?", "g\u0300"),
    ("g", "g"), ("'", "'"), ("Q", "q\u0307"), ("d~Q~", "d\u0330"), ("d~", "d"), ("d?", "d\u0316"), ("d!", "d\u0317"), ("d*", "d\u032c"),
    ("d.", "d\u0331"), ("D", "d\u0323"), ("dQ~", "d\u0330"), ("d", "d"), ("b?", "b\u0316"), ("b!", "b\u0317"), ("b", "b"), ("p!", "p\u0301"),
    ("p*", "p\u0302"), ("p.", "t\u0304"), ("p@", "x\u030c"), ("p", "p"), ("t~Q~", "t\u0330"), ("t~", "t"), ("T!", "t\u0323\u0317"), ("T", "t\u0323"),
    ("t!", "t\u0317"), ("t*", "t\u032c"), ("tQ~", "t\u0330"), ("t@", "t\u032d"), ("t.", "t\u0331"), ("t", "t"), ("k!", "k\u0317"), ("k.", "k\u0331"),
    ("k*", "k\u032c"), ("K!", "k\u0323\u0317"), ("K", "k\u0323"), ("k", "k"), ("H!", "h\u0323\u0317"), ("H", "h\u0323"), ("h!", "ħ"), ("h", "h"),
    ("J", "ȷ\u0308"), ("j!", "j\u0301"), ("j", "j"), ("S!", "s\u0323\u0301"), ("s!", "s\u0301"), ("S", "s\u0323"), ("sQ~", "s\u0330"),
    ("s@", "s\u032d"), ("s", "s"), ("F", "f\u0323"), ("f!", "f\u0317"), ("f", "f"), ("V", "v\u0323"), ("v", "v"), ("z!", "z\u0301"),
    ("zQ~", "z\u0330"), ("z", "z"), ("Z!", "z\u0323\u0301"), ("Z", "z\u0323"), ("CQ~", "c\u0323\u0303"), ("C", "c\u0323"), ("cQ~", "c\u0303"),
    ("c", "c"), ("L", "l\u0323"), ("l*", "l\u032c"), ("lQ~", "l\u0330"), ("l", "l"), ("R", "r\u0323"), ("rQ~", "r\u0303"), ("r", "r\u0307"),
    ("x!", "x\u0301"), ("X!", "x\u0323\u0301"), ("X", "x\u0323"), ("x@", "x\u032d"), ("x", "x"), ("W", "w\u0307"), ("w!", "w\u0301"),
    ("w~", "w\u0323"), ("w", "w"), ("y~", "y\u0307"), ("y", "y"),
)
NUMERALS = (
    ("0", "0"), ("1", "1"), ("2", "2"), ("3", "3"), ("4", "4"), ("5", "5"), ("6", "6"), ("7", "7"), ("8", "8"), ("9", "9"),
)
SYMBOLS = (
    ("=.", "."), ("=?", "?"), ("=!", "!"), ("=+", "+"), ("=-", "-"), (">", ">"), ("<", "<"), ("/", "/"), ("\\", "\\"), ("|", "|"), ("(", "("),
    (")", ")"), ("[", "["), ("]", "]"), (" ", " "),
)
#: Given out last.
LATE = (("n~", "n"),)

#: First machine code of the vowels and of all other glyphs.
FIRST_VOWEL, FIRST_OTHER = 0xAC00, 0xCF10
# End of fixed values.

#: Key -> readable form, and key -> machine code, of all glyphs but vowels.
READABLE = dict((*CONSONANTS, *NUMERALS, *SYMBOLS, *LATE))
MACHINE = {key: chr(FIRST_OTHER + k) for k, key in enumerate(READABLE)}
