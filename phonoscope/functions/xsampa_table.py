"""X-SAMPA and IPA side by side."""

from __future__ import annotations

# Fixed values: (X-SAMPA, IPA) in table order; either side may be empty, and of repeated symbols the later one counts.
PAIRS = (
    ("a", "a"), ("b", "b"), ("b_<", "ɓ"), ("c", "c"), ("d", "d"), ("d`", "ɖ"), ("d_<", "ɗ"), ("e", "e"), ("f", "f"), ("g", "ɡ"), ("g_<", "ɠ"),
    ("h", "h"), ("h\\", "ɦ"), ("i", "i"), ("j", "j"), ("j\\", "ʝ"), ("k", "k"), ("l", "l"), ("l`", "ɭ"), ("l\\", "ɺ"), ("m", "m"), ("n", "n"),
    ("n`", "ɳ"), ("o", "o"), ("p", "p"), ("p\\", "ɸ"), ("q", "q"), ("r", "r"), ("r`", "ɽ"), ("r\\", "ɹ"), ("r\\`", "ɻ"), ("s", "s"), ("s`", "ʂ"),
    ("s\\", "ɕ"), ("t", "t"), ("t`", "ʈ"), ("u", "u"), ("v", "v"), ("v\\", "ʋ"), ("w", "w"), ("x", "x"), ("x\\", "ɧ"), ("y", "y"), ("z", "z"),
    ("z`", "ʐ"), ("z\\", "ʑ"), ("A", "ɑ"), ("B", "β"), ("B\\", "ʙ"), ("C", "ç"), ("D", "ð"), ("E", "ɛ"), ("F", "ɱ"), ("G", "ɣ"), ("G\\", "ɢ"),
    ("G\\_<", "ʛ"), ("H", "ɥ"), ("H\\", "ʜ"), ("I", "ɪ"), ("I\\", "ᵻ"), ("J", "ɲ"), ("J\\", "ɟ"), ("J\\_<", "ʄ"), ("K", "ɬ"), ("K\\", "ɮ"),
    ("L", "ʎ"), ("L\\", "ʟ"), ("M", "ɯ"), ("M\\", "ɰ"), ("N", "ŋ"), ("N\\", "ɴ"), ("O", "ɔ"), ("O\\", "ʘ"), ("P", "ʋ"), ("Q", "ɒ"), ("R", "ʁ"),
    ("R\\", "ʀ"), ("S", "ʃ"), ("T", "θ"), ("U", "ʊ"), ("U\\", "ᵿ"), ("V", "ʌ"), ("W", "ʍ"), ("X", "χ"), ("X\\", "ħ"), ("Y", "ʏ"), ("Z", "ʒ"),
    (".", "."), ("\"", "ˈ"), ("%", "ˌ"), ("'", "ʲ"), ("", "\u0348"), ("", "\u032a"), ("", "\u0361"), ("", "\u035c"), ("", "˺"), ("", "ˌ"),
    (":", "ː"), (":\\", "ˑ"), ("-", ""), ("@", "ə"), ("@\\", "ɘ"), ("@`", "ɚ"), ("{", "æ"), ("}", "ʉ"), ("1", "ɨ"), ("2", "ø"), ("3", "ɜ"),
    ("3\\", "ɞ"), ("4", "ɾ"), ("5", "ɫ"), ("6", "ɐ"), ("7", "ɤ"), ("8", "ɵ"), ("9", "œ"), ("&", "ɶ"), ("?", "ʔ"), ("?\\", "ʕ"), ("*", ""), ("/", ""),
    ("<", ""), ("<\\", "ʢ"), (">", ""), (">\\", "ʡ"), ("^", "ꜛ"), ("!", "ꜜ"), ("!\\", "ǃ"), ("|", "|"), ("|\\", "ǀ"), ("||", "‖"), ("|\\|\\", "ǁ"),
    ("=\\", "ǂ"), ("-\\", "‿"), ("_", "\u0308"), ("_+", "\u031f"), ("_-", "\u0320"), ("_/", "\u030c"), ("_0", "\u0325"), ("_<", ""),
    ("_=", "\u0329"), ("_>", "ʼ"), ("_?\\", "ˤ"), ("_\\", "\u0302"), ("_^", "\u032f"), ("_}", "\u031a"), ("`", "˞"), ("_~", "\u0303"),
    ("_A", "\u0318"), ("_a", "\u033a"), ("_B", "\u030f"), ("_B_L", "\u1dc5"), ("_c", "\u031c"), ("_d", "\u032a"), ("_e", "\u0334"), ("<F>", "↘"),
    ("_F", "\u0302"), ("_G", "ˠ"), ("_H", "\u0301"), ("_H_T", "\u1dc4"), ("_h", "ʰ"), ("_j", "ʲ"), ("_k", "\u0330"), ("_L", "\u0300"), ("_l", "ˡ"),
    ("_M", "\u0304"), ("_m", "\u033b"), ("_N", "\u033c"), ("_n", "ⁿ"), ("_O", "\u0339"), ("_o", "\u031e"), ("_q", "\u0319"), ("<R>", "↗"),
    ("_R", "\u030c"), ("_R_F", "\u1dc8"), ("_r", "\u031d"), ("_T", "\u030b"), ("_t", "\u0324"), ("_v", "\u032c"), ("_w", "ʷ"), ("_X", "\u0306"),
    ("_x", "\u033d"),
)
# End of fixed values.
