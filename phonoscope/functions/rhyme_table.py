"""How alike consonants sound in a rhyme; the table is not symmetric."""

from __future__ import annotations

# Consonant, another, their likeness.
WEIGHTS = [
    ("m", "m", 1.0), ("m", "n", 0.9), ("m", "N", 0.85), ("m", "b", 0.8), ("m", "p", 0.7), ("m", "v", 0.6), ("m", "w", 0.5),
    ("m", "d", 0.3), ("m", "g", 0.2), ("m", "k", 0.2), ("m", "h", 0.1), ("m", "t", 0.1), ("m", "f", 0.4), ("m", "s", 0.3),
    ("n", "n", 1.0), ("n", "m", 0.9), ("n", "N", 0.85), ("n", "d", 0.8), ("n", "t", 0.7), ("n", "l", 0.7), ("n", "r", 0.6),
    ("n", "g", 0.4), ("n", "k", 0.3), ("n", "b", 0.4), ("n", "s", 0.3), ("n", "z", 0.3), ("n", "h", 0.1),
    ("N", "N", 1.0), ("N", "n", 0.85), ("N", "g", 0.9), ("N", "k", 0.8), ("N", "m", 0.7), ("N", "d", 0.5), ("N", "b", 0.4),
    ("N", "t", 0.3), ("N", "h", 0.2), ("N", "p", 0.2), ("N", "f", 0.2), ("N", "s", 0.2),
    ("g", "g", 1.0), ("g", "k", 0.9), ("g", "N", 0.9), ("g", "d", 0.6), ("g", "t", 0.4), ("g", "b", 0.4), ("g", "m", 0.3),
    ("g", "n", 0.3), ("g", "h", 0.3), ("g", "s", 0.2), ("g", "p", 0.2), ("g", "f", 0.2),
    ("b", "b", 1.0), ("b", "p", 0.9), ("b", "m", 0.8), ("b", "v", 0.7), ("b", "w", 0.6), ("b", "d", 0.5), ("b", "g", 0.4),
    ("b", "t", 0.3), ("b", "k", 0.2), ("b", "n", 0.4), ("b", "h", 0.1),
    ("p", "p", 1.0), ("p", "b", 0.9), ("p", "m", 0.8), ("p", "f", 0.6), ("p", "t", 0.5), ("p", "g", 0.4), ("p", "d", 0.4),
    ("p", "k", 0.3), ("p", "s", 0.2), ("p", "h", 0.1),
    ("t", "t", 1.0), ("t", "d", 0.9), ("t", "n", 0.8), ("t", "s", 0.6), ("t", "l", 0.6), ("t", "k", 0.5), ("t", "g", 0.4),
    ("t", "p", 0.4), ("t", "b", 0.4), ("t", "h", 0.2),
    ("d", "d", 1.0), ("d", "t", 0.9), ("d", "n", 0.8), ("d", "l", 0.7), ("d", "r", 0.6), ("d", "g", 0.5), ("d", "k", 0.4),
    ("d", "m", 0.4), ("d", "p", 0.3), ("d", "s", 0.3), ("d", "h", 0.1),
    ("k", "k", 1.0), ("k", "g", 0.9), ("k", "N", 0.85), ("k", "t", 0.6), ("k", "d", 0.5), ("k", "n", 0.4), ("k", "p", 0.3),
    ("k", "b", 0.3), ("k", "m", 0.2), ("k", "h", 0.2),
    ("s", "s", 1.0), ("s", "z", 0.9), ("s", "t", 0.8), ("s", "l", 0.6), ("s", "n", 0.5), ("s", "d", 0.4), ("s", "f", 0.3),
    ("s", "p", 0.3), ("s", "k", 0.3), ("s", "h", 0.1),
    ("l", "l", 1.0), ("l", "r", 0.9), ("l", "n", 0.8), ("l", "d", 0.7), ("l", "t", 0.6), ("l", "s", 0.5), ("l", "g", 0.4),
    ("l", "m", 0.3), ("l", "p", 0.2),
    ("r", "r", 1.0), ("r", "l", 0.9), ("r", "d", 0.8), ("r", "n", 0.7), ("r", "t", 0.6), ("r", "s", 0.5), ("r", "g", 0.4),
    ("r", "m", 0.3), ("r", "p", 0.2),
    ("h", "h", 1.0), ("h", "g", 0.5), ("h", "k", 0.5), ("h", "s", 0.4), ("h", "p", 0.3), ("h", "t", 0.3), ("h", "d", 0.3),
    ("h", "n", 0.2), ("h", "m", 0.1),
]
# End of fixed values.
