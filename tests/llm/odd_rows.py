"""Rows with nulls, empty and long texts, repeats and missing ids."""

ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, None),
    (3, ""),
    (4, "alpha  beta gamma delta epsilon zeta eta theta iota\tkappa"),
    (None, "a text without an id"),
    (None, None),
    (5, "word " * 40_000),
    (6, "  \n\t "),
    (7, "same row"),
    (7, "same row"),
    (8, "12 34 !! ??"),
]
