"""Texts that every operator must stand."""


def odd_texts():
    """Missing, empty, blank, repeated, other scripts and very long texts."""
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one two"), (5, "Ünï ÇØDÉ ß 漢字 😀 x\x00y"),
        (6, "word " * 60_000), (7, "a" * 200_000), (8, "a b c d e f g h i j k l m n o p"), (9, "9" * 30_000),
    ]
