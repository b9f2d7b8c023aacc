"""Rows that every operator must take."""

#: Texts that each operator must take: null, empty, blank, one word, ties, repeated rows, very long.
ODD = [
    (1, "one two three four five six", "s1"), (2, "one two three four five six", "s1"), (2, "one two three four five six", "s1"), (3, None, None),
    (4, "", "s2"), (5, " \n\t ", "s2"), (None, "no id here at all", "s1"), (6, "word", None), (7, "long " * 30_000 + "end", "s2"),
    (8, "first line of some length, which repeats\nsecond line of some length, of its own", "s1"),
    (9, "another beginning of a page, quite unlike\nfirst line of some length, which repeats\n\nlast", "s2"), (10, "é ß 漢字   x", "s1"),
]
SCHEMA = "doc_id long, text string, source string"
