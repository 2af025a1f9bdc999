"""Rows that every operator must take."""

# NULL, empty, blank, tied, repeated and very long texts; ids NULL and repeated.
ODD_DOCS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (4, "one", "en", "a", 3),
    (5, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 56),
    (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 56),
    (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "b", 56),
    (None, "no id at all here", "fr", "c", 17), (8, "mot " * 60_000, "fr", "a", 240_000),
    (9, "é ñ <|endoftext|> a.b,c  d\x1fe 日本語", "es", "c", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
