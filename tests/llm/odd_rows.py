"""Cases every operator on texts must take: nulls, empty and long texts, repeats, ties."""

ODD = [
    (1, None, None, None),
    (2, "", "en", "src1"),
    (3, " \t\n ", "en", None),
    (4, "word", "de", "src1"),
    (5, "long " * 30_000, "en", "src0"),
    (6, "same text here, twice over and over again until it is long enough to count", "en", "src0"),
    (6, "same text here, twice over and over again until it is long enough to count", "en", "src0"),
    (7, "same text here, twice over and over again until it is long enough to count", "fr", "src2"),
    (None, "a row without an id", "en", "src0"),
    (8, "é ñ ß 日本語   😀 x\x00y", "es", "other"),
]
