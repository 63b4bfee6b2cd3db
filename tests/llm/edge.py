"""A small table with the awkward cases: nulls in any column, empty and long texts, copies, clashing column names."""

LONG = " ".join(f"word{i % 97} the of{i % 13}." for i in range(4000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it runs far away from here.", "en", "s", 5),
    (2, "The quick brown fox jumps over the lazy dog, and then it runs far away from here.", "en", "s", 5),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, "   \n\t \r\n ", "en", None, 9),
    (6, LONG, "en", "s", len(LONG)),
    (6, LONG, "en", "s", len(LONG)),
    (7, "same id\nwith another line of text", "en", "s", 1),
    (7, "same id\nbut a different second line", "en", "s", 1),
    (None, "no id here, but a text of some words", "en", "s", 1),
    (None, "no id here, but a text of some words", "en", "s", 1),
    (None, None, "de", "s", 1),
    (8, "Größe äöü ÄÖÜ ßßß naïve Ünïcödé   \x1c\x85 end  double  spaces <|endoftext|> mid<|endoftext|>dle", "de", "s", 1),
    (9, "x" * 5000, "en", "s", 1),
    (10, "a line that stands here for all to see\nshort\n\nshort\nA line that stands here for all to see\nend", "en",
     "s", 1),
    (11, "a line that stands here for all to see\nand a line of its own", "en", "s", 1),
    (12, "1 2 3 4 !!! ... ???", None, "s", 1),
    (13, "don't we'll I'm 12345 ½ ² Ⅷ 日本語のテキスト \U0001F600\U0001F600 ́combining", "en", "s", 1),
]
#: Names that the operators use inside: they must neither clash nor get lost.
EXTRA = "th string, r string, fp int, key int, dropped string, n int, digest string, score double, items int, k int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def edge_docs(spark, rows=ROWS):
    extra = ("th", "r", 1, 2, "d", 3, "x", 0.5, 7, 8)
    return spark.createDataFrame([r + extra for r in rows], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is not None, str(v)) for v in row)
