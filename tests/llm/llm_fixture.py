"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _h string, keep int, copies int, "
          "size string, _row string, label double")
TOKEN = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"


def documents(spark, rows=None):
    if rows is None:
        base = "the cat sat on the mat and looked at the dog by the door of the old house"
        rows = [
            (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " again", "en", "b"),
            (4, None, "en", "a"), (5, "", None, None), (6, " \t\n\x0b\x0c\r ", "de", "b"),
            (7, "One", "en", "a"), (8, "one two", "en", None), (None, "no id here at all", "en", "a"),
            (9, "Äpfel öl ▁ mark  two  spaces \U0001f600 end\n\nnew line ", "de", "c"),
            (10, ("word%d " * 1) % 7 * 3000, "en", "a"), (11, "x" * 5000, "en", "c"),
            (12, f'the token = "{TOKEN}" was at mail5.example.com there', "en", "b"),
            (13, "it cost 4785380592391139 and 19@mail5.example-host.com said", "en", "b"),
            (12, f'the token = "{TOKEN}" was at mail5.example.com there', "en", "b"),
            (12, "same id, other text", "en", "b"),
            (14, "café café café résumé", None, "b"),
        ]
    full = [(i, t, l, s, None if t is None else len(t), "x", 1, 2, "z", "r", 0.5) for i, t, l, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
