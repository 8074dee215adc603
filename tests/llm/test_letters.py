"""What counts as a letter for the language of a text."""

import unicodedata

from barframe.llm import langid


def test_only_letters_are_letters():
    for c in map(chr, range(0x2C00)):
        if len(c.lower()) > 1 or c == " ":
            continue
        letter = unicodedata.category(c).startswith("L")
        assert langid.has_letter(c) == letter and (langid._plain(f"a{c}b") == f" a{c.lower()}b ") == letter, hex(ord(c))


def test_numerals_alone_are_undetermined(spark):
    docs = [(1, "the words of one text", "en"), (2, "die worte eines textes", "de")]
    model = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    texts = [(1, "½ ²①Ⅷ"), (2, "12 %"), (3, "die ½ worte"), (4, None), (5, "")]
    found = {r["doc_id"]: r["lang_pred"] for r in identified(spark, texts, model)}
    assert found == {1: "und", 2: "und", 3: "de", 4: "und", 5: "und"}


def identified(spark, texts, model):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts, "doc_id long, text string")
    return langid.identify(df, model, carried=F.struct("doc_id")).select("row.*", "lang_pred").collect()
