import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with the odd cases: null and empty texts, copies, near copies, ties, shared lines, a long text."""
    rng = random.Random(5)
    english = ["the", "wind", "over", "house", "with", "Thatch", "where", "north", "water", "this", "shining", "people"]
    german = ["der", "Wind", "über", "Häuser", "durch", "gegen", "weiß", "schön", "nicht", "auch", "Straße", "zwölf"]
    rows = []
    for i in range(60):
        words, lang = (english, "en") if i % 2 else (german, "de")
        words = [w + rng.choice(["", "s", "er", "en"]) for w in words for _ in range(4)]
        text = "\n".join(_sentence(rng, words, rng.randint(8, 30)) + "." for _ in range(rng.randint(1, 9)))
        rows.append([i, text, lang, f"s{i % 3}", len(text)])
    passage = "\n".join(_sentence(rng, english, 12) for _ in range(4))
    for i in (7, 21, 33):
        rows[i][1] += "\n" + passage + "\ntail " + str(i)
    for i, of in ((40, 3), (41, 3), (42, 10)):
        rows[i][1] = rows[of][1]
    for i, of in ((43, 5), (44, 5), (45, 8)):
        words = rows[of][1].split(" ")
        words[len(words) // 2] = "changed"
        rows[i][1] = " ".join(words)
    rows[50][1:] = [None, "en", None, None]
    rows[51][1:] = ["", None, "s1", 0]
    rows[52][1:] = ["\n \n\t", "en", "s1", 4]
    rows[53][1:] = ["12345 %%% ###", None, None, 13]
    rows[54][1:] = ["word", "en", "s2", 4]
    rows[55][1:] = ["two words", "en", "s2", 9]
    rows[56][1] = "## a b c d e f\n" * 40
    rows[57][1] = " ".join(_sentence(rng, english, 5000) for _ in range(3))
    rows[58][1] = "tab\there  double  blanks é日本語 x\x00y <|endoftext|> don't\n\n  end "
    rows.append(list(rows[3]))
    rows.append([None, rows[4][1], "de", "s0", 5])
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, COLUMNS).repartition(3, "source")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
