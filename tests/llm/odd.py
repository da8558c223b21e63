"""A small table with unusual rows, and columns whose names operators might use themselves."""

import random


def odd_rows(seed=1):
    r = random.Random(seed)
    texts = [None, "", " \n\t ", "a", "A", "a b", "  a   b ", "a\x0bb", "é中́x 1's don't", "\x1c \x85  　z", "x " * 20_000, "ab" * 5_000]
    base = " ".join(r.choice("alpha beta gamma delta eps zeta".split()) + str(r.randint(0, 30)) for _ in range(120))
    texts += [base, base, base + " more", base.replace("alpha", "ALPHA"), base + "\n" + base]
    texts += ["\n".join(" ".join(r.choice("abcdef") for _ in range(r.randint(0, 9))) for _ in range(5)) for _ in range(25)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "é")[i % 4]) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[12], (None, "no id here at all", "en", "s1")]


def odd_documents(spark, rows=None):
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(odd_rows() if rows is None else rows, schema)
    clash = "k1 k2 h1 h2 key fp id size rank n cell row text_hash lang_pred score rejected _id _key target word line pos".split()
    return df.selectExpr("*", *[f"'clash' AS `{c}`" for c in clash])


def empty_documents(spark):
    return odd_documents(spark, []).limit(0)
