"""Small documents with the cases that every operator must handle."""

import random

from custlens.llm.tables import importable

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_documents(seed=3, n=40):
    """Texts, copies, near copies, a shared passage, repeats, nulls, empties and a long text."""
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    texts = []
    for i in range(n):
        t = sentence(rng, rng.randint(5, 90))
        if i % 4 == 0:
            t = f"{t} {passage}\n{sentence(rng, 12)}"
        if i % 7 == 0:
            t += f"\n{passage}\n{passage}"
        texts.append(t)
    words = sentence(rng, 200).split()
    texts.append(" ".join(words))
    texts.append(" ".join(words[:100] + ["changed"] + words[101:]))
    texts += [texts[0]] * 3 + [None, "", "", " \n\t ", "one", "a b c d", "same " * 60, "é中 \U0001f600 x\x0by\tz", "Übung macht den Meister! " * 30]
    texts.append(sentence(rng, 9000))
    rows = [(i * 3, t, "en" if i % 3 else "de", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[0])                                  # a repeated row
    rows.append((rows[1][0], "another text of that id", None, None, None))
    rows.append((None, "a text without an id " * 6, "en", None, None))
    return rows


def frame(spark, rows):
    importable(spark)
    return spark.createDataFrame(rows, SCHEMA)


def folder(df, tmp_path, name="documents"):
    """A folder in the layout of the given tables."""
    path = str(tmp_path)
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return path


def clashing(df):
    """Extra columns named as the operators' own."""
    from pyspark.sql import functions as F
    names = ["_score", "_text", "_id", "_tie", "_bucket", "_node", "_rule_counts", "_n_removed", "node", "bucket", "class", "extra0", "extra5"]
    return df.withColumns({c: F.lit(i) for i, c in enumerate(names)})


def got(df, *keys):
    return sorted((tuple(r) for r in df.select(*keys).collect()), key=repr)
