import random

import pytest

WORDS = "the of and thing other ering tion est que leon über straße niño éclair 12 x9 ... ok! a|b".split()


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    """(rows, folder): documents with nulls, empty and long texts, ties, repeated rows and extra columns whose names clash with results."""
    rng = random.Random(7)
    shared, other = prose(rng, 150), prose(rng, 160)
    near = prose(rng, 300)
    body = [
        None, "", " ", "\n\n", "word", "two words", "a" * 3000, "ab" * 900, " " * 500, "x" * 399, "x" * 400, shared, shared, other,
        prose(rng, 40) + shared + prose(rng, 30), prose(rng, 5) + shared, shared + prose(rng, 9), other + "é" + shared + "é" + other,
        near, near + " end", near.replace("tion", "tiom", 1), prose(rng, 20000),
        'password = "hunter2hunter2" token: abc secret=token:abcdefghij API_KEY=abc.def/ghi', "AKIA" + "A1" * 8 + " x " + "0123456789abcdef" * 3, "é😀 PassWD:'zzzzzzzzz' AKIAQ AKIA" + "Z" * 11 + "AKIA" + "Z" * 13,
        "ſecret=abcdefghijk toKen=abcdefghijk", "deadbeef" * 4 + "g" + "deadbeef" * 3, "-----BEGIN RSA PRIVATE KEY----- secret  :  \"abcdefgh",
        "<|endoftext|> <s> </s> İstanbul ΑΣ éx　y z ﬁ", "line one\nline one\n \n\nline one\nx", "# $ % & | < > *" * 40, "梦" * 700, "日本語 テキスト 😀😀",
    ]
    body += [prose(rng, rng.randrange(1, 400)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "de", None]), f"src{i % 3}", len(t or ""), 1) for i, t in enumerate(body)]
    rows += [rows[14], (5000, rows[15][1], "en", "src0", 1, 1), (5001, rows[15][1], "en", "src0", 1, 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, fp long")
    frame.repartition(5).write.parquet(f"{folder}/documents.parquet")
    frame.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    labels = [(i, 1 if i % 4 else 0, 1 if i % 5 == 0 else 0) for i in range(len(body)) if i % 3] + [(None, 1, 0), (3, None, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame.write.parquet(f"{folder}/labels.parquet")
    frame.limit(0).write.parquet(f"{folder}/none/labels.parquet")
    return [(r[0], r[1]) for r in rows], folder
