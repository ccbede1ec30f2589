"""Small document tables with everything that can go wrong in them."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed, n, vocabulary=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary) for _ in range(n))


def documents(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


ODD_TEXTS = [None, "", " ", "\n\n", "a", "日本語 の テキスト", "é̈ ß İ ǅ ½ 10,5", "<|endoftext|> </s> <s> ▁x  y\r\n\tz\x00\x1c", "x" * 300_000, prose(1, 20_000), prose(2, 80), prose(2, 80), "| # *\n| # *\n12 34"]


def odd_documents(spark):
    """All odd texts, repeated rows, rows with one doc_id and different texts, null doc_ids, and columns whose names operators might use themselves."""
    df = documents(spark, [*ODD_TEXTS, "no id at all", "no id at all", "another row without an id", prose(8, 90), prose(9, 90)], [*range(len(ODD_TEXTS)), None, None, None, 10, 10])
    df = df.unionByName(df.where("doc_id in (5, 10)"))
    return df.selectExpr("*", "1 as bucket", "'x' as payload", "2 as id", "3 as line", "'y' as found", "4 as fp", "5 as kept", "6 as failed_id", "7 as kept_id", "8 as dropped_id", "9 as part", "0 as held_out", "1 as text_hash", "2 as lang_key", "'z' as judged_text", "3 as base_failed", "4 as logp", "5 as kept_row_hash", "6 as scored_row", "map('a', 7) as row_hash")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


def sf(tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
