import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 997}x{i}" + ("." if i % 11 == 10 else "") for i in range(60_000))
COPY = "One morning the old clerk walked down to the harbour with nine letters. He gave each of them to a different captain, and none of them asked him why. By noon every ship had left."
NASTY = [
    (1, COPY, "en", "s", 1), (2, COPY, "en", "s", 1), (2, COPY, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, "no id here, only words", "en", "s", 5),
    (None, None, "en", "s", 5), (5, " \n\t \r\n", "en", "s", 5), (6, LONG, "en", "s", len(LONG)), (7, "x", "en", "s", 1), (8, "\u2028漢字 e\u0301 \U0001f600 \x00 nul\x1f\x85", "xx", "s", 9),
    (9, "<|endoftext|> ### a </turn> \\", "en", "s", 4), (-3, COPY.upper(), "en", "s", 1), (10, "a a a a a a a a a", "en", "s", 3), (2**62, "big id", "en", "s", 2),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as columns of the input.
CLASHES = ["row", "id", "key", "ids", "bad", "score", "shard", "slot", "rank", "cell", "rep", "k1", "k2", "h1", "piece", "start", "length", "__text", "__part", "hash", "a", "b", "label", "kept", "root", "class_id"]


@pytest.fixture(scope="session")
def nasty(spark):
    return spark.createDataFrame(NASTY, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(nasty):
    return nasty.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
