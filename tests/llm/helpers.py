"""Small tables that hold what every operator must survive."""
import zlib

NASTY = [
    (0, "one two three four five six seven", "en", "a", 3), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 1),
    (4, "one two three four five six seven", "en", "a", 3), (5, "wörter ünd ZAHLEN 12,5 İß é é ́x", "de", "b", 1), (6, "x" * 30000, "en", "a", 1),
    (7, " ".join(f"w{i % 977}" for i in range(40000)), "en", "a", 1), (7, "a repeated id", "en", "a", 1), (None, "no id here", None, "a", 1), (9, "don't <|endoftext|> stop\r\nnow please ok \x1c ctrl", "en", "c", 2),
    (10, "one two three four five six seven", "en", "a", 3), (10, "one two three four five six seven", "en", "a", 3),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def nasty(spark, extra=True):
    df = spark.createDataFrame(NASTY, SCHEMA).repartition(3)
    if extra:  # names that an operator might want for itself
        for c in ("row", "piece", "length", "shard", "slot", "block", "mark", "word", "key", "uid", "n_words", "score", "line", "component_id", "bucket", "hash"):
            df = df.selectExpr("*", f"'{c}!' as {c}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(data: bytes) -> int:
    return zlib.crc32(data)
