import random
import re
from collections import Counter

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from hiresift.functions.fixed_values import STOP_WORDS
from hiresift.functions.text import is_blank, plain_characters, strip, term_counts


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string")


def result(df):
    return [r[0] for r in df.orderBy("id").select(df.columns[-1]).collect()]


def test_strip_removes_what_python_calls_blank(spark):
    rng = random.Random(1)
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    values = ["".join(rng.choice(blanks + list("aé-")) for _ in range(8)) for _ in range(400)]
    df = texts(spark, values)
    assert result(df.withColumn("x", strip(F.col("t")))) == [v.strip() for v in values]
    assert result(df.withColumn("x", is_blank(F.col("t")))) == [not v.strip() for v in values]


def test_stop_words_are_spark_ml_default(spark):
    assert STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_term_counts_match_a_counter(spark):
    rng = random.Random(2)
    words = ["The", "data", "Data", "été", "a", "x1", "over", "C_D", "naïve", "go", "don't", "42", "é"]
    values = [" ,.\n-+"[rng.randrange(6)].join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(200)]
    want = []
    for v in values:
        found = Counter(w for w in re.findall(r"\w\w+", v.lower()) if w not in set(STOP_WORDS))
        want.append(sorted(found.items()))
    got = result(texts(spark, values).withColumn("x", term_counts("t")))
    assert [list(zip(row["terms"], row["tfs"])) for row in got] == want
    assert [row["squares"] for row in got] == [sum(n * n for _, n in w) for w in want]


def test_plain_characters(spark):
    df = texts(spark, ["a—b–c ‘d’ “e” f…", "plain"])
    assert result(df.withColumn("x", plain_characters(F.col("t")))) == ["a-b-c 'd' \"e\" f...", "plain"]
