"""Decoding of logits: nothing that a token needs once is computed for every label."""

import math

from pyspark.sql import functions as F

from veilspan.operators import ner


def test_logits_are_decoded_once_a_token(spark):
    labels = ("O", "B-PER", "I-PER", "B-ORG", "X", "B-B-PER", "MISC", None)
    logits = [0.5, 1.0, -2.0, 3.0, 0.0, 1.5, 3.0, -1.0]
    df = spark.createDataFrame([(1, logits)], "k long, logits array<double>")
    decoded = ner.decode(df, F.array(*[F.lit(x) for x in labels]))
    e = [math.exp(x - 3.0) for x in logits]
    p = [x / sum(e) for x in e]
    row = decoded.first()
    want = {"p_per": p[1] + p[2], "p_org": p[3], "p_loc": 0.0, "p_misc": p[6], "p_o": p[0] + p[4] + p[5] + p[7]}
    assert row.bio_tag == "B-ORG" and all(abs(row[k] - v) < 1e-12 for k, v in want.items())
    plan = decoded._jdf.queryExecution().analyzed().toString()
    softmax = df.select(ner.softmax(F.col("logits")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert softmax.count("array_max(") == 1 and "regexp_replace" not in plan
