"""Small tables of documents for the tests."""

import json

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, source="a"):
    """Documents of (id, text) or (id, text, source), with a column whose name may clash."""
    full = [
        {"doc_id": r[0], "text": r[1], "lang": "en", "source": r[2] if len(r) > 2 else source, "n_chars": len(r[1] or "")}
        for r in rows
    ]
    table = spark.createDataFrame([json.dumps(r) for r in full], "string")
    return table.select(F.from_json("value", DOCS).alias("r")).select("r.*").withColumn("key", F.lit("clash"))
