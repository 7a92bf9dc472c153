"""Rows with nulls, empty and long texts, repeats, and columns that clash with the operators' own."""

import duckdb

ODD = [
    (900001, "Hello a.b@c.de, call +1 (555) 123-4567 or 4111 1111 1111 1111; 10.0.0.256 and 10.0.0.25.\nline\nline"),
    (900002, None),
    (None, "no id here"),
    (900003, ""),
    (900004, " \t\n "),
    (900005, "x" * 30_000),
    (900006, "same row"),
    (900006, "same row"),
    (900007, "😀 ▁ é <|endoftext|> İstanbul ΑΣ don't 12٣ \x1c\x00"),
    (900008, "a b c " * 3_000),
]
CLASHING = "held_out boolean, score string, _text string, _stamp int, fp int, `n.x` int, kept int, items int"


def docs(spark, data, n=60):
    """n real documents and the odd rows, with a language, a source and clashing columns."""
    from pyspark.sql import functions as F

    real = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(n).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(*r, None) for r in ODD], "doc_id long, text string, lang string")
    return real.unionAll(odd).select("*", F.lit(True).alias("held_out"), *[F.lit("1").alias(c) for c in ("score", "_text", "_stamp", "fp", "n.x", "kept", "items", "component_id", "_id")])


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def oracle_rows(sql, data, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out
