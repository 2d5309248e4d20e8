import duckdb

DIR = "/root/testdata/sf0.001"


def table(name, columns="*"):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{DIR}/{name}.parquet'").fetchall()


def odd_documents(spark, rows=()):
    """Null, empty, repeated and very long texts, null ids, and a column whose name clashes with inner ones."""
    long = "Long words of some text, again and again. " * 4000
    data = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "One short text.", "y"), (4, "One short text.", "y"), (5, long, None), (None, "No id here at all", "z"), *rows]
    return spark.createDataFrame([(a, b, c, c) for a, b, c in data], "doc_id long, text string, node string, bucket string")


def empty(df):
    return df.limit(0)
