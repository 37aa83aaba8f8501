"""Small tables with every awkward case, for all operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                         # names that operators use inside
                         T.StructField("row", T.StringType()), T.StructField("key", T.LongType()), T.StructField("fp", T.IntegerType()),
                         T.StructField("grp", T.StringType()), T.StructField("id", T.StringType())])
LONG = " ".join(f"word{i}" for i in range(60_000))
PROSE = "The ship left the harbour at noon and came back with the tide before the lamps were lit along the quay that evening"


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    texts = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, LONG), (6, LONG + " end"), (None, "alone here"), (None, "alone here"),
             (7, "a@b.org +1 (555) 123-4567"), (8, " \t\n"), (8, "other text of the same id"), (None, None)]
    return [(i, t, "en" if k % 3 else None, "s" if k % 2 else None, None, "r", k, k, None, "x") for k, (i, t) in enumerate(texts)]


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """rows: (doc_id, text) or whole rows; the awkward ones if None."""
    rows = awkward() if rows is None else [r if len(r) > 2 else (*r, "en", "s", None, None, None, None, None, None) for r in rows]
    return spark.createDataFrame(rows, DOCUMENT)
