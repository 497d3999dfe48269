"""Inputs of the named queries, derived from the driver's tables, each as a DataFrame and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import grid
from quire.runtime import table

PAIRS_SQL = """SELECT l_orderkey, l_linenumber,
  CAST(l_partkey % 97 * 100 AS INTEGER) AS al, CAST(l_suppkey % 83 * 100 AS INTEGER) AS "at", CAST(l_quantity * 100 AS INTEGER) AS aw, CAST(l_linenumber * 700 AS INTEGER) AS ah,
  CAST(l_orderkey % 89 * 100 AS INTEGER) AS bl, CAST(l_partkey % 71 * 100 AS INTEGER) AS bt, CAST(l_suppkey % 50 * 100 + 100 AS INTEGER) AS bw, CAST((l_orderkey % 40 + 1) * 100 AS INTEGER) AS bh
FROM lineitem"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two boxes a line item."""
    i = lambda c: c.cast("int")
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        i(c("l_partkey") % 97 * 100).alias("al"), i(c("l_suppkey") % 83 * 100).alias("at"), i(c("l_quantity") * 100).alias("aw"), i(c("l_linenumber") * 700).alias("ah"),
        i(c("l_orderkey") % 89 * 100).alias("bl"), i(c("l_partkey") % 71 * 100).alias("bt"), i(c("l_suppkey") % 50 * 100 + 100).alias("bw"), i((c("l_orderkey") % 40 + 1) * 100).alias("bh"),
    )


LINES_SQL = r"""SELECT doc_id, CAST(row - 1 AS INTEGER) AS row, line FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '\n+$', ''), chr(10))) AS line, unnest(range(1, len(string_split(regexp_replace(text, '\n+$', ''), chr(10))) + 1)) AS row FROM documents)"""

ROWS_SQL = rf"""SELECT doc_id, row, CAST(pad AS INTEGER) AS pad, body, CAST(length(body) AS INTEGER) AS n FROM (
  SELECT doc_id, row, length(line) - length(ltrim(line, ' ')) AS pad, regexp_replace(line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS body FROM ({LINES_SQL})) WHERE body <> ''"""

CELLS_SQL = f"""SELECT doc_id, row, CAST(pad + i AS INTEGER) AS col, body[i + 1] AS char,
  CAST((pad + i) * 1000 + 10 AS INTEGER) AS l, CAST(row * 1000 + 10 AS INTEGER) AS t, 980 AS w, 980 AS h
FROM (SELECT doc_id, row, pad, body, unnest(range(n)) AS i FROM ({ROWS_SQL}))"""

LINE_BOXES_SQL = f"""SELECT doc_id, 0 AS page, row AS line, CAST(pad * 1000 + 10 AS INTEGER) AS l, CAST(row * 1000 + 10 AS INTEGER) AS t, CAST((n - 1) * 1000 + 980 AS INTEGER) AS w, 980 AS h, n FROM ({ROWS_SQL})"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return grid.from_text(table(spark, sf, "documents"))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    """The texts' rows, not cut into cells."""
    return grid.rows_of_text(table(spark, sf, "documents"))


def line_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of the texts' lines, one page a document, made without exploding the characters."""
    padded = grid.lines(table(spark, sf, "documents")).withColumn("pad", F.length("line") - F.length(F.ltrim("line"))).withColumn("n", F.length(F.regexp_replace("line", "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""))).filter("n > 0")
    return padded.select("doc_id", F.lit(0).alias("page"), F.col("row").alias("line"), (F.col("pad") * 1000 + 10).alias("l"), (F.col("row") * 1000 + 10).alias("t"), ((F.col("n") - 1) * 1000 + 980).alias("w"), F.lit(980).alias("h"), "n")


ROLES_SQL = """SELECT conv_id, turn, role, conv_id * 100000 + turn AS node FROM conversations"""

LOCKS_SQL = """SELECT o_orderkey AS lock, o_orderkey % 60 AS document, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_custkey END AS holder,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Curation.Header' ELSE 'Curation.References' END AS path,
  CASE o_orderstatus WHEN 'O' THEN 'Available' WHEN 'P' THEN 'Locked' ELSE 'Completed' END AS status FROM orders"""


def locks(spark: SparkSession, sf: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("lock"), (k % 60).alias("document"), F.when(s != "O", F.col("o_custkey")).alias("holder"),
        F.when(k % 3 == 0, "Curation.Header").otherwise("Curation.References").alias("path"),
        F.when(s == "O", "Available").when(s == "P", "Locked").otherwise("Completed").alias("status"),
    )


PATHS_SQL = """SELECT c_custkey AS annotation, c_custkey % 50 AS document, c_custkey % 7 AS owner,
  concat(replace(r_name, ' ', '_'), '.', replace(n_name, ' ', '_'), '.', c_mktsegment) AS path, c_mktsegment AS label
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """One annotation a customer, its path region.nation.segment."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    safe = lambda x: F.replace(F.col(x), F.lit(" "), F.lit("_"))
    return joined.select(F.col("c_custkey").alias("annotation"), (F.col("c_custkey") % 50).alias("document"), (F.col("c_custkey") % 7).alias("owner"), F.concat_ws(".", safe("r_name"), safe("n_name"), "c_mktsegment").alias("path"), F.col("c_mktsegment").alias("label"))
