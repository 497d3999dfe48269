"""Named queries over sequences, clusters, aggregates, intervals and strings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import intervals, text
from quire.operators import aggregates, cluster, interval_join, sequence
from quire.plans.inputs import CELLS_SQL, LOCKS_SQL, cells, locks
from quire.runtime import table

USER, TIME = ["user_id"], ["ts", "event_id"]


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def group_by_pairs(spark, sf):
    """Events of a user, parted where over an hour lies between two."""
    hour = lambda p, c: c("ts").cast("double") - p("ts").cast("double") <= 3600
    return sequence.group_by_pairs(_events(spark, sf), USER, TIME, hour).select("event_id", "user_id", F.col("grp").cast("bigint").alias("grp"))


GROUP_BY_PAIRS = """SELECT event_id, user_id, CAST(sum(CASE WHEN epoch(ts) - epoch(p) > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS grp
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"""


def split_on_pairs(spark, sf):
    """A customer's orders, split before each that costs more than the one before."""
    orders = table(spark, sf, "orders")
    return sequence.split_on_pairs(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], lambda p, c: c("o_totalprice") > p("o_totalprice")).select("o_orderkey", F.col("grp").cast("bigint").alias("grp"))


SPLIT_ON_PAIRS = """SELECT o_orderkey, CAST(sum(CASE WHEN o_totalprice > p THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS grp
FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)"""


def spans(spark, sf):
    """Runs of a user's events of high and of low value."""
    runs = sequence.spans(_events(spark, sf), USER, TIME, F.col("value") > 50)
    return runs.groupBy("user_id", F.col("grp").cast("bigint").alias("grp"), "holds").agg(F.count("*").alias("n"))


SPANS = """WITH f AS (SELECT *, coalesce(value > 50, false) AS holds FROM events), g AS (SELECT *, lag(holds) OVER w AS p FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, sum(CASE WHEN p <> holds THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM g)
SELECT user_id, CAST(grp AS BIGINT) AS grp, holds, count(*) AS n FROM h GROUP BY ALL"""


def unique_counts(spark, sf):
    return sequence.unique_count_by(_events(spark, sf), USER, "event_type", "event_id", "value")


UNIQUE_COUNTS = "SELECT user_id, event_type, count(*) AS n, arg_min(value, event_id) AS first_value FROM events GROUP BY ALL"


def trimmed(spark, sf):
    """Events of a user without those of low value at either end."""
    numbered = _events(spark, sf).withColumn("pos", F.row_number().over(sequence.over(USER, TIME)))
    return sequence.trim(numbered, USER, "pos", F.col("value") < 30).select("event_id", "user_id", F.col("pos").cast("bigint").alias("pos"))


TRIMMED = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
e AS (SELECT user_id, min(pos) AS a, max(pos) AS b FROM n WHERE NOT coalesce(value < 30, false) GROUP BY user_id) SELECT event_id, n.user_id, pos FROM n JOIN e ON n.user_id = e.user_id AND pos BETWEEN a AND b"""


def sliding(spark, sf):
    return sequence.sliding(_events(spark, sf), USER, TIME, "event_id", 3).select("event_id", "window")


SLIDING = """SELECT event_id, "window" FROM (SELECT event_id, list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS "window",
  count(*) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) WHERE len("window") = 3 OR (i = 1 AND m < 3)"""


def deltas(spark, sf):
    """Steps of value, distance to the next id and whether ids follow on."""
    e = sequence.deltas(_events(spark, sf), USER, TIME, "event_id", "step")
    e = sequence.item_gaps(e, USER, TIME, "event_id", F.col("event_id") + 1)
    return sequence.consecutive(e, USER, TIME, "event_id").select("event_id", "step", "gap", "follows")


DELTAS = """WITH d AS (SELECT *, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events), k AS (SELECT * FROM d WHERE step IS NOT NULL)
SELECT event_id, step, coalesce(lead(event_id) OVER w - event_id - 1, 0) AS gap, lag(event_id) OVER w = event_id - 1 AS follows FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def neighbours(spark, sf):
    e = sequence.neighbours(_events(spark, sf), USER, TIME, ["event_id", "event_type"])
    return e.select("event_id", F.col("prev1.event_id").alias("before"), F.col("next1.event_type").alias("after_type"))


NEIGHBOURS = "SELECT event_id, lag(event_id) OVER w AS before, lead(event_type) OVER w AS after_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def unique_by(spark, sf):
    return sequence.unique_by(_events(spark, sf), ["user_id", "event_type"], TIME).select("user_id", "event_type", "event_id")


UNIQUE_BY = "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL"


def vertical_jumps(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return sequence.vertical_jumps(part, ["p_brand"], "p_size", ["p_partkey"]).select("p_partkey", "jump")


VERTICAL_JUMPS = "SELECT p_partkey, jump FROM (SELECT p_partkey, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - p_size AS jump FROM part) WHERE jump IS NOT NULL"


def windowed(spark, sf):
    """Greedy groups of a user's events, each of at most 100 in value but for single larger ones."""
    fits = lambda group, row: group["value"].sum() + row["value"] <= 100
    e = _events(spark, sf).select("user_id", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    return sequence.group_by_window(e, USER, ["event_id"], fits)


def greedy(spark, sf):
    """A conversation's turns grouped with the first turn of the same role and about the same length."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return cluster.cluster_by(turns, ["conv_id"], ["turn"], lambda a, b: a["role"] == b["role"] and abs(a["n"] - b["n"]) <= 200)


def nearest_bins(spark, sf):
    """Order prices of a priority in bins of 500 either way."""
    orders = table(spark, sf, "orders").select("o_orderpriority", (F.floor(F.col("o_totalprice") / 100) * 100).cast("int").alias("price"))
    return cluster.qnn(orders, ["o_orderpriority"], "price", 50.0)


def bin_ranges(spark, sf):
    return cluster.bin_ranges(nearest_bins(spark, sf), ["o_orderpriority"])


def histogram(spark, sf):
    return cluster.sparse_histogram(_events(spark, sf), ["event_type"], "value", 1.4)


HISTOGRAM = "SELECT event_type, CAST(floor(value / CAST(1.4 AS DOUBLE)) AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL"


def _links(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    a = c.select((F.col("c_custkey") + 1000).alias("a"), (F.col("c_nationkey") + 100).cast("bigint").alias("b"))
    return a.unionByName(n.select((F.col("n_nationkey") + 100).cast("bigint").alias("a"), F.col("n_regionkey").cast("bigint").alias("b")))


def components(spark, sf):
    """Customers, nations and regions that hang together."""
    return cluster.connected_components(_links(spark, sf))


COMPONENTS = """WITH e AS (SELECT c_custkey + 1000 AS node, n_regionkey AS component FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation)
SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM e UNION SELECT CAST(component AS BIGINT), CAST(component AS BIGINT) FROM e"""


# --- aggregates -------------------------------------------------------------------------


def document_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


DOCUMENT_COUNT = "SELECT count(*) AS n FROM documents"


def zero_kept(spark, sf):
    return aggregates.zero_kept_counts(locks(spark, sf), "status", ["Available", "Locked", "Completed", "OnHold"], F.col("path") == "Curation.Header")


ZERO_KEPT = f"SELECT status, count(lock) AS n FROM (SELECT unnest(['Available', 'Locked', 'Completed', 'OnHold']) AS status) s LEFT JOIN (SELECT lock, status FROM ({LOCKS_SQL}) WHERE path = 'Curation.Header') USING (status) GROUP BY status"


def mode(spark, sf):
    return aggregates.most_common(table(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("int")), ["l_returnflag", "l_linestatus"], "q")


MODE = """SELECT l_returnflag, l_linestatus, q, n FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC, q) AS k
FROM (SELECT l_returnflag, l_linestatus, CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1"""


def commonest_offset(spark, sf):
    """For each document the column at the first place of its commonest character."""
    c = cells(spark, sf).withColumn("ord", F.col("row").cast("bigint") * 4_294_967_296 + F.col("col"))
    return aggregates.offset_of_commonest(c, ["doc_id"], "char", "col", "ord")


COMMONEST_OFFSET = f"""SELECT doc_id, offset_ AS "offset" FROM (SELECT doc_id, char, count(*) AS n, arg_min(col, row * 4294967296 + col) AS offset_, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, encode(char)) AS k FROM ({CELLS_SQL}) GROUP BY doc_id, char) WHERE k = 1"""


def _table(spark, sf):
    return aggregates.table(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint"), F.sum)


def marginals(spark, sf):
    return aggregates.marginals(_table(spark, sf))


MARGINALS = "SELECT r, c, CAST(sum(a) AS BIGINT) AS a FROM (SELECT l_returnflag AS r, l_linestatus AS c, sum(CAST(l_quantity AS BIGINT)) AS a FROM lineitem GROUP BY ALL) GROUP BY GROUPING SETS ((r), (c))"


def pivot(spark, sf):
    return aggregates.pivoted(_table(spark, sf), ["F", "O"], "total")


PIVOT = """SELECT l_returnflag AS r, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS "F", CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS "O",
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus IN ('F', 'O')), 0) AS BIGINT) AS total FROM lineitem GROUP BY 1"""


def modified(spark, sf):
    """The table with cells of another merged in, and one set."""
    cells_ = _table(spark, sf)
    more = aggregates.table(table(spark, sf, "orders"), "o_orderstatus", "o_orderstatus", F.lit(1).cast("bigint"), F.sum)
    both = aggregates.modify(cells_, more, lambda a, b: a + b)
    return aggregates.put(both, spark.createDataFrame([("N", "O", 7)], "r string, c string, a bigint"))


MODIFIED = """WITH t AS (SELECT l_returnflag AS r, l_linestatus AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS a FROM lineitem GROUP BY ALL UNION ALL SELECT o_orderstatus, o_orderstatus, count(*) FROM orders GROUP BY ALL)
SELECT r, c, CAST(sum(a) AS BIGINT) AS a FROM t WHERE NOT (r = 'N' AND c = 'O') GROUP BY ALL UNION ALL SELECT 'N', 'O', 7"""


def listing(spark, sf):
    """The second hundred documents with the labels that their conversation has."""
    conv = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "role")
    return aggregates.listing(table(spark, sf, "documents"), conv, "doc_id", "role", 100, 100)


LISTING = """SELECT d.doc_id, count(role) AS n_labels, coalesce(list_sort(list(DISTINCT role) FILTER (role IS NOT NULL)), []) AS labels FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 100) d LEFT JOIN conversations ON conv_id = d.doc_id GROUP BY d.doc_id"""


def top_orders(spark, sf):
    return aggregates.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


TOP_ORDERS = "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"


def aligned(spark, sf):
    """Two customers' orders side by side by place."""
    o = table(spark, sf, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint"))
    side = lambda odd, name: o.filter(F.col("o_custkey") % 2 == odd).select(F.floor(F.col("o_custkey") / 2).alias("pair"), "place", F.col("o_orderkey").alias(name))
    return aggregates.zip_all(side(0, "a"), side(1, "b"), ["pair"], "place")


ALIGNED = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
SELECT coalesce(x.pair, y.pair) AS pair, coalesce(x.place, y.place) AS place, a, b FROM (SELECT o_custkey // 2 AS pair, place, o_orderkey AS a FROM o WHERE o_custkey % 2 = 0) x FULL JOIN (SELECT o_custkey // 2 AS pair, place, o_orderkey AS b FROM o WHERE o_custkey % 2 = 1) y ON x.pair = y.pair AND x.place = y.place"""


def set_algebra(spark, sf):
    """Customers with orders of both, of only the first, and of any of two priorities."""
    o = table(spark, sf, "orders")
    a, b = (o.filter(F.col("o_orderpriority").startswith(p)).select("o_custkey").distinct() for p in ("1", "2"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b).withColumn("kind", F.lit("first"))).unionByName(a.union(b).distinct().withColumn("kind", F.lit("any")))


SET_ALGEBRA = """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '2%')
SELECT o_custkey, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT o_custkey, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT o_custkey, 'any' FROM (SELECT * FROM a UNION SELECT * FROM b)"""


# --- intervals --------------------------------------------------------------------------


def _spans_of_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("s"), (F.unix_date(F.to_date("o_orderdate")) + (F.col("o_orderkey") % 4).cast("int")).alias("e"), (F.col("o_custkey") % 20).alias("k"), "o_custkey")


def stabbing(spark, sf):
    """Shipping dates within the few days after an order of the same group."""
    points = table(spark, sf, "lineitem").select(F.unix_date(F.to_date("l_shipdate")).alias("p"), (F.col("l_partkey") % 20).alias("k"))
    return interval_join.stab_counts(_spans_of_orders(spark, sf), points, "s", "e", "p", 8, ["o_orderkey"], ["k"]).withColumnRenamed("first", "first_day")


_ORDER_SPANS = "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 4 AS INTEGER) AS e, o_custkey % 20 AS k, o_custkey FROM orders"
STABBING = f"SELECT o_orderkey, count(*) AS n, CAST(min(p) AS INTEGER) AS first_day FROM ({_ORDER_SPANS}) o JOIN (SELECT date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS p, l_partkey % 20 AS k FROM lineitem) l ON o.k = l.k AND p BETWEEN s AND e GROUP BY o_orderkey"


def overlapping(spark, sf):
    """Orders of one customer whose days overlap; every tenth never ends."""
    o = _spans_of_orders(spark, sf).withColumn("k", F.col("o_custkey")).withColumn("e", F.when(F.col("o_orderkey") % 10 != 0, F.col("e")))
    b = o.select(F.col("o_orderkey").alias("other"), F.col("s").alias("bs"), F.col("e").alias("be"), "k")
    pairs = interval_join.overlap(o, b, ("s", "e"), ("bs", "be"), 30, ["k"])
    return pairs.select("o_orderkey", "other")


OVERLAPPING = f"""WITH o AS (SELECT o_orderkey, s, CASE WHEN o_orderkey % 10 <> 0 THEN e END AS e, o_custkey AS k FROM ({_ORDER_SPANS}))
SELECT a.o_orderkey, b.o_orderkey AS other FROM o a JOIN o b ON a.k = b.k WHERE (b.e IS NULL OR a.s <= b.e) AND (a.e IS NULL OR b.s <= a.e)"""


def interval_algebra(spark, sf):
    """Each order's days against a fixed half-open month."""
    iv = intervals.Interval
    o = _spans_of_orders(spark, sf)
    a = iv.of(F.col("s"), F.col("e"))
    b = iv.of(F.lit(9500), F.lit(10500), True, False)
    i = a.intersection(b)
    span = intervals.Span(F.col("s"), F.col("e") - F.col("s") + 1)
    return o.select("o_orderkey", i["start"].alias("s2"), i["end"].alias("e2"), i["end_in"].alias("e_in"), a.intersects(b).alias("meets"), b.contains_interval(a).alias("inside"), a.left_of(b).alias("before"), a.right_of(b).alias("after"), b.contains(F.col("s")).alias("has_start"), a.midpoint(True).cast("int").alias("mid"), a.is_point().alias("point"), a.empty(True).alias("empty"), span.contains(F.lit(10000)).alias("has_day"), span.union(intervals.Span(F.lit(10000), F.lit(5))).length.alias("union_len"))


INTERVAL_ALGEBRA = f"""WITH q AS (SELECT *, greatest(s, 9500) AS a, least(e, 10500) AS b FROM ({_ORDER_SPANS})), m AS (SELECT *, a < b OR (a = b AND b <> 10500) AS x FROM q)
SELECT o_orderkey, CASE WHEN x THEN a END AS s2, CASE WHEN x THEN b END AS e2, CASE WHEN x THEN b <> 10500 END AS e_in, x AS meets, s >= 9500 AND e < 10500 AS inside, e < 9500 AS before, s >= 10500 AS after,
  s >= 9500 AND s < 10500 AS has_start, s + (e - s) // 2 AS mid, s = e AS point, false AS empty, s <= 10000 AND 10000 <= e AS has_day, greatest(e + 1, 10005) - least(s, 10000) AS union_len FROM m"""


# --- strings ----------------------------------------------------------------------------


def string_functions(spark, sf):
    x = F.col("p_name")
    camel = F.array_join(F.transform(F.split(x, " "), lambda w: F.initcap(w)), "")
    return table(spark, sf, "part").select("p_partkey", text.snake_case(camel).alias("snake"), text.underscore_case(camel).alias("under"), text.camel_case(text.snake_case(camel)).alias("camel"), text.squared(x).alias("squared"), text.hashed(x).alias("sha"), text.trim_quotes(F.concat(F.lit(' "'), x, F.lit('" '))).alias("bare"), text.char_class(F.substring(x, 1, 1)).alias("class"), text.path_filter(x, "[a-m].*").alias("passes"))


STRING_FUNCTIONS = """WITH q AS (SELECT p_partkey, p_name, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], '') AS camel FROM part)
SELECT p_partkey, lower(regexp_replace(regexp_replace(camel, '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS snake, lower(regexp_replace(regexp_replace(camel, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS "under",
  array_to_string([upper(w[1]) || w[2:] for w in string_split(lower(regexp_replace(regexp_replace(camel, '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g'), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '-')], '') AS camel,
  '[' || p_name || ']' AS squared, sha1(p_name) AS sha, p_name AS bare,
  CASE WHEN contains('acemnorsuvwxz', p_name[1]) THEN 'midrise' WHEN contains('bdfhklt', p_name[1]) THEN 'ascender' WHEN contains('gjpqy', p_name[1]) THEN 'descender' WHEN contains('ABCDEFGHIJKLMNOPQRSTUVWXYZ', p_name[1]) THEN 'caps' END AS "class", regexp_full_match(p_name, '[a-m].*') AS passes FROM q"""


def times_and_json(spark, sf):
    props = text.parsed_or_null(F.col("props"), "k int, v string")
    return _events(spark, sf).select("event_id", text.millis(F.col("ts")).alias("millis"), text.stamp(F.col("ts")).alias("stamp"), F.get_json_object("props", "$.k").alias("k"), (text.instant(text.millis(F.col("ts"))) == F.date_trunc("millisecond", "ts")).alias("round_trip"), props.isNotNull().alias("parsed"))


TIMES_AND_JSON = "SELECT event_id, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS stamp, props ->> '$.k' AS k, true AS round_trip, props IS NOT NULL AS parsed FROM events"


def arrays(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    pair = text.pairs(F.col("a"))
    return o.select("o_custkey", F.size(pair).cast("bigint").alias("n_pairs"), F.get(pair, F.lit(0))["b"].alias("second"), text.take(F.col("a"), 2).alias("head"), text.drop(F.col("a"), 2).alias("rest"), F.size(text.intersperse(F.col("a"), F.lit(0).cast("bigint"))).cast("bigint").alias("spread"))


ARRAYS = "SELECT o_custkey, len(a) - 1 AS n_pairs, CASE WHEN len(a) > 1 THEN a[2] END AS second, a[1:2] AS head, a[3:] AS rest, 2 * len(a) - 1 AS spread FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS a FROM orders GROUP BY 1)"

QUERIES = {
    "seq_group_by_pairs": group_by_pairs, "seq_split_on_pairs": split_on_pairs, "seq_spans": spans, "seq_unique_counts": unique_counts, "seq_trimmed": trimmed, "seq_sliding": sliding, "seq_deltas": deltas, "seq_neighbours": neighbours, "seq_unique_by": unique_by, "seq_vertical_jumps": vertical_jumps, "seq_windowed": windowed,
    "clu_greedy": greedy, "clu_nearest_bins": nearest_bins, "clu_bin_ranges": bin_ranges, "clu_histogram": histogram, "clu_components": components,
    "agg_document_count": document_count, "agg_zero_kept": zero_kept, "agg_mode": mode, "agg_commonest_offset": commonest_offset, "agg_marginals": marginals, "agg_pivot": pivot, "agg_modified": modified, "agg_listing": listing, "agg_top_orders": top_orders, "agg_aligned": aligned, "agg_set_algebra": set_algebra,
    "int_stabbing": stabbing, "int_overlapping": overlapping, "int_algebra": interval_algebra, "str_functions": string_functions, "str_times_and_json": times_and_json, "str_arrays": arrays,
}
SQL = {
    "seq_group_by_pairs": GROUP_BY_PAIRS, "seq_split_on_pairs": SPLIT_ON_PAIRS, "seq_spans": SPANS, "seq_unique_counts": UNIQUE_COUNTS, "seq_trimmed": TRIMMED, "seq_sliding": SLIDING, "seq_deltas": DELTAS, "seq_neighbours": NEIGHBOURS, "seq_unique_by": UNIQUE_BY, "seq_vertical_jumps": VERTICAL_JUMPS,
    "clu_histogram": HISTOGRAM, "clu_components": COMPONENTS, "agg_document_count": DOCUMENT_COUNT, "agg_zero_kept": ZERO_KEPT, "agg_mode": MODE, "agg_commonest_offset": COMMONEST_OFFSET, "agg_marginals": MARGINALS, "agg_pivot": PIVOT, "agg_modified": MODIFIED, "agg_listing": LISTING, "agg_top_orders": TOP_ORDERS, "agg_aligned": ALIGNED, "agg_set_algebra": SET_ALGEBRA,
    "int_stabbing": STABBING, "int_overlapping": OVERLAPPING, "int_algebra": INTERVAL_ALGEBRA, "str_functions": STRING_FUNCTIONS, "str_times_and_json": TIMES_AND_JSON, "str_arrays": ARRAYS,
}
