"""Named queries over the geometry, fixed-point and path functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import fixed, geometry
from quire.functions.geometry import Box, GridBox, Line, Point, Trapezoid
from quire.plans.inputs import PAIRS_SQL, pairs
from quire.runtime import table

KEY = ("l_orderkey", "l_linenumber")


def boxes(spark, sf):
    a = Box.of("a")
    s, g, c = a.shave(10), a.scale(-2.0), a.point("Center")
    low = a.to_low_left()
    return pairs(spark, sf).select(
        *KEY, a.right.alias("r"), a.bottom.alias("b"), a.area().alias("area"), s.left.alias("shaved_l"), s.top.alias("shaved_t"), s.width.alias("shaved_w"), s.height.alias("shaved_h"),
        g.width.alias("scaled_w"), g.height.alias("scaled_h"), c.x.alias("centre_x"), c.y.alias("centre_y"), low["bottom"].alias("low_bottom"), a.pretty().alias("pretty"), a.uri().alias("uri"),
        a.to_origin().left.alias("origin_l"), a.translate(50, -50).top.alias("moved_t"), a.overlaps_x(F.lit(2000)).alias("over_x"), a.overlaps_y(F.lit(2000)).alias("over_y"),
    )


BOXES = f"""SELECT l_orderkey, l_linenumber, al + aw AS r, "at" + ah AS b, trunc(aw / 100.0 * (ah / 100.0) * 100) / 100 AS area,
  al + 10 AS shaved_l, "at" + 10 AS shaved_t, aw - 20 AS shaved_w, ah - 20 AS shaved_h,
  aw + CAST(trunc(aw / 100.0 * -0.02 * 100) AS INTEGER) AS scaled_w, ah + CAST(trunc(ah / 100.0 * -0.02 * 100) AS INTEGER) AS scaled_h,
  al + CAST(trunc(aw / 2.0) AS INTEGER) AS centre_x, "at" + CAST(trunc(ah / 2.0) AS INTEGER) AS centre_y, "at" + ah AS low_bottom,
  printf('(l:%d.%02d, t:%d.%02d, w:%d.%02d, h:%d.%02d)', al // 100, al % 100, "at" // 100, "at" % 100, aw // 100, aw % 100, ah // 100, ah % 100) AS pretty,
  concat(al, '_', "at", '_', aw, '_', ah) AS uri, 0 AS origin_l, "at" - 50 AS moved_t, 2000 BETWEEN al AND al + aw AS over_x, 2000 BETWEEN "at" AND "at" + ah AS over_y
FROM ({PAIRS_SQL})"""


def splits(spark, sf):
    """Every box cut at the other's corner, and the middle one of its three slices."""
    a = Box.of("a")
    left, right = a.split_vertical(F.col("bl"))
    top, bottom = a.split_horizontal(F.col("bt"))
    band = a.vertical_slice(F.col("bl"), F.lit(500))
    middle = F.element_at(a.horizontal_slices(3), 2)
    return pairs(spark, sf).select(*KEY, left["width"].alias("left_w"), right["left"].alias("right_l"), right["width"].alias("right_w"), top["height"].alias("top_h"), bottom["top"].alias("bottom_t"), bottom["height"].alias("bottom_h"), band["left"].alias("band_l"), band["width"].alias("band_w"), middle["top"].alias("mid_t"), middle["height"].alias("mid_h"))


SPLITS = f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN al < bl THEN least(bl - al, aw) END AS left_w, CASE WHEN bl < al + aw THEN greatest(al, bl) END AS right_l, CASE WHEN bl < al + aw THEN al + aw - greatest(al, bl) END AS right_w,
  CASE WHEN "at" < bt THEN least(bt - "at", ah) END AS top_h, CASE WHEN bt < "at" + ah THEN greatest("at", bt) END AS bottom_t, CASE WHEN bt < "at" + ah THEN "at" + ah - greatest("at", bt) END AS bottom_h,
  CASE WHEN bl < al + aw AND greatest(al, bl) < bl + 500 THEN greatest(al, bl) END AS band_l,
  CASE WHEN bl < al + aw AND greatest(al, bl) < bl + 500 THEN least(bl + 500, al + aw) - greatest(al, bl) END AS band_w,
  "at" + CAST(trunc(ah / 3.0) AS INTEGER) AS mid_t, CAST(trunc(ah / 3.0) AS INTEGER) AS mid_h
FROM ({PAIRS_SQL})"""


def relations(spark, sf):
    a, b = Box.of("a"), Box.of("b")
    i, u = a.intersection(b), a.union(b)
    return pairs(spark, sf).select(
        *KEY, i["left"].alias("il"), i["top"].alias("it"), i["width"].alias("iw"), i["height"].alias("ih"), u.left.alias("ul"), u.top.alias("ut"), u.width.alias("uw"), u.height.alias("uh"),
        a.intersects(b).alias("intersects"), a.meets(b).alias("meets"), a.overlapping_area(b).alias("overlapping"), a.overlaps(b).alias("overlaps"), a.touches(b).alias("touches"), a.shares_edge(b).alias("edge"),
        a.within(b).alias("within"), a.above(b).alias("above"), a.below(b).alias("below"), a.left_of(b).alias("left_of"), a.right_of(b).alias("right_of"), a.level_with(b).alias("level"), a.in_line_with(b).alias("in_line"),
        F.round(a.centre_distance(b), 6).alias("distance"), a.equals(b).alias("same"),
    )


RELATIONS = f"""SELECT l_orderkey, l_linenumber, CASE WHEN x THEN gl END AS il, CASE WHEN x THEN gt END AS it, CASE WHEN x THEN lr - gl END AS iw, CASE WHEN x THEN lb - gt END AS ih,
  least(al, bl) AS ul, least("at", bt) AS ut, greatest(ar, br) - least(al, bl) AS uw, greatest(ab, bb) - least("at", bt) AS uh,
  x AS intersects, lr >= gl AND lb >= gt AS meets, x AS overlapping, x AND trunc((lr - gl) / 100.0 * ((lb - gt) / 100.0) * 100) > 0 AS overlaps, x AND trunc((lr - gl) / 100.0 * ((lb - gt) / 100.0) * 100) = 0 AS touches,
  al = bl OR ar = br OR "at" = bt OR ab = bb AS edge, al >= bl AND ar <= br AND "at" >= bt AND ab <= bb AS within,
  ab < bt AS above, "at" > bb AS below, ar < bl AS left_of, al > br AS right_of, NOT (ab < bt) AND NOT ("at" > bb) AS level, NOT (ar < bl) AND NOT (al > br) AS in_line,
  round(sqrt(pow((al + trunc(aw / 2.0) - bl - trunc(bw / 2.0)) / 100, 2) + pow(("at" + trunc(ah / 2.0) - bt - trunc(bh / 2.0)) / 100, 2)), 6) AS distance, al = bl AND "at" = bt AND aw = bw AND ah = bh AS same
FROM (SELECT *, lr > gl AND lb > gt AS x FROM (SELECT *, al + aw AS ar, "at" + ah AS ab, bl + bw AS br, bt + bh AS bb, greatest(al, bl) AS gl, greatest("at", bt) AS gt, least(al + aw, bl + bw) AS lr, least("at" + ah, bt + bh) AS lb FROM ({PAIRS_SQL})))"""


def burst(spark, sf):
    """All parts that two boxes cut each other into."""
    return pairs(spark, sf).select(*KEY, F.explode(Box.of("a").burst(Box.of("b"))).alias("p")).select(*KEY, "p.*")



def _burst_sql() -> str:
    def side(o: str, i: str) -> str:
        ol, ot, orr, ob = (f"{o}{x}" for x in ("x1", "y1", "x2", "y2"))
        il, it, ir, ib = (f"{i}{x}" for x in ("x1", "y1", "x2", "y2"))

        def axis(d: str, olo: str, ohi: str, ilo: str, ihi: str) -> tuple[str, str, str]:
            lo = f"CASE {d} WHEN 0 THEN {olo} WHEN 1 THEN greatest({olo}, {ilo}) ELSE greatest({olo}, {ihi}) END"
            hi = f"CASE {d} WHEN 0 THEN least({ilo}, {ohi}) WHEN 1 THEN least({ihi}, {ohi}) ELSE {ohi} END"
            ok = f"CASE {d} WHEN 0 THEN {olo} < {ilo} WHEN 1 THEN {ilo} < {ohi} AND greatest({olo}, {ilo}) < {ihi} ELSE {ihi} < {ohi} END"
            return lo, hi, ok

        xl, xh, xo = axis("dx", ol, orr, il, ir)
        yl, yh, yo = axis("dy", ot, ob, it, ib)
        return f"SELECT l_orderkey, l_linenumber, 1 AS k, {xl} AS \"left\", {yl} AS top, {xh} - ({xl}) AS width, {yh} - ({yl}) AS height FROM q, d WHERE {xo} AND {yo}"

    return f"""WITH q AS (SELECT l_orderkey, l_linenumber, al AS ax1, "at" AS ay1, al + aw AS ax2, "at" + ah AS ay2, bl AS bx1, bt AS by1, bl + bw AS bx2, bt + bh AS by2 FROM ({PAIRS_SQL})),
    d AS (SELECT dx, dy FROM (SELECT unnest([0, 1, 2]) AS dx) a, (SELECT unnest([0, 1, 2]) AS dy) b WHERE dx <> 1 OR dy <> 1),
    p AS (
      SELECT l_orderkey, l_linenumber, 0 AS k, greatest(ax1, bx1) AS "left", greatest(ay1, by1) AS top, least(ax2, bx2) - greatest(ax1, bx1) AS width, least(ay2, by2) - greatest(ay1, by1) AS height
      FROM q WHERE greatest(ax1, bx1) < least(ax2, bx2) AND greatest(ay1, by1) < least(ay2, by2)
      UNION ALL {side("b", "a")} UNION ALL {side("a", "b")})
    SELECT l_orderkey, l_linenumber, "left", top, width, height FROM p"""


BURST = _burst_sql()


def lines(spark, sf):
    """The line between two corners, and the trapezoid of the boxes' bases."""
    a, b = Box.of("a"), Box.of("b")
    n = Line(a.left, a.top, b.left, b.top)
    c = n.clip(a)
    half = n.split_vertical(a.left + 300)
    t = Trapezoid.of_lines(a.line("Bottom"), b.line("Bottom"))
    return pairs(spark, sf).select(
        *KEY, n.rise().alias("rise"), n.run().alias("run"), F.round(n.angle(), 6).alias("angle"), F.round(n.length(), 6).alias("length"), F.round(n.slope(), 6).alias("slope"), n.centre().x.alias("centre_x"),
        n.bounds().left.alias("bl2"), n.bounds().width.alias("bw2"), c.x2.alias("clip_x2"), c.y2.alias("clip_y2"), half["l"]["x2"].alias("half_x"),
        F.round(Point(a.left, a.top).angle_to(Point(b.left, b.top)), 6).alias("up_angle"), t.top_y.alias("top_y"), t.bounds().width.alias("trap_w"),
        geometry.angle_class(t.left_angle()).alias("left_class"), geometry.angle_class(t.right_angle()).alias("right_class"), geometry.angle_filter(n.angle(), -0.5, 0.5).alias("flat"),
    ).filter("top_y IS NOT NULL")


LINES = f"""WITH q AS (SELECT *, "at" AS ay, (bt - "at") / 100.0 AS rise, (bl - al) / 100.0 AS run, "at" + ah AS ab, bt + bh AS bb FROM ({PAIRS_SQL})),
t AS (SELECT *, CASE WHEN ab <= bb THEN al ELSE bl END AS tx, CASE WHEN ab <= bb THEN aw ELSE bw END AS tw, CASE WHEN ab <= bb THEN bl ELSE al END AS bx, CASE WHEN ab <= bb THEN bw ELSE aw END AS bw2_, least(ab, bb) AS ty, greatest(ab, bb) AS by_ FROM q),
g AS (SELECT *, atan2((by_ - ty) / 100.0, (tx - bx) / 100.0) AS la, pi() - atan2((by_ - ty) / 100.0, (tx + tw - bx - bw2_) / 100.0) AS ra, atan2(rise, run) - pi() * floor((atan2(rise, run) + pi() / 2) / pi()) AS fa FROM t)
SELECT l_orderkey, l_linenumber, rise, run, round(atan2(rise, run), 6) AS angle, round(sqrt(run * run + rise * rise), 6) AS length, CASE WHEN run <> 0 THEN round(rise / run, 6) + 0.0 END AS slope,
  CAST(trunc((al + bl) / 2.0) AS INTEGER) AS centre_x, least(al, bl) AS bl2, abs(al - bl) AS bw2, least(greatest(al, bl), al + aw) AS clip_x2, least(greatest(ay, bt), ay + ah) AS clip_y2,
  CASE WHEN least(al, bl) < al + 300 AND al + 300 < greatest(al, bl) THEN al + 300 END AS half_x, round(atan2((ay - bt) / 100.0, run), 6) AS up_angle, ty AS top_y, greatest(tx + tw, bx + bw2_) - least(tx, bx) AS trap_w,
  CASE WHEN la BETWEEN pi() / 2 - 0.08 AND pi() / 2 + 0.08 THEN 'Right' WHEN la < pi() / 2 THEN 'Acute' ELSE 'Obtuse' END AS left_class,
  CASE WHEN ra BETWEEN pi() / 2 - 0.08 AND pi() / 2 + 0.08 THEN 'Right' WHEN ra < pi() / 2 THEN 'Acute' ELSE 'Obtuse' END AS right_class, fa >= -0.5 AND fa < 0.5 AS flat FROM g"""


def exact_numbers(spark, sf):
    x, y = fixed.to_exact(F.col("l_extendedprice")), fixed.to_exact(F.col("l_quantity"))
    low, high = fixed.around(x, 5.0)
    return table(spark, sf, "lineitem").select(*KEY, x.alias("exact"), fixed.as_int(x).alias("whole"), fixed.multiply(y, F.col("l_discount").cast("double") * 0 + F.lit(250)).alias("product"), fixed.divide(x, y).alias("quotient"), fixed.show(y).alias("shown"), fixed.compare_fuzzy(y, F.lit(2500), 0.5).alias("cmp"), fixed.clamp(y, 1000, 4000).alias("clamped"), fixed.within(y, 1000, 4000).alias("within"), low.alias("low"), high.alias("high"))


EXACT = """WITH q AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_extendedprice * 100) AS INTEGER) AS x, CAST(trunc(l_quantity * 100) AS INTEGER) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, x AS exact, CAST(trunc(x / 100.0) AS INTEGER) AS whole, CAST(trunc(y / CAST(100 AS DOUBLE) * CAST(2.5 AS DOUBLE) * 100) AS INTEGER) AS product,
  CAST(trunc(x / CAST(100 AS DOUBLE) / (y / CAST(100 AS DOUBLE)) * 100) AS INTEGER) AS quotient, printf('%d.%02d', y // 100, y % 100) AS shown,
  CASE WHEN abs(y / 100.0 - 25) < 0.5 THEN 0 WHEN y < 2500 THEN -1 ELSE 1 END AS cmp, least(greatest(y, 1000), 4000) AS clamped, y BETWEEN 1000 AND 4000 AS within,
  x - CAST(trunc(x / CAST(100 AS DOUBLE) * CAST(0.05 AS DOUBLE) * 100) AS INTEGER) AS low, x + CAST(trunc(x / CAST(100 AS DOUBLE) * CAST(0.05 AS DOUBLE) * 100) AS INTEGER) AS high FROM q"""


def grid_boxes(spark, sf):
    """Boxes of whole cells: the union of two, its cells, and their matrix places."""
    rows = table(spark, sf, "part").select("p_partkey", *[x.cast("int").alias(n) for x, n in ((F.col("p_partkey") % 7, "x"), (F.col("p_partkey") % 5, "y"), (F.col("p_size") % 3, "r"), (F.col("p_size") % 2, "d"))])
    u = GridBox(F.col("x"), F.col("y"), F.col("r"), F.col("d")).union(GridBox(F.lit(2), F.lit(2), F.lit(0), F.lit(0)))
    cell = rows.select("p_partkey", F.explode(u.cells()).alias("c")).select("p_partkey", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    box = geometry.cell_box(F.col("cx"), F.col("cy"))
    return cell.select("p_partkey", "cx", "cy", box.left.alias("l"), box.width.alias("w"), geometry.matrix_cell(box).x.alias("back_x"))


GRID_BOXES = """SELECT p_partkey, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy, CAST(cx * 1000 + 10 AS INTEGER) AS l, 980 AS w, CAST(cx AS INTEGER) AS back_x FROM (
  SELECT p_partkey, cx, unnest(range(y1, y2 + 1)) AS cy FROM (
    SELECT p_partkey, y1, y2, unnest(range(x1, x2 + 1)) AS cx FROM (
      SELECT p_partkey, least(p_partkey % 7, 2) AS x1, greatest(p_partkey % 7 + p_size % 3, 2) AS x2, least(p_partkey % 5, 2) AS y1, greatest(p_partkey % 5 + p_size % 2, 2) AS y2 FROM part)))"""


def paths(spark, sf):
    """Orders as closed paths of their line items' points: segments by orientation."""
    point = F.struct((F.col("l_partkey") % 4).cast("int").alias("x"), (F.col("l_suppkey") % 3).cast("int").alias("y"))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", point.alias("p")))), lambda r: r["p"]).alias("points"))
    seg = rows.select("l_orderkey", F.explode(geometry.segments(F.col("points"))).alias("s"))
    return seg.groupBy("l_orderkey", geometry.orientation(F.col("s")).alias("kind")).agg(F.count("*").alias("n"))


PATHS = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 AS x, l_suppkey % 3 AS y, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
s AS (SELECT l_orderkey, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM p WHERE m > 1 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y))
SELECT l_orderkey, CASE WHEN x = x2 AND y = y2 THEN 'Empty' WHEN x = x2 THEN 'V' WHEN y = y2 THEN 'H' ELSE 'Slanted' END AS kind, count(*) AS n FROM s GROUP BY ALL"""


def fringes(spark, sf):
    return pairs(spark, sf).select(*KEY, F.posexplode(Box.of("a").fringe(10, 20, 30, 40)).alias("side", "p")).select(*KEY, "side", "p.*")


FRINGES = f"""SELECT l_orderkey, l_linenumber, side, CASE side WHEN 1 THEN al + aw - 30 WHEN 0 THEN al ELSE al + 10 END AS "left", CASE side WHEN 3 THEN "at" + ah - 40 ELSE "at" END AS top,
  CASE side WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE aw - 40 END AS width, CASE side WHEN 2 THEN 20 WHEN 3 THEN 40 ELSE ah END AS height
FROM ({PAIRS_SQL}), (SELECT CAST(unnest(range(4)) AS INTEGER) AS side)"""


def colours(spark, sf):
    k = F.col("p_partkey")
    r, g, b = ((k * m % 256).cast("int") for m in (7, 13, 29))
    hsv, cmyk = geometry.hsv_of_rgb(r, g, b), geometry.cmyk_of_rgb(r, g, b)
    return table(spark, sf, "part").select("p_partkey", geometry.hex_of_rgb(r, g, b).alias("hex"), geometry.grey_of_rgb(r, g, b).alias("grey"), F.round(hsv["v"], 6).alias("v"), F.round(hsv["s"], 6).alias("s"), F.round(cmyk["k"], 6).alias("k"), geometry.rgb_of_hex(geometry.hex_of_rgb(r, g, b))["g"].alias("g"))


COLOURS = """WITH q AS (SELECT p_partkey, CAST(p_partkey * 7 % 256 AS INTEGER) AS r, CAST(p_partkey * 13 % 256 AS INTEGER) AS g, CAST(p_partkey * 29 % 256 AS INTEGER) AS b FROM part)
SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex, CAST(round(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b) AS INTEGER) AS grey, round(greatest(r, g, b) / CAST(255 AS DOUBLE), 6) AS v,
  round(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) / CAST(255 AS DOUBLE) - least(r, g, b) / CAST(255 AS DOUBLE)) / (greatest(r, g, b) / CAST(255 AS DOUBLE)) END, 6) AS s, round(1 - greatest(r, g, b) / CAST(255 AS DOUBLE), 6) AS k, g FROM q"""

QUERIES = {"geo_boxes": boxes, "geo_splits": splits, "geo_relations": relations, "geo_burst": burst, "geo_lines": lines, "geo_exact_numbers": exact_numbers, "geo_grid_boxes": grid_boxes, "geo_paths": paths, "geo_fringes": fringes, "geo_colours": colours}
SQL = {"geo_boxes": BOXES, "geo_splits": SPLITS, "geo_relations": RELATIONS, "geo_burst": BURST, "geo_lines": LINES, "geo_exact_numbers": EXACT, "geo_grid_boxes": GRID_BOXES, "geo_paths": PATHS, "geo_fringes": FRINGES, "geo_colours": COLOURS}
