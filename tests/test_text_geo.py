from pyspark.sql import functions as F

from kerbside.functions import geo, text


def each(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_normalise_street(spark):
    assert each(spark, text.normalise_street, "YERRIN ST.", "Brenbeal St, VIC 3103", "High Street South", "Victoria Road", "St Kilda Road", "") == ["yerrin street", "brenbeal street", "high street south", "road", "street kilda road", ""]


def test_parse_query(spark):
    got = each(spark, text.parse_query, "Unit 5, 14 Brenbeal St", "31-37 Harp Road", "5/14 Brenbeal St", "Mary Street, Melbourne", "Unit 5/14 X Street")
    assert [tuple(r) for r in got] == [("5", "14", "Brenbeal St"), (None, "31-37", "Harp Road"), ("5", "14", "Brenbeal St"), (None, None, "Mary Street"), ("5", None, "/14 X Street")]


def test_number_keys(spark):
    assert each(spark, text.number_keys, "31-37", "2-5", "247B", "14", "200-999", "9-3") == [["3137", "31", "33", "35", "37"], ["25", "2", "3", "4", "5"], ["247b"], ["14"], ["200999", "200"], ["93", "9"]]


def test_variants_parity_order(spark):
    assert each(spark, text.suffix_variants, "Yerrin Street Balwyn North", "3101") == [["yerrin street balwyn north", "yerrin street balwyn", "yerrin street", "yerrin"], []]
    assert each(spark, text.parity, "12", "13A", "Rear") == ["even", "odd", "even"]
    rows = spark.createDataFrame([(n,) for n in ("10", "2A", "9", "2", "100", "2B", "Rear")], "n string")
    assert [r.n for r in rows.orderBy(text.natural_key(F.col("n"))).collect()] == ["Rear", "2", "2A", "2B", "9", "10", "100"]


def test_labels(spark):
    r = spark.range(1).select(
        text.blockface_label(F.lit("Quiet Street"), F.lit("both"), F.lit("1"), F.lit("4"), F.lit(4), F.lit(8.5)),
        text.blockface_label(F.lit("Busy Road"), F.lit("even"), F.lit("2"), F.lit("30-38"), F.lit(1), F.lit(2.4)),
        text.zone_label(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.lit(9)),
        text.address_label(F.lit("2"), F.lit("14"), F.lit("X Street")),
        text.stop_label(F.lit("14"), F.lit("X Street"), F.lit(3)),
        text.thousands(F.lit(24366)),
        text.span_base(F.lit("row@1,2#odd/2")),
    ).first()
    assert list(r) == ["Quiet Street #1-#4 - 4 doors - 8 min", "Busy Road (even) #2 to #30-38 - 1 door - 2 min", "A, B +1 more - 9 doors", "2/14 X Street", "14 X Street (3 doors)", "24,366", "row@1,2"]


def test_distances(spark):
    d = F.lit
    r = spark.range(1).select(geo.haversine(d(-37.8136), d(144.9631), d(-33.8688), d(151.2093)), geo.haversine(d(-37.8), d(145.0), d(-37.8009), d(145.0)), geo.project(d(-37.8), d(145.0005), d(-37.8001), d(145.0), d(-37.8001), d(145.001))["offset_m"], geo.dwell_seconds(d(1)), geo.dwell_seconds(d(95)), geo.dwell_seconds(d(95), None), F.size(geo.circle(d(-37.8), d(145.0), d(100.0)))).first()
    assert abs(r[0] - 713_000) < 15_000 and abs(r[1] - 100) < 2 and abs(r[2] - 11.132) < 0.01
    assert list(r[3:]) == [105.0, 630.0, 7155.0, 97]


def test_rings(spark):
    def ring(*points):
        return F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in points])

    square, hole = ring((0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)), ring((1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0))
    points = spark.createDataFrame([(0, 3.0, 3.0), (1, 1.5, 1.5), (2, 5.0, 1.0)], "i int, lat double, lon double")
    got = points.orderBy("i").select(geo.rings_contain(F.col("lat"), F.col("lon"), F.array(square, hole)), geo.ring_contains(F.col("lat"), F.col("lon"), ring((0.0, 0.0), (1.0, 1.0)))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, False)]
    assert spark.range(1).select(geo.ring_is_closed(square), geo.ring_is_closed(hole)).first() == (True, False)
