"""The nearest rain cell by growing radii is that of a look at all cells, far ones and ties too."""

import math

from siteline.plans import q_nearby


def test_near_far_tied_and_missing(spark):
    cells = [(r, c, -30.0 + r * 0.01, 140.0 + c * 0.01) for r in range(12) for c in range(12)] + [(90, 90, -31.2, 141.4), (91, 91, -30.055, 145.0)]
    places = [(i, -30.0 + i * 0.037 % 0.3, 140.0 + i * 0.051 % 0.4) for i in range(40)] + [(40, -31.9, 140.1), (41, -29.995, 140.005), (42, -20.0, 120.0), (43, -30.055, 147.5)]
    grid = spark.createDataFrame([(float(r), 2.0 * c, y, x, r, c) for r, c, y, x in cells], "p95 double, p99 double, g_lat double, g_lng double, r int, c int")
    got = {x.property_id: (x.p95, x.p99, round(x.dist_deg, 9)) for x in q_nearby.nearest_rain(spark.createDataFrame(places, "property_id long, lat double, lng double"), grid).collect()}
    want = {}
    for i, lat, lng in places:
        d, r, c = min((math.sqrt(abs(y - lat) ** 2 + abs(x - lng) ** 2), r, c) for r, c, y, x in cells)
        if d <= 2:
            want[i] = (float(r), 2.0 * c, round(d, 9))
    assert got == want and {42, 43}.isdisjoint(got) and 40 in got
