import random

from tripspark.operators.regions import link_cells
from tripspark.operators.spatial import normalize_stations


def brute(cells):
    left, out = set(cells), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            r, c = todo.pop()
            group.append((r, c))
            for n in [(r + i, c + k) for i in (-1, 0, 1) for k in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.update({x: min(group) for x in group})
    return out


def test_regions_of_long_chains_and_crowds(spark):
    rnd = random.Random(4)
    cells = {(0, k) for k in range(130)} | {(10 + (k if k < 70 else 140 - k), 300 - k) for k in range(140)} | {(200 + rnd.randint(0, 24), rnd.randint(0, 24)) for _ in range(200)}
    rows = spark.createDataFrame([(r + 0.5, c + 0.5) for r, c in cells], "lat double, lng double")
    want = brute(cells)
    got = link_cells(rows, 1.0).collect()
    assert len(got) == len(cells)
    for r in got:
        least = want[(int(r.lat - 0.5), int(r.lng - 0.5))]
        assert r.region == ":".join(f"{x + 1_000_000:08}" for x in least)


def test_stations_merge_far_along_a_chain_of_cells(spark):
    # two features a few metres apart on both sides of each cell border, in each of 119 linked cells
    rows = [(2 * k + side, "node", 2 * k + side, 10.005, 20.0 + 0.01 * k + d, {"amenity": "charging_station", "brand": "Tesla Supercharger"}) for k in range(1, 120) for side, d in ((0, -1e-5), (1, 1e-5))]
    elements = spark.createDataFrame([(*r[:5], None, r[5]) for r in rows], "pos bigint, type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>")
    got = normalize_stations(elements).collect()
    assert len(got) == 119 and all(len(r.osm_features) == 2 for r in got)
