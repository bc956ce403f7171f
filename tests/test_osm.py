import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shopfront.operators import osm
from shopfront.sources.osm import ELEMENT_SCHEMA, read_elements, read_shapes


def element(kind, number, tags, lat=None, lon=None, center=None):
    return (kind, number, lat, lon, center, tags)


ELEMENTS = [
    element("node", 1, {"name": "Smile", "amenity": "dentist", "addr:housenumber": "5",
                        "addr:street": "Main", "addr:city": "Beirut", "phone": "1",
                        "contact:website": "https://s.test"}, 33.5, 35.5),
    element("node", 2, {"amenity": "dentist"}, 33.5, 35.5),
    element("way", 3, {"name": "", "name:en": "Cut", "shop": "hairdresser", "office": "x", "url": "u",
                       "addr:suburb": "Hamra", "contact:phone": "2"}, None, None, (33.6, 35.6)),
    element("relation", 4, {"name": "Zero", "amenity": "clinic", "addr:full": "Somewhere 1",
                            "website": ""}, 0.0, 35.5, (33.7, 0.0)),
    element("node", 1, {"name": "Smile", "amenity": "dentist"}, 33.5, 35.5),
    element("area", 5, {"name": "Odd", "amenity": "dentist"}, 33.5, 35.5),
    element(None, None, {"name": "Bare", "leisure": "park", "contact:email": "e"}, 10.0, 10.0),
    element("node", 6, None, 1.0, 1.0),
]


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame(ELEMENTS, ELEMENT_SCHEMA).coalesce(1)


def test_tag_and_box_specifications():
    assert osm.parse_tag(" amenity=dentist ") == ("amenity", "dentist")
    assert osm.parse_tag("shop") == osm.parse_tag("shop=") == ("shop", None)
    assert osm.parse_tag("a:b=c=d") == ("a:b", "c=d")
    for bad in ("", "a-b=c", "=x"):
        with pytest.raises(ValueError):
            osm.parse_tag(bad)
    assert osm.Box.parse("1, 2,3 ,4") == osm.Box(1.0, 2.0, 3.0, 4.0)
    for bad in ("1,2,3", "a,b,c,d"):
        with pytest.raises(ValueError):
            osm.Box.parse(bad)


def test_mapping_to_leads(elements):
    got = {r["source_id"]: r for r in osm.to_leads(elements.limit(8)).collect()}
    assert set(got) == {"node/1", "way/3", "relation/4", "area/5", "node/"}
    way, zero, bare = got["way/3"], got["relation/4"], got["node/"]
    assert (way["name"], way["website"], way["phone"], way["address"], way["category"]) == (
        "Cut", "u", "2", "Hamra", "hairdresser"
    )
    assert (way["lat"], way["lon"], way["city"]) == ("33.6", "35.6", "")
    assert (zero["lat"], zero["lon"], zero["address"], zero["website"]) == (
        "33.7", "35.5", "Somewhere 1", ""
    )
    assert (bare["email"], bare["category"], bare["source"]) == ("e", "park", "osm")
    labelled = osm.to_leads(elements, category="dental").select("category").distinct().collect()
    assert [r[0] for r in labelled] == ["dental"]


def test_selection(elements, spark):
    def ids(table):
        return sorted(r["source_id"] for r in table.collect())

    everywhere = "-90,-180,90,180"
    both = ["amenity=dentist", "shop"]
    assert ids(osm.find(elements, both, bbox=everywhere)) == ["node/1", "way/3"]
    assert ids(osm.find(elements, ["shop="], bbox="33.55,35.55,34,36")) == ["way/3"]
    assert ids(osm.find(elements, both, bbox="33.55,35.55,33.59,36")) == []
    sited = osm.find(elements.where("id <> 1"), ["amenity", "shop"], bbox=everywhere, website_only=True)
    assert ids(sited) == ["way/3"]
    places = spark.createDataFrame(
        [("Beirut", 33.0, 35.0, 34.0, 36.0, 2), ("Beirut", 33.4, 35.4, 33.55, 35.55, 1)],
        "area string, south double, west double, north double, east double, rank int",
    )
    assert ids(osm.find(elements, both, area="Beirut", places=places)) == ["node/1"]
    with pytest.raises(ValueError):
        osm.find(elements, both, area="Nowhere", places=places)
    for wrong in ({}, {"area": "Beirut", "bbox": everywhere}):
        with pytest.raises(ValueError):
            osm.find(elements, both, places=places, **wrong)
    asked = spark.createDataFrame([("Beirut",), ("Nowhere",)], "area string")
    assert [r["area"] for r in osm.unknown_areas(asked, places).collect()] == ["Nowhere"]


def test_elements_in_areas_agrees_with_a_plain_range_join(spark):
    points = spark.range(2000).selectExpr(
        "'node' AS type", "id", "(id * 37 % 1800) / 10D - 90 AS lat", "(id * 91 % 3600) / 10D - 180 AS lon",
        "cast(NULL AS struct<lat:double,lon:double>) AS center", "map('name', string(id)) AS tags",
    )
    boxes = spark.range(12).selectExpr(
        "concat('a', id) AS area", "id * 7 - 60D AS south", "id * 20 - 150D AS west",
        "id * 7 - 60D + id * 3.3D AS north", "id * 20 - 150D + id * 9.1D AS east",
    )
    got = osm.elements_in_areas(points, boxes).select("area", "id").collect()
    placed = osm.with_coordinates(points)
    expected = placed.join(
        boxes, (placed.lat.between(boxes.south, boxes.north)) & placed.lon.between(boxes.west, boxes.east)
    ).select("area", "id").collect()
    assert sorted(got) == sorted(expected) and len(got) > 20


def test_element_documents(spark, tmp_path):
    path = tmp_path / "answer.json"
    path.write_text('{"version": 0.6, "elements": [{"type": "way", "id": 9, "center": {"lat": 1.5, "lon": 2},'
                    ' "tags": {"name": "N"}},\n {"type": "node", "id": 8, "lat": 3, "lon": 4}]}')
    empty = tmp_path / "empty.json"
    empty.write_text('{"version": 0.6}')
    rows = read_elements(spark, str(path)).orderBy("id").collect()
    assert [(r["type"], r["id"], r["lat"]) for r in rows] == [("node", 8, 3.0), ("way", 9, None)]
    assert rows[1]["center"]["lon"] == 2.0 and rows[1]["tags"] == {"name": "N"}
    assert read_elements(spark, str(empty)).count() == 0


def test_zero_is_a_place(spark):
    points = spark.sql("""
        SELECT 'node' AS type, id, lat, lon, named_struct('lat', cast(NULL AS double), 'lon', cast(NULL AS double))
          AS center, map('shop', 'x', 'name', 'n' || id) AS tags
        FROM VALUES (1L, 0D, 10D), (2L, 5D, 0D), (3L, 5D, 10D), (4L, 0.0005D, -0.00012D) AS t(id, lat, lon)""")
    box = osm.Box(-1, -1, 20, 20)
    chosen = osm.select_elements(points, ["shop"], box)
    assert {r["id"] for r in chosen.collect()} == {1, 2, 3, 4}
    leads = {r["source_id"]: (r["lat"], r["lon"]) for r in osm.to_leads(chosen).collect()}
    assert leads["node/1"] == ("", "10.0") and leads["node/2"] == ("5.0", "")
    assert leads["node/4"] == ("0.0005", "-0.00012")
    areas = spark.createDataFrame([("wide", -1.0, -1.0, 20.0, 20.0), ("line", 0.0, 9.0, 0.0, 11.0), ("dot", 5.0, 10.0, 5.0, 10.0)],
                                  "area string, south double, west double, north double, east double")
    inside = {(r["area"], r["id"]) for r in osm.elements_in_areas(points, areas).collect()}
    assert inside == {("wide", i) for i in (1, 2, 3, 4)} | {("line", 1), ("dot", 3)}


def test_no_tags_find_nothing(spark):
    points = spark.sql("SELECT 'node' AS type, 1L AS id, 1D AS lat, 1D AS lon, named_struct('lat', 1D, 'lon', 1D) AS center, map('a', 'b') AS tags")
    assert osm.select_elements(points, []).count() == 0


# --- shapes ------------------------------------------------------------------------------
SHAPES = ("type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>, nodes array<bigint>,"
          " geometry array<struct<lat:double,lon:double>>, members array<struct<type:string,ref:bigint,lat:double,lon:double,geometry:array<struct<lat:double,lon:double>>>>")


def thing(kind, number, at=None, center=None, nodes=None, geometry=None, members=None):
    lat, lon = at or (None, None)
    return (kind, number, lat, lon, center, {"shop": "x", "name": f"{kind} {number}"}, nodes, geometry,
            [(t, r, *(p or (None, None)), g) for t, r, p, g in members] if members is not None else None)


def touches(line, box):
    """Clips the line, the short way round, against the box: exact fractions."""
    (lat1, lon1), (lat2, lon2) = line
    if abs(lon2 - lon1) > 180:
        lon2 -= 360 if lon2 > lon1 else -360
    south, west, north, east = map(Fraction, box)
    for turn in (-360, 0, 360):
        for w, e in [(west, east)] if west <= east else [(west, Fraction(180)), (Fraction(-180), east)]:
            low, high = Fraction(0), Fraction(1)
            for a, b, least, most in ((Fraction(lat1), Fraction(lat2), south, north), (Fraction(lon1) + turn, Fraction(lon2) + turn, w, e)):
                if a == b:
                    if not least <= a <= most:
                        low = Fraction(2)
                else:
                    t = sorted(((least - a) / (b - a), (most - a) / (b - a)))
                    low, high = max(low, t[0]), min(high, t[1])
            if low <= high:
                return True
    return False


def brute_lines(rows):
    """(type, id) to the lines that each element consists of."""
    at = {r[1]: (r[2], r[3]) for r in rows if r[0] == "node" and r[2] is not None}

    def joined(points):
        return [(points[n], points[min(n + 1, len(points) - 1)]) for n in range(max(1, len(points) - 1))] if points else []

    def numbered(nodes):
        pairs = joined(nodes or [])
        return [(at.get(a) or at[b], at.get(b) or at[a]) for a, b in pairs if a in at or b in at]

    way = {r[1]: joined(r[7]) or numbered(r[6]) for r in rows if r[0] == "way"}
    out = {}
    for kind, number, lat, lon, center, _, _, _, members in rows:
        if kind == "node":
            lines = [((lat, lon), (lat, lon))] if lat is not None else []
        elif kind == "way":
            lines = way[number]
        else:
            lines = []
            for t, r, mlat, mlon, geometry in members or []:
                if t == "node":
                    place = (mlat, mlon) if mlat is not None else at.get(r)
                    lines += [(place, place)] if place else []
                elif t == "way":
                    lines += joined(geometry) or way.get(r, [])
        out[kind, number] = lines or ([(center, center)] if center else [])
    return out


@pytest.fixture(scope="module")
def world():
    rng = random.Random(6)
    place = lambda: (rng.randrange(-320, 320) / 4, rng.choice([rng.randrange(-720, 721) / 4, rng.choice([-1, 1]) * rng.randrange(700, 721) / 4]))
    rows = [thing("node", i, place() if i % 11 else None) for i in range(150)]
    for i in range(120):
        nodes = [rng.randrange(160) for _ in range(rng.randrange(6))]
        geometry = [place() for _ in range(rng.randrange(1, 4))] if i % 5 == 0 else [] if i % 5 == 1 else None
        rows.append(thing("way", i, center=place() if i % 3 else None, nodes=nodes if i % 4 else None, geometry=geometry))
    for i in range(50):
        members = [(rng.choice(["node", "way", "relation"]), rng.randrange(130), place() if rng.random() < 0.2 else None,
                    [place(), place()] if rng.random() < 0.2 else None) for _ in range(rng.randrange(5))]
        rows.append(thing("relation", i, center=place() if i % 2 else None, members=members if i % 7 else None))
    return rows


BOXES = [(-20.0, 170.0, 10.0, -170.0), (-80.0, -180.0, 80.0, 180.0), (10.0, 10.0, 30.0, 25.25), (0.0, 0.0, 0.0, 0.0), (40.0, 100.0, 41.0, 179.75),
         (-5.0, 150.0, 5.0, -175.0), (30.0, 20.0, 10.0, 40.0), (-1.0, -60.0, 0.5, -59.5), (50.0, -179.75, 70.0, -179.0)]


def test_shapes_lie_where_their_lines_are(spark, world):
    lines = brute_lines(world)
    table = spark.createDataFrame(world, SHAPES)
    areas = spark.createDataFrame([(f"a{n}", *b) for n, b in enumerate(BOXES)], "area string, south double, west double, north double, east double")
    expected = {(f"a{n}", *key) for n, box in enumerate(BOXES) if box[0] <= box[2] for key, own in lines.items() if any(touches(x, box) for x in own)}
    got = [(r["area"], r["type"], r["id"]) for r in osm.elements_in_areas(table, areas).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert {len({e for e in expected if e[0] == f"a{n}"}) > 0 for n in (0, 2, 5)} == {True}
    for n in (0, 2):
        box = ",".join(map(str, BOXES[n]))
        found = {r["source_id"] for r in osm.find(table, ["shop"], bbox=box).collect()}
        assert found == {f"{t}/{i}" for a, t, i in expected if a == f"a{n}"}


def test_a_way_crosses_a_box_that_its_center_is_not_in(spark):
    rows = [thing("node", 1, (0.0, 0.0)), thing("node", 2, (10.0, 10.0)), thing("way", 5, center=(5.0, 5.0), nodes=[1, 2])]
    table = spark.createDataFrame(rows, SHAPES)
    assert [r["id"] for r in osm.select_elements(table, ["shop"], osm.Box(1, 1, 2, 2)).collect()] == [5]
    assert osm.select_elements(table, ["shop"], osm.Box(1, 3, 2, 4)).count() == 0
    assert osm.select_elements(table.drop("nodes", "geometry", "members"), ["shop"], osm.Box(1, 1, 2, 2)).count() == 0


def test_boxes_over_the_date_line(spark):
    rows = [thing("node", 1, (-17.7, 178.0)), thing("node", 2, (-16.9, -179.9)), thing("node", 3, (-17.0, 0.0)), thing("way", 4, center=(-17.0, 180.0))]
    plain = spark.createDataFrame(rows, SHAPES).drop("nodes", "geometry", "members")
    fiji = osm.Box.parse("-21,176,-12,-178")
    assert {r["id"] for r in osm.select_elements(plain, ["shop"], fiji).collect()} == {1, 2, 4}
    places = spark.createDataFrame([("Fiji", -21.0, 176.0, -12.0, -178.0, 1)], "area string, south double, west double, north double, east double, rank int")
    assert {r["id"] for r in osm.elements_in_areas(plain, osm.first_places(places)).collect()} == {1, 2, 4}
    assert osm.find(plain, ["shop"], area="Fiji", places=places).count() == 3


def test_shapes_are_read_from_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"elements": [{"type": "way", "id": 1, "nodes": [3, 4], "geometry": [{"lat": 1, "lon": 2}, null]},'
                                     ' {"type": "relation", "id": 2, "members": [{"type": "way", "ref": 1, "role": "outer"}, {"type": "node", "ref": 3, "lat": 5, "lon": 6}]}]}')
    found = {r["type"]: r for r in read_shapes(spark, str(tmp_path / "a.json")).collect()}
    assert found["way"]["nodes"] == [3, 4] and found["way"]["geometry"][0]["lon"] == 2.0
    inside = osm.select_elements(read_shapes(spark, str(tmp_path / "a.json")).withColumn("tags", F.expr("map('shop', 'x')")), ["shop"], osm.Box(0, 1, 3, 3))
    assert {(r["type"], r["id"]) for r in inside.collect()} == {("way", 1), ("relation", 2)}
