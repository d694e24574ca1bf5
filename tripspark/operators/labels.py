"""Labels of places from provider answers, known places and the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.functions.scalars import coord_key, geodesic_m, round1
from tripspark.operators.listing import is_fresh
from tripspark.operators.spatial import point_in_area

# Fixed values.
POI_CATEGORIES = ("aeroway", "amenity", "club", "craft", "healthcare", "historic", "leisure", "office", "shop", "sport", "tourism")
NO_POI_TYPES = ("bench", "bicycle_parking", "drinking_water", "fire_hydrant", "give_way", "guidepost", "information", "post_box", "recycling", "street_lamp",
                "telephone", "traffic_signals", "vending_machine", "waste_basket", "waste_disposal")
ROADS = ("road", "pedestrian", "footway", "path", "cycleway")
LOCALITIES = ("neighbourhood", "suburb", "hamlet", "village", "town", "city", "municipality", "county")
CITIES = ("city", "town", "village", "municipality", "hamlet", "county")
ADDRESS_M, POI_M, ENTRANCE_M = 25.0, 30.0, 20.0
RANKS = {"known-place": 7, "poi": 6, "building": 5, "address-point": 5, "area": 4, "road": 2, "locality": 1}

ANSWER = "osm_type string, osm_id string, category string, class string, type string, addresstype string, name string, display_name string, lat string, lon string, address map<string,string>, entrances array<struct<lat:double,lon:double>>"


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _first(address: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(_text(address[k]) for k in keys))


def lowered(confidence: Column, accuracy: Column) -> Column:
    """Confidence lowered by one step beyond 15 m of accuracy, to low beyond 30 m."""
    return F.when(~(F.coalesce(accuracy, F.lit(0.0)) > 15), confidence).when(accuracy > 30, "low").when(confidence == "high", "medium").otherwise("low")


def label_match(answers: DataFrame, cities_only: bool = False) -> DataFrame:
    """Adds label, feature_type, confidence, distance_m, osm_id from a provider's answer (``json``) for a point (lat, lng, accuracy_m).

    A trusted name first, then house and road, road, locality, the head of the display
    name. An area is trusted if its outline or an entrance covers the point, a point
    feature by distance. ``cities_only`` takes localities only.
    """
    a = answers.withColumn("_a", F.from_json("json", ANSWER))
    low = lambda *c: F.lower(F.coalesce(*(_text(F.col(f"_a.{x}")) for x in c), F.lit("")))
    category, kind, atype = low("category", "class"), low("type"), low("addresstype")
    area = low("osm_type").isin("way", "relation")
    address = category.isin("place", "building") | atype.isin("house", "building") | (kind == "house")
    poi = category.isin(*POI_CATEGORIES) & ~kind.isin(*NO_POI_TYPES)
    rlat, rlng = F.col("_a.lat").try_cast("double"), F.col("_a.lon").try_cast("double")
    distance = F.coalesce(geodesic_m(F.col("lat"), F.col("lng"), rlat, rlng), F.lit(float("inf")))
    accuracy = F.coalesce("accuracy_m", F.lit(0.0))
    entrance = F.exists("_a.entrances", lambda e: geodesic_m(F.col("lat"), F.col("lng"), e["lat"], e["lon"]) <= ENTRANCE_M + F.least(F.greatest(accuracy, F.lit(0.0)), F.lit(10.0)))
    a = a.withColumns({"_area": area, "_addr": address, "_poi": poi, "_cat": category, "_d": distance, "_ent": F.coalesce(entrance, F.lit(False))})
    # outlines are parsed only where there are any
    a = a.withColumn("_in", F.coalesce(point_in_area(F.get_json_object("json", "$.geojson"), F.col("lat"), F.col("lng")), F.lit(False)))
    trusted = lambda m: F.when(F.col("_area"), F.col("_in") | F.col("_ent")).otherwise(F.col("_d") <= m)
    adr = F.col("_a.address")
    name, road, house = _text(F.trim(F.col("_a.name"))), _first(adr, ROADS), _text(adr["house_number"])
    parts = F.transform(F.split("_a.display_name", ","), lambda p: F.trim(p))
    at_house, at_road = F.array_position(parts, house), F.array_position(F.transform(parts, lambda p: F.lower(p)), F.lower(road))
    road_first = F.coalesce((at_road > 0) & (at_house > 0) & (at_road < at_house), F.lit(False))
    by_name = name.isNotNull() & (F.col("_addr") | F.col("_poi")) & F.when(F.col("_addr"), trusted(ADDRESS_M)).otherwise(trusted(POI_M))
    by_house = road.isNotNull() & house.isNotNull() & trusted(ADDRESS_M)
    place = _first(adr, CITIES if cities_only else LOCALITIES)
    head = _text(F.trim(F.split("_a.display_name", ",")[0]))
    local = F.coalesce(place, head)
    label, feature = local, F.when(local.isNotNull(), "locality")
    sure = F.when(local.isNotNull(), "low")
    if not cities_only:
        of_area = F.when(F.col("_cat") == "building", "building").otherwise("area")
        label = F.when(by_name, name).when(by_house, F.when(road_first, F.concat_ws(" ", road, house)).otherwise(F.concat_ws(" ", house, road))).when(road.isNotNull(), road).otherwise(local)
        feature = F.when(by_name, F.when(F.col("_area"), of_area).when(F.col("_addr"), "address-point").otherwise("poi")).when(by_house, F.when(F.col("_area"), "building").otherwise("address-point")).when(road.isNotNull(), "road").otherwise(feature)
        sure = F.when(by_name | by_house, "high").when(road.isNotNull(), "medium").otherwise(sure)
    osm = F.when(_text(F.col("_a.osm_type")).isNotNull() & F.col("_a.osm_id").isNotNull(), F.concat_ws("/", "_a.osm_type", "_a.osm_id"))
    out = a.withColumns({"label": label, "feature_type": feature, "_c": sure, "osm_id": osm})
    dist = F.when(F.col("_d") < float("inf"), round1(F.col("_d")))
    return out.withColumns({"confidence": lowered(F.col("_c"), F.col("accuracy_m")), "distance_m": dist}).drop("_a", "_area", "_addr", "_poi", "_cat", "_d", "_ent", "_in", "_c")


def best_match(matches: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of several matches per key the best: confidence, then the kind of feature, then the nearest, then the first (``rank``)."""
    sure = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    kind = F.lit(0)
    for name, r in RANKS.items():
        kind = F.when(F.col("feature_type") == name, r).otherwise(kind)
    order = F.struct(-sure, -kind, F.coalesce("distance_m", F.lit(float("inf"))), F.col("rank"))
    # no filter on the label before the aggregate: pushed down it would work the label out twice
    best = matches.groupBy(*key).agg(F.min_by(F.struct("label", "feature_type", "confidence", "distance_m"), F.when(F.col("label").isNotNull(), order)).alias("b"))
    return best.where("b.label IS NOT NULL").select(*key, "b.label", "b.feature_type", "b.confidence", "b.distance_m")


def label_endpoints(endpoints: DataFrame, places: DataFrame, cache: DataFrame, provider: DataFrame, provider_name: str, now_ms: int, key: tuple[str, ...]) -> DataFrame:
    """Adds label and label_source: the known place (places: key columns, label), else a fresh cache row by 5-decimal coordinates, else the provider's best match."""
    fresh = cache.where((F.col("provider") == provider_name) & is_fresh(F.col("label"), F.col("confidence"), F.lit(now_ms) - F.col("resolved_at")))
    out = endpoints.withColumn("coord_key", coord_key(F.col("lat"), F.col("lng")))
    out = out.join(places.select(*key, F.col("label").alias("_p")), list(key), "left")
    out = out.join(fresh.select("coord_key", F.col("label").alias("_c")).dropDuplicates(["coord_key"]), "coord_key", "left")
    out = out.join(provider.select("coord_key", F.col("label").alias("_g")).dropDuplicates(["coord_key"]), "coord_key", "left")
    src = F.when(F.col("_p").isNotNull(), "place").when(F.col("_c").isNotNull(), "cache").when(F.col("_g").isNotNull(), "provider")
    return out.withColumns({"label": F.coalesce("_p", "_c", "_g"), "label_source": src}).drop("_p", "_c", "_g")
