"""Repairing timetables: positions from neighbours on the line, regions along the line, urban naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timetide.functions import text as T
from timetide.functions.geo import boundary_distances, polygon_distances, unproject
from timetide.functions.lineage import cut, shuffled
from timetide.operators.matching import exact_matches, match_by_top_town, match_stops_by_name, primary_matches, top_stop_match

STOP_TOLERANCE, TOWN_TOLERANCE = 1000, 10_000
PRECISE, LOOSE = 4000, 20_000


def missing_region_report(stops: DataFrame, trip_stops: DataFrame, keys: list[str]) -> DataFrame:
    """Stops without a country, or in CZ without a region; level 'warning' where a trip has a real time there, else 'debug'."""
    lacking = stops.where("country is null or (country = 'CZ' and region is null)")
    used = trip_stops.where("dep_kind = 'time' or arr_sec is not null").select(*keys, F.lit("warning").alias("level")).distinct()
    return lacking.join(used, keys, "left").withColumn("level", F.coalesce("level", F.lit("debug"))).select(*keys, "level")


def urban_naming_batches(stops: DataFrame) -> DataFrame:
    """Batches in which no stop has a district or a place."""
    return stops.groupBy("batch_id").agg(F.bool_and(F.col("district").isNull() & F.col("place").isNull()).alias("_u")).where("_u").select("batch_id")


def trip_patterns(trip_stops: DataFrame, keys: list[str], trip: str) -> DataFrame:
    """keys, pattern (smallest trip), pos, stop_id, metres: one trip for each distinct profile of distances."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "metres", "stop_id")))
    profiles = trip_stops.groupBy(*keys, trip).agg(rows.alias("rows"))
    kept = profiles.groupBy(*keys, F.transform("rows", lambda r: F.struct(r["pos"], r["metres"])).alias("_p")).agg(F.min(F.struct(trip, "rows")).alias("m"))
    return kept.select(*keys, F.col(f"m.{trip}").alias("pattern"), F.inline("m.rows")).where("metres is not null")


def last_known_position(pattern_stops: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """pattern_stops (x, y, metres, null where not matched) with `last`: position and metres of the last earlier stop that was matched."""
    seen = F.when(F.col("x").isNotNull() & F.col("metres").isNotNull(), F.struct("x", "y", "metres"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pattern_stops.withColumn("last", F.last(seen, ignorenulls=True).over(w))


def secondary_matches(pattern_stops: DataFrame, candidates: DataFrame, keys: list[str], tolerance: int = STOP_TOLERANCE) -> DataFrame:
    """Positions for unmatched stops: stop_id, cx, cy, precision, t_region, t_country.

    For each pattern, candidates within the distance along the line plus the tolerance of the last known
    position are taken as in top_stop_match; a stop gets its place where all patterns that give one agree.
    Positions found here are not used for further stops."""
    open_stops = last_known_position(pattern_stops, [*keys, "pattern"]).where("x is null and last is not null and metres is not null")
    near = open_stops.select(*keys, "pattern", "stop_id", "last", F.col("metres").alias("at")).join(shuffled(candidates), [*keys, "stop_id"])
    way = F.abs(F.col("at") - F.col("last.metres")) + tolerance
    near = near.where(F.hypot(F.col("x") - F.col("last.x"), F.col("y") - F.col("last.y")) <= way)
    tops = top_stop_match(near, [*keys, "pattern", "stop_id"])
    agreed = tops.groupBy(*keys, "stop_id").agg(F.count_distinct(F.round("cx", 3), F.round("cy", 3)).alias("_n"), F.min("cx").alias("cx"), F.min("cy").alias("cy"), F.max("precision").alias("precision"), F.max("t_region").alias("t_region"), F.max("t_country").alias("t_country"))
    return agreed.where("_n = 1").drop("_n")


def fill_regions(line: DataFrame, keys: list[str], order: str = "pos", backwards: bool = False) -> DataFrame:
    """line with region and country filled from the stops before (or after, backwards).

    The country goes on until another is given; the region too, but ends where a country comes without one."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc() if backwards else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    country = F.last("country", ignorenulls=True).over(w)
    rows = line.withColumn("_country", country)
    turn = F.lag("_country").over(Window.partitionBy(*keys).orderBy(F.col(order).desc() if backwards else F.col(order)))
    changed = F.col("country").isNotNull() & F.col("region").isNull() & ~F.col("country").eqNullSafe(turn)
    event = F.when(F.col("region").isNotNull() | changed, F.struct(F.col("region").alias("r")))
    rows = rows.withColumn("_changed", event)
    filled = F.last("_changed", ignorenulls=True).over(w)["r"]
    return rows.withColumn("_region", filled).withColumn("region", F.coalesce("region", "_region")).withColumn("country", F.coalesce("country", "_country")).drop("_country", "_changed", "_region")


def richest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row with most of region and country, then the smallest."""
    rich = F.col("region").isNotNull().cast("int") + F.col("country").isNotNull().cast("int")
    w = Window.partitionBy(*keys).orderBy(rich.desc(), "country", "region")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def revert_far_regions(filled: DataFrame, distances: DataFrame, keys: list[str]) -> DataFrame:
    """filled (keys, region, old_region) with new regions taken back where in every pattern the way from the known stop is longer than the way to the region's edge.

    distances: keys, way (along the line since the known stop), edge (from there to the region's edge)."""
    every = distances.groupBy(*keys).agg(F.bool_and(F.col("way") > F.col("edge")).alias("_far"))
    fresh = F.col("old_region").isNull() & F.col("region").isNotNull()
    return filled.join(every, keys, "left").withColumn("region", F.when(fresh & F.coalesce("_far", F.lit(False)), F.col("old_region")).otherwise(F.col("region"))).drop("_far")


def distance_warnings(run_stops: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Stops farther from the last stop with a position and metres than twice what the line and the tolerance allow."""
    rows = last_known_position(run_stops, keys, order).where("x is not null and metres is not null and last is not null")
    gap = F.hypot(F.col("x") - F.col("last.x"), F.col("y") - F.col("last.y"))
    slack = F.when(F.col("precision") == "S", PRECISE).otherwise(LOOSE)
    allowed = (F.abs(F.col("metres") - F.col("last.metres")) + slack) * 2
    return rows.where(gap > allowed).select(*keys, order, "stop_id", gap.alias("distance"), allowed.alias("allowed"))


def town_candidates(votes: DataFrame, route_towns: DataFrame) -> DataFrame:
    """batch_id, town, votes, rank: towns with votes of over one stop (stop_id) of a batch; the route name's town counts two more."""
    counted = votes.select("batch_id", "stop_id", "town").distinct().groupBy("batch_id", "town").agg(F.count("*").alias("votes")).where("votes > 1")
    named = route_towns.select("batch_id", "town", F.lit(2).alias("_more")).distinct()
    scored = counted.join(named, ["batch_id", "town"], "left").withColumn("votes", F.col("votes") + F.coalesce("_more", F.lit(0))).drop("_more")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.col("votes").desc(), "town")))


def urban_names(stops: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stops of urban batches named as 'town, district, place' for each candidate town: the name's first part becomes the district, the rest the place."""
    parts = F.split("town", ", *", 2)
    towns = candidates.select("batch_id", F.col("town").alias("_town"), "rank")
    return stops.withColumn("_p", parts).join(towns, "batch_id").select("batch_id", "stop_id", F.col("_town").alias("town"), F.get("_p", F.lit(0)).alias("district"), F.get("_p", F.lit(1)).alias("place"), "region", "country", "rank")


def choose_naming(plain: DataFrame, urban: DataFrame) -> DataFrame:
    """batch_id, urban: whether urban naming matches more than one stop over the plain one (tables of matched stops)."""
    n = lambda t, c: t.select("batch_id", "stop_id").distinct().groupBy("batch_id").agg(F.count("*").alias(c))
    both = n(plain, "_p").join(n(urban, "_u"), "batch_id", "full").fillna(0, ["_p", "_u"])
    return both.select("batch_id", (F.col("_u") > F.col("_p") + 1).alias("urban"))


STOP = ["batch_id", "stop_id"]
#: Towns that share one urban network, in which stops carry either name; the first stands for all. Fixed values.
JOINED_TOWNS = (("Ústí nad Labem", "Ústí n.L.", "Trmice", "Telnice", "Petrovice,Krásný Les"),)


def joined_towns(spark, groups=JOINED_TOWNS) -> DataFrame:
    """head, town, place of each town of a group; place counts from 0."""
    return spark.createDataFrame([(g[0], t, i) for g in groups for i, t in enumerate(g)], "head string, town string, place int")


def same_words(a, b):
    return T.name_tokens(a) == T.name_tokens(b)


def urban_votes(stops: DataFrame, matches: DataFrame, towns: DataFrame, joined: DataFrame) -> DataFrame:
    """batch_id, stop_id, town: towns that would make the name of a stop, given in its town alone, that of a target.

    A stop that has an exact match and begins with a domestic town does not vote."""
    bare = stops.where("district is null and place is null").select(*STOP, F.col("town").alias("own"))
    settled = bare.join(exact_matches(matches).select(*STOP).distinct(), STOP).withColumn("name", F.trim(F.substring_index("own", ",", 1))).join(towns.select("name").distinct(), "name").select(*STOP)
    met = bare.join(settled, STOP, "left_anti").join(matches.select(*STOP, "target"), STOP).withColumn("town", F.trim(F.substring_index("target", ",", 1)))
    fits = same_words(F.concat_ws(",", "town", "own"), F.col("target")) & ~same_words(F.col("own"), F.col("target"))
    named = met.where(fits).select(*STOP, "town").distinct()
    return named.join(joined.select("town", "head"), "town", "left").select(*STOP, F.coalesce("head", "town").alias("town")).distinct()


def urban_naming(stops: DataFrame, chosen: DataFrame, targets: DataFrame, towns: DataFrame, joined: DataFrame, synonyms: DataFrame) -> DataFrame:
    """stops of the batches of chosen (batch_id, town) under urban names.

    A stop named by its town alone becomes 'town, first part, rest' with the first town of the joined ones
    under which it has a match; else, where its first part is a domestic town, that is its town; else the
    first town is taken."""
    own = stops.join(chosen.select("batch_id").distinct(), "batch_id", "left_semi")
    bare = own.where("district is null and place is null")
    groups = chosen.join(joined.select(F.col("head").alias("town"), F.col("town").alias("member"), "place"), "town", "left")
    options = groups.select("batch_id", F.coalesce("member", "town").alias("town"), (F.coalesce("place", F.lit(0)) + 1).alias("rank"))
    tried = cut(urban_names(bare, options))
    keys = [*STOP, "rank"]
    matched = match_stops_by_name(tried.withColumn("name", T.matching_name(F.col("town"), F.col("district"), F.col("place"))), targets, synonyms)
    fit = top_stop_match(exact_matches(matched), keys).select(*keys, F.lit(True).alias("fit"))
    parts = F.split("own", ",")
    first = F.trim(F.get(parts, F.lit(0)))
    known = bare.select(*STOP, F.col("town").alias("own")).withColumn("first", first).join(towns.select(F.col("name").alias("first"), F.lit(True).alias("is_town")).distinct(), "first", "left")
    ranked = tried.join(fit, keys, "left").join(known, STOP)
    best = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*STOP).orderBy(F.coalesce("fit", F.lit(False)).desc(), "rank"))).where("_n = 1")
    split = F.coalesce("is_town", F.lit(False)) & F.col("fit").isNull()
    part = lambda i: T.null_if_empty(F.trim(F.get(parts, F.lit(i))))
    renamed = best.select(*STOP, F.when(split, F.col("first")).otherwise(F.col("town")).alias("town"), F.when(split, part(1)).otherwise(F.col("district")).alias("district"), F.when(split, part(2)).otherwise(T.null_if_empty(F.trim("place"))).alias("place"), "region", "country")
    return renamed.unionByName(own.where("district is not null or place is not null").select(*renamed.columns))


def more_positions(found: DataFrame, candidates: DataFrame, profiles: DataFrame, tolerance: int) -> DataFrame:
    """found with secondary matches along the patterns of direction 1, then of direction 2."""
    for direction in (1, 2):
        patterns = profiles.where(F.col("direction") == direction).join(shuffled(found.select(*STOP, F.col("cx").alias("x"), F.col("cy").alias("y"))), STOP, "left")
        more = secondary_matches(patterns, candidates, ["batch_id"], tolerance)
        found = cut(found.unionByName(more.join(shuffled(found), STOP, "left_anti")))
    return found


def matched_stops(stops: DataFrame, targets: DataFrame, towns: DataFrame, foreign: DataFrame, synonyms: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stops with what their town alone tells; positions; exact candidates) under the stops' names as they are."""
    named = stops.withColumn("name", T.matching_name(F.col("town"), F.col("district"), F.col("place")))
    exact = cut(exact_matches(match_stops_by_name(named, targets, synonyms)).select(*STOP, "x", "y", "precision", "t_region", "t_country"))
    found = primary_matches(top_stop_match(exact, STOP), stops, foreign, towns, STOP).drop("radius")
    found = more_positions(cut(found), exact, profiles, STOP_TOLERANCE)
    by_town = cut(match_by_top_town(stops.join(shuffled(found), STOP, "left_anti"), towns, foreign, STOP).where("rule <> 'none'"))
    points = by_town.where("cx is not null").select(*STOP, "cx", "cy", F.lit("T").alias("precision"), F.col("region").alias("t_region"), F.col("country").alias("t_country"))
    told = by_town.select(*STOP, F.col("region").alias("_r"), F.col("country").alias("_c"))
    known = stops.join(shuffled(told), STOP, "left").withColumn("region", F.coalesce("region", "_r")).withColumn("country", F.coalesce("country", "_c")).drop("_r", "_c")
    return cut(known), cut(found.unionByName(points)), exact


#: Metres by which a town may lie farther off than the line is long.
TOWN_TOLERANCE = 1000


def towns_within_reach(open_stops: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t_region of the stops (keys, town, x, y of the last known position, way since then) for which all areas (name,
    region, ring) of their town's name that lie within the way and TOWN_TOLERANCE of that position agree on a region."""
    apart = polygon_distances(open_stops.select("x", "y", F.col("town").alias("name")), areas, "name", "region")
    near = open_stops.join(apart.select("x", "y", F.col("name").alias("town"), F.col("region").alias("t_region"), "distance"), ["x", "y", "town"]).where(F.col("distance") < F.col("way") + TOWN_TOLERANCE)
    return near.groupBy(*keys).agg(F.count_distinct("t_region").alias("_n"), F.max("t_region").alias("t_region")).where("_n = 1").drop("_n")


def regions_along(stops: DataFrame, places: DataFrame, profiles: DataFrame, regions: DataFrame | None, towns: DataFrame, backwards: bool, areas: DataFrame | None = None) -> DataFrame:
    """stops with regions filled along the patterns of profiles.

    regions (region, ring), where given, guard it: a new region stays only if in some pattern the stop is
    nearer, along the line, to the last stop of known position and the same region than that one is to the
    region's edge. A stop left without a region takes that of the towns of its name that lie within the way
    and 1 km, if they agree."""
    by = ["batch_id", "direction", "pattern"]
    line = profiles.join(shuffled(stops.select(*STOP, "town", "region", "country")), STOP)
    filled = fill_regions(line, by, backwards=backwards)
    at = places.select(*STOP, F.col("cx").alias("x"), F.col("cy").alias("y"))
    old = stops.select(*STOP, F.col("region").alias("old_region"), F.col("country").alias("old_country"))
    rows = filled.join(shuffled(at), STOP, "left").join(shuffled(old), STOP)
    order = F.col("pos").desc() if backwards else F.col("pos")
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sure = F.when(F.col("x").isNotNull() & (F.col("old_country") == "CZ") & F.col("old_region").isNotNull(), F.struct("x", "y", "metres", F.col("old_region").alias("region")))
    rows = rows.withColumn("last", F.last(sure, ignorenulls=True).over(before)).withColumn("way", F.abs(F.col("metres") - F.col("last.metres")))
    if regions is not None:
        # positions are few beside the rows of lines: distances once for each position and region
        rows = cut(rows)
        apart = boundary_distances(rows.where("last is not null").select("last.x", "last.y", "last.region"), regions, "region")
        apart = apart.select(F.col("x").alias("_ex"), F.col("y").alias("_ey"), F.col("region").alias("_er"), "edge")
        rows = rows.join(apart, (F.col("last.x") == F.col("_ex")) & (F.col("last.y") == F.col("_ey")) & (F.col("last.region") == F.col("_er")), "left").drop("_ex", "_ey", "_er")
        edge = F.col("edge")
        fresh = ~F.col("region").eqNullSafe(F.col("old_region"))
        near = F.coalesce((F.col("last.region") == F.col("region")) & (F.col("country") == "CZ") & (F.col("way") <= edge), F.lit(False))
        some = F.max(near).over(Window.partitionBy(*STOP))
        rows = rows.withColumn("_take", ~fresh | some).withColumn("region", F.when(F.col("_take"), F.col("region")).otherwise(F.col("old_region"))).withColumn("country", F.when(F.col("_take"), F.col("country")).otherwise(F.col("old_country")))
    open_ = rows.where("region is null and (country is null or country = 'CZ') and last is not null").select(*STOP, "town", "last", "way")
    if areas is None:
        reach = F.hypot(F.col("tx") - F.col("last.x"), F.col("ty") - F.col("last.y"))
        near_towns = open_.join(towns.select(F.col("name").alias("town"), F.col("region").alias("t_region"), F.col("x").alias("tx"), F.col("y").alias("ty")), "town").where(reach < F.col("way") + TOWN_TOLERANCE)
        agreed = near_towns.groupBy(*STOP).agg(F.count_distinct("t_region").alias("_n"), F.max("t_region").alias("t_region")).where("_n = 1").drop("_n")
    else:
        agreed = towns_within_reach(open_.select(*STOP, "town", "last.x", "last.y", "way"), areas, STOP)
    rows = rows.join(agreed, STOP, "left").withColumn("country", F.when(F.col("region").isNull() & F.col("t_region").isNotNull(), "CZ").otherwise(F.col("country"))).withColumn("region", F.coalesce("region", "t_region"))
    best = richest_rows(rows.select(*STOP, "region", "country"), STOP).select(*STOP, F.col("region").alias("_r"), F.col("country").alias("_c"))
    out = stops.join(shuffled(best), STOP, "left").withColumn("region", F.coalesce("region", "_r")).withColumn("country", F.coalesce("country", "_c"))
    return cut(out.drop("_r", "_c"))


def fix_jdf(stops: DataFrame, trip_stops: DataFrame, routes: DataFrame, targets: DataFrame, towns: DataFrame, foreign: DataFrame, synonyms: DataFrame, regions: DataFrame | None = None, joined: DataFrame | None = None, areas: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole repair of all batches: repaired stops, their locations, and what to look at.

    In: stops: batch_id, stop_id, town, district, place, region, country. trip_stops: batch_id, trip,
    direction (1, 2), pos, stop_id, metres, dep_kind, arr_sec. routes: batch_id, name. targets: name (in
    matching form), x, y, t_region, t_country, precision. towns: name, region, x, y. foreign: name, country,
    x, y. regions: region, ring. Positions are projected metres.

    Steps: regions out of names; names split; matches, neighbours and unambiguous towns under plain names,
    and under urban names for the town with most votes; per batch urban names where they match over one stop
    more; neighbours again with towns and a wider tolerance; regions of the matches, then along the lines,
    both ways. Out: stops; locations (lat, lon in WGS84, precision S or T); missing (stops without a region);
    far (stops too far from the one before on the longest trip of each batch)."""
    joined = joined_towns(stops.sparkSession) if joined is None else joined
    town, region = T.region_in_town(F.col("town"))
    base = stops.select(*STOP, town.alias("town"), "district", "place", F.coalesce(region, F.col("region")).alias("region"), F.when(region.isNotNull(), "CZ").otherwise(F.col("country")).alias("country"))
    base = cut(base)
    a, b, c = T.split_stop_name(F.col("town"), F.col("district"), F.col("place"))
    whole = base.select(*STOP, a.alias("town"), b.alias("district"), c.alias("place"), "region", "country")
    a, b = T.split_non_urban(F.col("town"), F.col("district"), F.col("place"))
    plain = cut(whole.select(*STOP, a.alias("town"), b.alias("district"), "place", "region", "country"))
    profiles = cut(trip_patterns(trip_stops, ["batch_id", "direction"], "trip"))
    plain_stops, plain_found, plain_exact = matched_stops(plain, targets, towns, foreign, synonyms, profiles)

    matches = match_stops_by_name(whole.withColumn("name", T.matching_name(F.col("town"), F.col("district"), F.col("place"))), targets, synonyms)
    votes = urban_votes(whole, matches, towns, joined)
    named_town = routes.select("batch_id", T.town_candidate(F.col("name")).alias("town")).join(towns.select(F.col("name").alias("town")).distinct(), "town", "left_semi")
    chosen = cut(town_candidates(votes, named_town).where("rank = 1").select("batch_id", "town"))
    urban = cut(urban_naming(base, chosen, targets, towns, joined, synonyms))
    urban_stops, urban_found, urban_exact = matched_stops(urban, targets, towns, foreign, synonyms, profiles)
    as_urban = cut(choose_naming(plain_found.join(chosen, "batch_id", "left_semi"), urban_found).where("urban").select("batch_id"))
    either = lambda x, y: cut(x.join(as_urban, "batch_id", "left_anti").unionByName(y.join(as_urban, "batch_id", "left_semi")))
    named, found, exact = either(plain_stops, urban_stops), either(plain_found, urban_found), either(plain_exact, urban_exact)

    near_towns = named.join(shuffled(found), STOP, "left_anti").join(towns.select(F.col("name").alias("town"), "x", "y", F.col("region").alias("t_region")), "town")
    agrees = F.col("region").isNull() | (F.col("region") == F.col("t_region"))
    home = F.col("country").isNull() | (F.col("country") == "CZ")
    near_towns = near_towns.where(agrees & home).select(*STOP, "x", "y", F.lit("T").alias("precision"), "t_region", F.lit("CZ").alias("t_country"))
    places = more_positions(found, exact.unionByName(near_towns), profiles, TOWN_TOLERANCE)

    told = places.select(*STOP, F.col("t_region").alias("_r"), F.col("t_country").alias("_c"))
    out = cut(named.join(shuffled(told), STOP, "left").withColumn("region", F.coalesce("region", "_r")).withColumn("country", F.coalesce("country", "_c")).drop("_r", "_c"))
    for direction in (1, 2):
        for backwards in (False, True):
            out = regions_along(out, places, profiles.where(F.col("direction") == direction), regions, towns, backwards, areas)

    lat, lon = unproject(F.col("cx"), F.col("cy"))
    longest = trip_stops.groupBy("batch_id", "trip").agg(F.count("*").alias("n")).groupBy("batch_id").agg(F.max(F.struct("n", "trip")).alias("m")).select("batch_id", "m.trip")
    run = trip_stops.join(longest, ["batch_id", "trip"]).join(shuffled(places.select(*STOP, F.col("cx").alias("x"), F.col("cy").alias("y"), "precision")), STOP, "left")
    return {
        "stops": out,
        "locations": places.select(*STOP, lat.alias("lat"), lon.alias("lon"), "precision"),
        "missing": missing_region_report(out, trip_stops, STOP),
        "far": distance_warnings(run, ["batch_id", "trip"]),
    }
