"""Matching stop names with places of known position.

Names are compared by tokens and by groups of synonyms (DataFrame: group_id, token; groups are not
transitive). Distinct names only are matched; results fan back out by a join on the name. A query finds
targets through its rarest token, so common tokens are never a join key of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timetide.functions.geo import group_radius
from timetide.functions.lineage import cut, shuffled, spread_join
from timetide.functions.text import name_tokens, normal_sr70

RADIUS = 1000.0


def expansions(tokens: DataFrame, synonyms: DataFrame) -> DataFrame:
    """token, forms: the sorted union of the groups that the token is in, and itself."""
    distinct = tokens.select("token").distinct()
    groups = synonyms.groupBy("group_id").agg(F.collect_set("token").alias("members"))
    of = synonyms.join(groups, "group_id").groupBy("token").agg(F.flatten(F.collect_list("members")).alias("_more"))
    joined = distinct.join(of, "token", "left")
    return joined.select("token", F.array_sort(F.array_union(F.array("token"), F.coalesce("_more", F.array().cast("array<string>")))).alias("forms"))


def expanded_names(names: DataFrame, synonyms: DataFrame) -> DataFrame:
    """name, tokens, forms (array of arrays, by token), all_forms (set) of distinct names."""
    split = names.select("name").distinct().select("name", name_tokens(F.col("name")).alias("tokens")).where(F.size("tokens") > 0)
    each = split.select("name", F.posexplode("tokens").alias("i", "token"))
    forms = each.join(expansions(each, synonyms), "token").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("i", "token", "forms"))).alias("_t"))
    return forms.select("name", F.col("_t.token").alias("tokens"), F.col("_t.forms").alias("forms"), F.array_distinct(F.flatten("_t.forms")).alias("all_forms"))


def name_similarity(target_forms, query_all_forms):
    """Share of the target's tokens that have a synonym among the query's."""
    return F.size(F.filter(target_forms, lambda f: F.arrays_overlap(f, query_all_forms))) / F.size(target_forms)


def exact_name_match(query_forms, target_forms):
    """Same number of tokens, the same forms at each place."""
    return (F.size(query_forms) == F.size(target_forms)) & F.forall(F.zip_with(query_forms, target_forms, lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))


def match_candidates(queries: DataFrame, targets: DataFrame, synonyms: DataFrame, limit: int | None = None) -> DataFrame:
    """query, target, score, exact: targets whose expanded tokens hold every token of the query; with `limit`, the best so many of each query."""
    q = expanded_names(queries, synonyms).select(F.col("name").alias("query"), F.col("tokens").alias("q_tokens"), F.col("forms").alias("q_forms"), F.col("all_forms").alias("q_all"))
    t = expanded_names(targets, synonyms).select(F.col("name").alias("target"), F.col("forms").alias("t_forms"), F.col("all_forms").alias("t_all"))
    postings = t.select("target", "t_forms", "t_all", F.explode("t_all").alias("token"))
    often = postings.groupBy("token").agg(F.count("*").alias("n"))
    each = q.select("query", F.explode("q_tokens").alias("token")).join(often, "token", "left").fillna(0, ["n"])
    rarest = each.groupBy("query").agg(F.min(F.struct("n", "token")).alias("r")).select("query", F.col("r.token").alias("token"))
    met = q.join(rarest, "query").join(postings, "token").where(F.forall("q_tokens", lambda x: F.array_contains("t_all", x)))
    scored = met.select("query", "target", name_similarity(F.col("t_forms"), F.col("q_all")).alias("score"), exact_name_match(F.col("q_forms"), F.col("t_forms")).alias("exact"))
    if limit is None:
        return scored
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "target")
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit).drop("_n")


def match_stops_by_name(stops: DataFrame, targets: DataFrame, synonyms: DataFrame, limit: int | None = None) -> DataFrame:
    """stops (name, …) joined with the candidate targets (name as target, …) and score, exact.

    Many stops may share a name with many targets: pairs of rows are dealt to tasks evenly."""
    found = cut(match_candidates(stops, targets, synonyms, limit))
    met = shuffled(stops).join(found.withColumnRenamed("query", "name"), "name")
    return spread_join(met, targets.withColumnRenamed("name", "target"), ["target"])


def exact_matches(matches: DataFrame) -> DataFrame:
    """Matches of score 1 whose region and country agree where the stop has them."""
    agrees = lambda a, b: F.col(a).isNull() | F.col(a).eqNullSafe(F.col(b))
    return matches.where((F.col("score") == 1) & agrees("region", "t_region") & agrees("country", "t_country"))


def top_stop_match(matches: DataFrame, keys: list[str], radius: float = RADIUS) -> DataFrame:
    """keys, cx, cy, precision, t_region, t_country where all exact matches lie in one region and within the radius of their mean."""
    place = matches.groupBy(*keys).agg(F.count_distinct(F.struct(F.coalesce("t_region", F.lit("")), F.coalesce("t_country", F.lit("")))).alias("_places"), F.max("t_region").alias("t_region"), F.max("t_country").alias("t_country"), F.max(F.coalesce("precision", F.lit("S"))).alias("precision"))
    circle = group_radius(matches, keys)
    return circle.join(shuffled(place.where("_places = 1").drop("_places")), keys).where(F.col("radius") < radius).select(*keys, "cx", "cy", "radius", "precision", "t_region", "t_country")


def match_by_rail_code(stops: DataFrame, targets: DataFrame) -> DataFrame:
    """Stops and targets of one normalised rail code (column sr70)."""
    left = stops.where("sr70 is not null").withColumn("_code", normal_sr70(F.col("sr70")))
    right = targets.where("sr70 is not null").select(F.col("name").alias("target"), "x", "y", normal_sr70(F.col("sr70")).alias("_code"))
    return left.join(right, "_code").drop("_code")


def conflicting_town(stops: DataFrame, towns: DataFrame, keys: list[str]) -> DataFrame:
    """Stops whose town (first part of the name) is a town abroad."""
    return stops.join(towns.select(F.col("name").alias("town")).distinct(), "town", "left_semi").select(*keys)


def primary_matches(top: DataFrame, stops: DataFrame, foreign: DataFrame, domestic: DataFrame, keys: list[str]) -> DataFrame:
    """top_stop_match less the stops that are a town only and are a foreign or a domestic town's name."""
    bare = stops.where("district is null and place is null")
    doubtful = conflicting_town(bare, foreign, keys).union(conflicting_town(bare, domestic, keys)).distinct()
    return top.join(shuffled(doubtful), keys, "left_anti")


def match_by_top_town(stops: DataFrame, domestic: DataFrame, foreign: DataFrame, keys: list[str]) -> DataFrame:
    """stops with region and country from their town: keys, region, country, cx, cy, rule.

    In the country without a region: the one town of that name. Nothing known: the one domestic town if no
    foreign one has the name; a name that is only foreign gives its country, and its point if there is one
    of the name. Else unchanged."""
    home = domestic.groupBy(F.col("name").alias("town")).agg(F.count("*").alias("_h"), F.max(F.struct("region", "x", "y")).alias("_home"))
    away = foreign.groupBy(F.col("name").alias("town")).agg(F.count("*").alias("_f"), F.count_distinct("country").alias("_fc"), F.max(F.struct("country", "x", "y")).alias("_away"))
    rows = stops.join(home, "town", "left").join(away, "town", "left").fillna(0, ["_h", "_f", "_fc"])
    unknown = F.col("country").isNull() & F.col("region").isNull()
    by_home = (F.col("_h") == 1) & (((F.col("country") == "CZ") & F.col("region").isNull()) | (unknown & (F.col("_f") == 0)))
    by_away = unknown & (F.col("_h") == 0) & (F.col("_fc") == 1)
    rule = F.when(by_home, "home").when(by_away, "abroad").otherwise("none")
    point = F.when(by_home, F.struct("_home.x", "_home.y")).when(by_away & (F.col("_f") == 1), F.struct("_away.x", "_away.y"))
    return rows.select(*keys, F.when(by_home, F.col("_home.region")).otherwise(F.col("region")).alias("region"), F.when(by_home, "CZ").when(by_away, F.col("_away.country")).otherwise(F.col("country")).alias("country"), point["x"].alias("cx"), point["y"].alias("cy"), rule.alias("rule"))


def top_priority(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Only the matches of each key's best priority (1 is best)."""
    return matches.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy("priority"))).where("_r = 1").drop("_r")


def match_summary(best: DataFrame) -> DataFrame:
    """match_type, n, percent over all stops, most first."""
    counts = best.groupBy("match_type").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.col("n").desc(), "match_type")


def coverage_classes(stops: DataFrame, targets: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stop_id, name, priority, place: the stops by what their best matches depend on; priority, place, target, score, x, y: these).

    place is the name, or the code, by which a stop is matched at the best priority of its stop_id (null without any match).
    Stops of one name or code have the same matches, which are found once for all of them."""
    found = cut(match_candidates(stops, targets, synonyms).select("query", "target", "score"))
    kinds = targets.withColumn("_code", normal_sr70(F.col("sr70")))
    named = kinds.select(F.col("name").alias("target"), "x", "y", F.when(F.col("kind") == "map", 2).otherwise(4).alias("priority"))
    coded = kinds.where("kind in ('map', 'ext') and _code is not null").select(F.when(F.col("kind") == "map", 1).otherwise(3).alias("priority"), F.col("_code").alias("place"), F.col("name").alias("target"), F.lit(1.0).alias("score"), "x", "y")
    at_names = found.join(named.select("target", "priority").distinct(), "target").groupBy(F.col("query").alias("name")).agg(F.min("priority").alias("_n"))
    at_codes = coded.groupBy(F.col("place").alias("_code")).agg(F.min("priority").alias("_c"))
    known = stops.select("stop_id", "name", normal_sr70(F.col("sr70")).alias("_code")).join(at_names, "name", "left").join(at_codes, "_code", "left")
    best = known.withColumn("priority", F.min(F.least("_n", "_c")).over(Window.partitionBy("stop_id")))
    place = F.when(F.col("priority").isin(1, 3), F.col("_code")).otherwise(F.col("name"))
    rows = found.join(named, "target").select("priority", F.col("query").alias("place"), "target", "score", "x", "y").unionByName(coded)
    return best.select("stop_id", "name", "priority", F.when(F.col("priority").isNotNull(), place).alias("place")), rows


def _unmatched(known: DataFrame) -> DataFrame:
    return known.where("priority is null or stop_id is null").select("stop_id", "name", F.lit(5).alias("priority"), F.lit(None).cast("double").alias("score"))


def coverage_report(stops: DataFrame, targets: DataFrame, synonyms: DataFrame) -> DataFrame:
    """stop_id, name, target, priority, match_type, score, x, y of each stop's best matches; stops without any have type 'none'.

    Priorities: 1 map by code, 2 map by name, 3 external by code, 4 external by name. stops: stop_id, name,
    sr70; targets: name, sr70, kind ('map' or 'ext'), x, y. Only the best matches of a stop are made, none to be sorted out."""
    known, rows = coverage_classes(stops, targets, synonyms)
    types = F.array(*map(F.lit, ("map by code", "map by name", "external by code", "external by name")))
    typed = spread_join(known, rows, ["priority", "place"]).select("stop_id", "name", "target", "score", "x", "y", "priority", F.element_at(types, F.col("priority")).alias("match_type"))
    none = _unmatched(known).select("stop_id", "name", F.lit(None).cast("string").alias("target"), "score", F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), "priority", F.lit("none").alias("match_type"))
    return typed.unionByName(none)


def coverage_page(stops: DataFrame, targets: DataFrame, synonyms: DataFrame, **page) -> DataFrame:
    """report_page() of coverage_report(), without its rows: scores and radii are those of classes of stops (coverage_classes).

    A stop_id of several rows has the matches of all of them, so radii are worked out once per list of classes."""
    known, rows = coverage_classes(stops, targets, synonyms)
    of_class = rows.groupBy("priority", "place").agg(F.max("score").alias("score"))
    matched = known.join(of_class, ["priority", "place"])
    lists = matched.where("stop_id is not null").groupBy("stop_id").agg(F.array_sort(F.collect_list(F.struct("priority", "place"))).alias("classes"))
    points = lists.select("classes").distinct().select("classes", F.inline("classes")).join(rows.where("x is not null"), ["priority", "place"])
    radius = lists.join(shuffled(group_radius(points, ["classes"])), "classes").select("stop_id", "radius")
    each = matched.select("stop_id", "name", "priority", "score").unionByName(_unmatched(known))
    return _page(each, radius, **page)


def report_page(report: DataFrame, text: str = "", perfect: bool = False, sort: str = "name", page: int = 1, size: int = 20) -> DataFrame:
    """One page of stops of the report: name contains the text; perfect: matched by code or with score 1."""
    radius = group_radius(report.where("x is not null"), ["stop_id"]).select("stop_id", "radius")
    return _page(report, radius, text, perfect, sort, page, size)


def _page(report: DataFrame, radius: DataFrame, text: str = "", perfect: bool = False, sort: str = "name", page: int = 1, size: int = 20) -> DataFrame:
    stops = report.groupBy("stop_id", "name").agg(F.min("priority").alias("priority"), F.max("score").alias("score")).join(radius, "stop_id", "left")
    rows = stops.where(F.col("name").ilike(f"%{text}%")) if text else stops
    rows = rows.where(F.col("priority").isin(1, 3) | (F.col("score") == 1)) if perfect else rows
    order = {"name": [F.col("name")], "match": [F.col("priority"), F.col("score").desc_nulls_last()], "radius": [F.col("radius").desc_nulls_last()]}[sort]
    return rows.orderBy(*order, "name", "stop_id").offset((page - 1) * size).limit(size)


def map_nodes(nodes: DataFrame, rail: bool) -> DataFrame:
    """id, name, sr70, lat, lon of map nodes that are rail stops, or other stops."""
    tag = lambda k: F.col("tags")[k]
    at_rail = F.coalesce(tag("railway").isin("halt", "station"), F.lit(False)) & ~F.coalesce(tag("station") == "subway", F.lit(False)) & ~F.map_contains_key("tags", "subway")
    some = (tag("highway") == "bus_stop") | tag("public_transport").isin("platform", "pole", "station") | (tag("railway") == "tram_stop") | (tag("amenity") == "bus_station")
    other = ~F.map_contains_key("tags", "train") & (tag("railway").isNull() | F.map_contains_key("tags", "tram")) & F.coalesce(some, F.lit(False))
    out = nodes.where(at_rail if rail else other)
    return out.select("id", F.coalesce(tag("name"), tag("name:cs")).alias("name"), F.coalesce(tag("ref:sr70"), tag("railway:ref")).alias("sr70"), "lat", "lon")


def full_name(official, name, town, like_town):
    """Official name; else the name, with its town in front unless it is like the town already (score 1)."""
    return F.coalesce(official, F.when(town.isNull() | F.coalesce(like_town == 1, F.lit(False)), name).otherwise(F.concat(town, F.lit(","), name)))


def stop_names(stops: DataFrame, home_only: bool = False) -> DataFrame:
    """Distinct matching names; home_only keeps those in CZ, SK or without a country."""
    from timetide.functions.text import matching_name

    rows = stops.where("country is null or country in ('CZ', 'SK')") if home_only else stops
    return rows.select(matching_name(F.col("town"), F.col("district"), F.col("place")).alias("name")).distinct()
