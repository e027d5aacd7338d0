"""Merging timetable batches into one: shared dimensions get new ids, facts are re-keyed by joins.

`batch_order` ranks the batches; where several rows are the same thing the first batch's row stays. Ids
come from row numbers over distinct dimension values only, never over facts.
"""

from __future__ import annotations

import bisect
import datetime
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetide.functions.geo import project, unproject
from timetide.functions.lineage import cut, numbered


def merge_dimension(rows: DataFrame, identity: list[str], own: str, order: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """(merged rows with new_id, map batch_id + own id -> new_id) of rows equal, nulls too, in `identity`.

    New ids count from 1 in order of the first (batch, own id) that has the value."""
    sign = F.sha2(F.to_json(F.struct(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in identity])), 256)
    signed = rows.withColumn("_sign", sign)
    first = signed.groupBy("_sign").agg(F.min(F.struct(order, own)).alias("_first"))
    ids = numbered(first, ["_first"], "new_id").select("_sign", "_first", "new_id")
    mapping = signed.select("batch_id", own, "_sign").join(ids.select("_sign", "new_id"), "_sign").drop("_sign").distinct()
    kept = signed.join(ids, "_sign").where(F.struct(order, own) == F.col("_first")).drop("_sign", "_first")
    return kept.dropDuplicates(["new_id"]), mapping


def merge_attribute_refs(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return merge_dimension(refs, ["code", "reserved"], "attribute_id")


def merge_stops(stops: DataFrame, by: str = "name") -> tuple[DataFrame, DataFrame]:
    """By the full name (town, district, place, region, country), or by the stops' own ids."""
    if by == "id":
        first = stops.groupBy("stop_id").agg(F.min("batch_id").alias("batch_id"))
        kept = stops.join(first, ["batch_id", "stop_id"]).dropDuplicates(["stop_id"])
        return kept.withColumn("new_id", F.col("stop_id")), stops.select("batch_id", "stop_id", F.col("stop_id").alias("new_id")).distinct()
    return merge_dimension(stops, ["town", "district", "place", "region", "country"], "stop_id")


def merge_stop_locations(locations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one location per new stop, warnings): the first batch's, a precise one (S) before one of the town (T).

    Warned of: precise locations of one stop over 1000 m from the one kept."""
    rows = locations.join(mapping, ["batch_id", "stop_id"])
    w = Window.partitionBy("new_id").orderBy(F.when(F.col("precision") == "S", 0).otherwise(1), "batch_id", "stop_id")
    ranked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_x", F.first("x").over(w)).withColumn("_y", F.first("y").over(w)).withColumn("_p", F.first("precision").over(w))
    far = (F.col("precision") == "S") & (F.col("_p") == "S") & (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) > 1000)
    return ranked.where("_n = 1").select("new_id", "precision", "x", "y"), ranked.where(far).select("new_id", "batch_id", "stop_id")


def merge_stop_posts(posts: DataFrame, mapping: DataFrame) -> DataFrame:
    rows = posts.join(mapping, ["batch_id", "stop_id"])
    w = Window.partitionBy("new_id", "post_id").orderBy("batch_id", "stop_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("new_id", "post_id", "post_name")


def merge_agencies(agencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agencies, map): equal in all but the distinction are one; others of an id get the next distinction, from 1."""
    what = [c for c in agencies.columns if c not in ("batch_id", "agency_dist")]
    sign = F.sha2(F.to_json(F.struct(*[F.to_json(F.struct(c)) for c in what])), 256)
    signed = agencies.withColumn("_sign", sign)
    distinct = signed.groupBy("agency_id", "_sign").agg(F.min(F.struct("batch_id", "agency_dist")).alias("_first"))
    ranked = distinct.withColumn("new_dist", F.row_number().over(Window.partitionBy("agency_id").orderBy("_first")))
    joined = signed.join(ranked, ["agency_id", "_sign"])
    mapping = joined.select("batch_id", "agency_id", "agency_dist", "new_dist").distinct()
    kept = joined.where(F.struct("batch_id", "agency_dist") == F.col("_first")).dropDuplicates(["agency_id", "new_dist"])
    return kept.drop("_sign", "_first", "batch_id", "agency_dist"), mapping


def merge_routes(routes: DataFrame, agency_map: DataFrame | None = None) -> DataFrame:
    """routes with new_dist: the count of routes of the same licence number so far, by batch; agencies as merged."""
    w = Window.partitionBy("route_id").orderBy("batch_id", "dist")
    out = routes.withColumn("new_dist", F.row_number().over(w))
    if agency_map is None:
        return out
    remap = agency_map.withColumnRenamed("new_dist", "new_agency_dist")
    return out.join(remap, ["batch_id", "agency_id", "agency_dist"], "left")


def rekey(facts: DataFrame, mapping: DataFrame, keys: list[str], new: str, target: str) -> DataFrame:
    """facts with `target` replaced by the mapping's `new`; an old key that is not mapped leaves it null."""
    return facts.join(mapping.select(*keys, F.col(new).alias("_new")), keys, "left").withColumn(target, F.col("_new")).drop("_new")


def merge_trip_groups(groups: DataFrame) -> DataFrame:
    """groups (batch_id, group_id) with new_id: running ids, by the batches' offsets and the place within a batch."""
    sizes = groups.groupBy("batch_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("group_id"))
    return groups.withColumn("_n", place).join(sizes.withColumn("_before", before).drop("n"), "batch_id").withColumn("new_id", F.col("_before") + F.col("_n")).drop("_n", "_before")


def version_row(spark, created: datetime.date | Column) -> DataFrame:
    return spark.range(1).select(F.lit("1.11").alias("version"), F.lit(created).alias("created"))


class _Apart:
    """Pieces that do not overlap, in order of their first days; each remembers when it was added."""

    def __init__(self):
        self.starts: list[datetime.date] = []
        self.at: list[list] = []
        self.added: dict[int, int] = {}
        self.count = 0

    def meeting(self, first: datetime.date, last: datetime.date) -> list[list]:
        """Pieces that meet a range, in the order in which they were added."""
        low = max(bisect.bisect_right(self.starts, first) - 1, 0)
        found = [p for p in self.at[low : bisect.bisect_right(self.starts, last)] if p[3] >= first]
        return sorted(found, key=lambda p: self.added[id(p)])

    def append(self, piece: list) -> None:
        self.count += 1
        self.added[id(piece)] = self.count
        self.place(piece)

    def remove(self, piece: list) -> None:
        del self.added[id(piece)]

    def unplace(self, piece: list) -> None:
        """Take a piece out of the order while its first day may change."""
        k = bisect.bisect_left(self.starts, piece[2])
        del self.starts[k], self.at[k]

    def place(self, piece: list) -> None:
        """Put it back, unless it was removed."""
        if id(piece) in self.added:
            k = bisect.bisect_left(self.starts, piece[2])
            self.starts.insert(k, piece[2])
            self.at.insert(k, piece)

    def pieces(self) -> list[list]:
        return sorted(self.at, key=lambda p: self.added[id(p)])


def _resolved(variants: list[tuple]) -> list[tuple]:
    """Pieces (source dist, new dist, from, to) left of one licence number's variants (dist, from, to, detour, created).

    Later variants are held against the earlier ones in turn. Where two overlap, the part that both claim
    goes to the one with priority: a detour over a plain route, else the one created later. A plain route
    on both sides of a detour is split, and its second piece is a copy with a new distinction. A variant that ends before it
    starts has no piece.

    What is held against is always apart, so it is kept by its first days, and a variant meets only those that it overlaps."""
    day, oldest = datetime.timedelta(days=1), (0,)
    live = [[d, d, a, b, bool(t), oldest if c is None else (1, c)] for d, a, b, t, c in sorted(variants, key=lambda v: v[0]) if a <= b]
    top = max((v[0] for v in variants), default=0)
    queue = deque(live)
    done = _Apart()
    while queue:
        new, alive = queue.popleft(), True
        for old in done.meeting(new[2], new[3]):
            if not alive or new[3] < old[2] or old[3] < new[2]:
                continue
            new_wins = (new[4] and (not old[4] or old[5] < new[5])) or (not old[4] and old[5] < new[5])
            old_wins = old[4] and (not new[4] or new[5] < old[5])
            if (new[2], new[3]) == (old[2], old[3]):
                if new_wins:
                    done.unplace(old)
                    done.remove(old)
                else:
                    alive = False
                continue
            done.unplace(old)
            covers_new, covers_old = old[2] <= new[2] and new[3] <= old[3], new[2] <= old[2] and old[3] <= new[3]
            if new[2] == old[2] or new[3] == old[3]:
                small, large = (new, old) if covers_new else (old, new)
                small_wins = not old_wins if small is new else not new_wins
                if not small_wins:
                    if small is new:
                        alive = False
                    else:
                        done.remove(old)
                elif new[2] == old[2]:
                    large[2] = small[3] + day
                else:
                    large[3] = small[2] - day
            elif covers_new or covers_old:
                inner, outer = (new, old) if covers_new else (old, new)
                outer_wins = old_wins if outer is old else new_wins
                if outer_wins:
                    if inner is new:
                        alive = False
                    else:
                        done.remove(old)
                else:
                    top += 1
                    piece = [outer[0], top, inner[3] + day, outer[3], outer[4], outer[5]]
                    outer[3] = inner[2] - day
                    (done if outer is old else queue).append(piece)
            elif old[2] < new[2]:
                if old_wins:
                    new[2] = old[3] + day
                else:
                    old[3] = new[2] - day
            elif old_wins:
                new[3] = old[2] - day
            else:
                old[2] = new[3] + day
            done.place(old)
        if alive:
            done.append(new)
    return [(s, n, a, b) for s, n, a, b, _, _ in done.pieces()]


def resolve_route_overlaps(routes: DataFrame) -> DataFrame:
    """route_id, source_dist, dist, valid_from, valid_to: what is left of each licence number's variants.

    Columns in: route_id, dist, valid_from, valid_to, detour, created. Dependent tables follow by a join on
    (route_id, source_dist): pieces of one variant copy its rows, a variant without a piece drops them. The
    variants of one licence number are few; each group is one small task. Of created only the order counts, so it
    goes as a number of days: a date may lie past the year 9999, the last that Python has."""

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(r.dist), r.valid_from, r.valid_to, r.detour, None if pd.isna(r.created) else int(r.created)) for r in pdf.itertuples()]
        out = pd.DataFrame(_resolved(rows), columns=["source_dist", "dist", "valid_from", "valid_to"])
        out.insert(0, "route_id", pdf["route_id"].iloc[0])
        return out

    kind = routes.schema["route_id"].dataType.simpleString()
    counted = routes.select("route_id", "dist", "valid_from", "valid_to", "detour", F.unix_date("created").alias("created"))
    return counted.groupBy("route_id").applyInPandas(resolve, f"route_id {kind}, source_dist int, dist int, valid_from date, valid_to date")


def follow_routes(facts: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows of a dependent table (route_id, dist) for the resolved routes."""
    return facts.withColumnRenamed("dist", "source_dist").join(pieces.select("route_id", "source_dist", "dist"), ["route_id", "source_dist"]).drop("source_dist")


def recoded(rows: DataFrame, ref_map: DataFrame, column: str = "attributes") -> DataFrame:
    """rows with the attribute ids of an array replaced by the merged ones; a batch has few attributes."""
    maps = ref_map.groupBy("batch_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute_id", "new_id"))).alias("_map"))
    known = F.transform(column, lambda i: F.get(F.array(F.element_at(F.coalesce("_map", F.create_map().cast("map<int,bigint>")), i)), F.lit(0)).cast("int"))
    return rows.join(maps, "batch_id", "left").withColumn(column, F.filter(known, lambda i: i.isNotNull())).drop("_map")


#: Tables that hang on a route (route_id, dist), and columns of theirs that name a stop.
OF_ROUTES = {
    "route_integrations": (), "route_stops": ("stop_id",), "trips": (), "trip_stops": ("stop_id",), "route_info": (), "service_notes": (),
    "transfers": ("to_stop", "to_end"), "agency_alternations": (), "alternate_route_names": (), "reservation_options": (),
}
CODED = ("stops", "route_stops", "trips", "trip_stops", "agency_alternations")


def merge_jdf(t: dict[str, DataFrame], created: Column, by: str = "name", batch: str = "merged") -> dict[str, DataFrame]:
    """One batch of many: tables as sources.jdf reads and writes them, all under one batch_id.

    Attributes, stops, agencies and trip groups get new ids, everything that names them follows by joins;
    versions of a licence number that overlap are resolved, and what hangs on a route goes with its pieces."""
    refs, ref_map = merge_attribute_refs(t["attribute_refs"])
    ref_map = cut(ref_map)
    t = t | {n: recoded(t[n], ref_map) for n in CODED}
    stops, stop_map = merge_stops(t["stops"], by)
    stop_map = cut(stop_map)
    agencies, agency_map = merge_agencies(t["agencies"])
    agency_map = cut(agency_map)
    numbered_routes = cut(merge_routes(t["routes"], agency_map).withColumn("agency_dist", F.coalesce("new_agency_dist", "agency_dist")).drop("new_agency_dist"))
    # a licence number's versions, each with the date of its batch
    dates = t["version"].groupBy("batch_id").agg(F.max("created").alias("created"))
    versions = numbered_routes.join(dates, "batch_id", "left").select("route_id", F.col("new_dist").alias("dist"), "valid_from", "valid_to", F.coalesce("detour", F.lit(False)).alias("detour"), "created")
    pieces = cut(resolve_route_overlaps(versions))
    of = cut(_pieces_of(numbered_routes, pieces))

    groups = merge_trip_groups(t["trip_groups"].select("batch_id", "group_id", "reserved1", "reserved2"))
    group_map = groups.select("batch_id", "group_id", F.col("new_id").alias("_group"))
    out = {
        "version": version_row(stops.sparkSession, created),
        "attribute_refs": refs.withColumn("attribute_id", F.col("new_id")).drop("new_id"),
        "stops": stops.withColumn("stop_id", F.col("new_id")).drop("new_id"),
        "stop_posts": _as_table(t["stop_posts"], merge_stop_posts(t["stop_posts"], stop_map).withColumnRenamed("new_id", "stop_id")),
        "agencies": agencies.withColumnRenamed("new_dist", "agency_dist"),
        "trip_groups": groups.withColumn("group_id", F.col("new_id")).drop("new_id"),
        "routes": _moved(numbered_routes.drop("new_dist"), of, dates=True),
    }
    x, y = project(F.col("lat").cast("double"), F.col("lon").cast("double"))
    placed, far = merge_stop_locations(t["stop_locations"].withColumn("x", x).withColumn("y", y), stop_map)
    lat, lon = unproject(F.col("x"), F.col("y"))
    out["stop_locations"] = placed.select(F.col("new_id").alias("stop_id"), lat.alias("lat"), lon.alias("lon"), "precision")
    for name, columns in OF_ROUTES.items():
        rows = t[name]
        for c in columns:
            rows = rekey(rows, stop_map.withColumnRenamed("stop_id", c), ["batch_id", c], "new_id", c)
        if name == "trips":
            rows = rows.join(group_map, ["batch_id", "group_id"], "left").withColumn("group_id", F.col("_group")).drop("_group")
        if name == "agency_alternations":
            rows = rows.join(agency_map, ["batch_id", "agency_id", "agency_dist"], "left").withColumn("agency_dist", F.coalesce("new_dist", "agency_dist")).drop("new_dist")
        out[name] = _moved(rows, of)
    merged = {n: _as_table(t[n], df.withColumn("batch_id", F.lit(batch))) for n, df in out.items()}
    return merged | {"location_warnings": far}


def _pieces_of(routes: DataFrame, pieces: DataFrame) -> DataFrame:
    """batch_id, route_id, _old (dist in the batch), _new, _from, _to of each piece."""
    new = pieces.select("route_id", F.col("source_dist").alias("new_dist"), F.col("dist").alias("_new"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"))
    return routes.select("batch_id", "route_id", F.col("dist").alias("_old"), "new_dist").join(new, ["route_id", "new_dist"]).drop("new_dist")


def _moved(rows: DataFrame, of: DataFrame, dates: bool = False) -> DataFrame:
    """Rows of a table with (batch_id, route_id, dist) for every piece of their route; routes take the pieces' dates."""
    out = rows.withColumnRenamed("dist", "_old").join(of, ["batch_id", "route_id", "_old"]).withColumn("dist", F.col("_new"))
    if dates:
        out = out.withColumn("valid_from", F.col("_from")).withColumn("valid_to", F.col("_to"))
    return out.drop("_old", "_new", "_from", "_to")


def _as_table(like: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the columns and types of a table; columns that they do not have are null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema if f.name != "batch_id" or "batch_id" in rows.columns])
