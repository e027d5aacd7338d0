"""Service days, weekly calendars and their exceptions, holidays.

A trip's day-set depends on its validity, attribute codes and notes only; days, and calendars made of
them, are therefore worked out once per distinct signature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timetide.functions.lineage import cut, numbered, shuffled

#: Fixed holidays (month, day).
FIXED_HOLIDAYS = ((1, 1), (5, 1), (5, 8), (7, 5), (7, 6), (9, 28), (10, 28), (11, 17), (12, 24), (12, 25), (12, 26))
ONLY, NO, ALSO = 3, 4, 2
ODD, EVEN, FROM_TO = (5, 7), (6, 8), 1
#: Codes that say on which days a trip runs: X working days, + Sundays and holidays, 1..7 days of the week.
DAY_CODES = ("X", "+", "1", "2", "3", "4", "5", "6", "7")


def easter_sunday(year: Column) -> Column:
    """Date of Easter Sunday in the Gregorian calendar."""
    y = year.cast("int")

    def div(a: Column, b) -> Column:
        return F.floor(a / b).cast("int")

    century = div(y, 100)
    moon = F.pmod(century - div(century, 4) - div(8 * century + 13, 25) + 19 * (y % 19) + 15, F.lit(30))
    moon = moon - F.when((moon == 29) | ((moon == 28) & (y % 19 > 10)), 1).otherwise(0)
    weekday = F.pmod(y + div(y, 4) + moon + 2 - century + div(century, 4), F.lit(7))
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), (moon - weekday).cast("int"))


def czech_holidays(spark, start_year: int, end_year: int) -> DataFrame:
    """day of every public holiday of the years; Good Friday and Easter Monday are counted from Easter itself."""
    years = spark.range(start_year, end_year + 1).select(F.col("id").cast("int").alias("year"))
    fixed = F.array(*[F.make_date("year", F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS])
    easter = easter_sunday(F.col("year"))
    return years.select(F.explode(F.concat(fixed, F.array(F.date_sub(easter, 2), F.date_add(easter, 1)))).alias("day"))


def signed_trips(trips: DataFrame, notes: DataFrame, keys: list[str], store: bool = False, more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(keys, more, _sign; the distinct signatures: _sign, valid_from, valid_to, codes, notes); with store, of a written table.

    A trip's days depend on its validity, codes and notes only, so they are worked out once per signature."""
    typed = notes.where("note_type is not null").select(*keys, "note_type", "date_from", "date_to")
    listed = typed.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("note_type", "date_from", "date_to"))).alias("notes"))
    known = trips.select(*keys, *more, "valid_from", "valid_to", F.sort_array(F.array_distinct("codes")).alias("codes")).join(shuffled(listed), keys, "left")
    sign = ["valid_from", "valid_to", "codes", "notes"]
    known = known.withColumn("_sign", F.xxhash64(*sign))
    known = cut(known) if store else known
    return known.select(*keys, *more, "_sign"), known.select("_sign", *sign).dropDuplicates(["_sign"])


def _start(n: Column) -> Column:
    return F.coalesce(n["date_from"], F.col("valid_from"))


def _end(n: Column) -> Column:
    return F.coalesce(n["date_to"], _start(n))


def runs_on(day: Column, holiday: Column, now: Column) -> Column:
    """Whether a signature (columns codes and notes) runs on a day, of which `now` holds the types of the notes that cover it."""
    ever, week_even, weekday = _types(), F.weekofyear(day) % 2 == 0, F.weekday(day) + 1
    code = lambda c: F.array_contains("codes", c)
    has = _has
    return (
        F.when(has(now, ONLY), True).when(has(ever, ONLY), False).when(has(now, NO), False).when(has(now, ALSO), True)
        .when(has(now, *ODD) & week_even, False).when(has(now, *EVEN) & ~week_even, False)
        .when(has(ever, FROM_TO) & ~has(now, FROM_TO), False)
        .when(code("+") & (holiday | (weekday == 7)), True)
        .when(code("X") & ~holiday & (weekday <= 5), True)
        .when(F.array_contains("codes", weekday.cast("string")), True)
        .otherwise(~F.arrays_overlap("codes", F.array(*[F.lit(c) for c in DAY_CODES])))
    )


def covering(day: Column) -> Column:
    """Types of a signature's notes that cover the day."""
    covers = F.filter("notes", lambda n: (day >= _start(n)) & (day <= _end(n)))
    return F.coalesce(F.transform(covers, lambda n: n["note_type"]), F.array().cast("array<int>"))


def judged_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """days (columns of a signature, and day) with runs and planned (by the weekly pattern alone)."""
    days = days.join(F.broadcast(holidays.select("day", F.lit(True).alias("holiday"))), "day", "left").withColumn("now", covering(F.col("day")))
    runs = runs_on(F.col("day"), F.coalesce("holiday", F.lit(False)), F.col("now"))
    return days.withColumn("runs", runs).withColumn("planned", F.element_at(weekly_pattern(F.col("codes")), F.weekday("day") + 1)).drop("holiday", "now")


def _types() -> Column:
    return F.coalesce(F.transform("notes", lambda n: n["note_type"]), F.array().cast("array<int>"))


def _has(c: Column | str, *types: int) -> Column:
    return F.arrays_overlap(c, F.array(*[F.lit(x) for x in types]))


def signature_days(plans: DataFrame, holidays: DataFrame) -> DataFrame:
    """_sign, day, runs, planned: a row for each day of a signature's validity."""
    days = plans.where("valid_from <= valid_to").select("*", F.explode(F.sequence("valid_from", "valid_to")).alias("day"))
    return judged_days(days, holidays).select("_sign", "day", "runs", "planned")


def planned_between(pattern: Column, first: Column, last: Column) -> Column:
    """How many days from first to last a weekly pattern has, without listing them."""
    ahead = lambda w: F.pmod(F.lit(w) - F.weekday(first), F.lit(7))
    times = [F.when(pattern[w], F.greatest(F.lit(0), F.floor((F.datediff(last, first) - ahead(w)) / 7).cast("int") + 1)).otherwise(0) for w in range(7)]
    return F.when(first <= last, sum(times[1:], times[0])).otherwise(0)


def base_ranges() -> Column:
    """Of a signature, the ranges of days (s, e) on which it runs as its pattern says where no other note and no holiday changes
    that: none where it runs on noted days only, its merged from-to notes where it has any, else its validity."""
    clipped = F.transform(F.filter("notes", lambda n: n["note_type"] == FROM_TO), lambda n: F.struct(F.greatest(_start(n), "valid_from").alias("s"), F.least(_end(n), "valid_to").alias("e")))
    none = F.array().cast("array<struct<s:date,e:date>>")

    def joined(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e")))
        return F.when(x["s"] <= F.date_add(last["e"], 1), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), longer)).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(F.sort_array(F.filter(clipped, lambda x: x["s"] <= x["e"])), none, joined)
    whole = F.array(F.struct(F.col("valid_from").alias("s"), F.col("valid_to").alias("e")))
    return F.when(_has(_types(), ONLY), none).when(_has(_types(), FROM_TO), merged).otherwise(whole)


def with_odd_days(plans: DataFrame, holidays: DataFrame) -> DataFrame:
    """plans with odd, the days of each signature that its base ranges and pattern may not settle (those of notes of other kinds than
    from-to, and holidays where the codes ask for them; inside its validity), and own_holidays, the latter."""
    other = F.filter("notes", lambda n: n["note_type"] != FROM_TO)
    clipped = F.transform(other, lambda n: F.struct(F.greatest(_start(n), "valid_from").alias("s"), F.least(_end(n), "valid_to").alias("e")))
    noted = F.flatten(F.transform(F.filter(clipped, lambda x: x["s"] <= x["e"]), lambda x: F.sequence(x["s"], x["e"])))
    years = holidays.groupBy(F.year("day").alias("y")).agg(F.array_sort(F.collect_set("day")).alias("days"))
    every = years.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "days")))).alias("_holidays"))
    asked = F.arrays_overlap("codes", F.array(F.lit("X"), F.lit("+")))
    # a short validity looks into its one or two years, a long one at all holidays
    first, last = F.year("valid_from"), F.year("valid_to")
    none = F.array().cast("array<date>")
    of = lambda y: F.coalesce(F.try_element_at("_holidays", y), none)
    near = F.when(first == last, of(first)).when(F.datediff("valid_to", "valid_from") <= 366, F.concat(of(first), of(last))).otherwise(F.flatten(F.map_values("_holidays")))
    found = F.filter(near, lambda d: d.between(F.col("valid_from"), F.col("valid_to")))
    own = F.when(asked, found).otherwise(none)
    with_all = plans.join(F.broadcast(every), F.lit(True)).withColumn("own_holidays", own).drop("_holidays")
    return with_all.withColumn("odd", F.array_distinct(F.concat(F.coalesce(noted, none), "own_holidays")))


def odd_days(plans: DataFrame, holidays: DataFrame) -> DataFrame:
    """The columns of plans, and day: with_odd_days() by rows."""
    return with_odd_days(plans, holidays).select(*plans.columns, F.explode("odd").alias("day"))


def _in_base(day: Column | None = None) -> Column:
    day = F.col("day") if day is None else day
    return F.exists("base", lambda r: day.between(r["s"], r["e"]))


def based_plans(plans: DataFrame) -> DataFrame:
    """plans of some validity with base (base_ranges), pattern, and n_base: how many days of the base are planned."""
    own = plans.where("valid_from <= valid_to").withColumn("base", base_ranges()).withColumn("pattern", weekly_pattern(F.col("codes")))
    return own.withColumn("n_base", F.aggregate("base", F.lit(0), lambda n, r: n + planned_between(F.col("pattern"), r["s"], r["e"])))


def judged_signatures(plans: DataFrame, holidays: DataFrame) -> DataFrame:
    """plans of some validity with n_on (how many days each runs), by_list and changes (day, exception_type; sorted).

    Running days, and days on which a signature differs from its weekly pattern, are counted: odd days one by one, the others
    in closed form over ranges. Only what the calendar itself has to list is then listed, so a long validity costs no days.
    All of a signature is in its own row: nothing is shuffled."""
    own = based_plans(plans).withColumn("n_planned", planned_between(F.col("pattern"), F.col("valid_from"), F.col("valid_to")))
    planned = lambda d: F.element_at("pattern", F.weekday(d) + 1)
    own = with_odd_days(own, holidays).withColumn("_days", F.transform("odd", lambda d: F.struct(d.alias("day"), covering(d).alias("now"))))
    # holidays count only with codes that ask for them, and then all of the validity are own_holidays
    judged = F.transform("_days", lambda x: F.struct(x["day"].alias("day"), runs_on(x["day"], F.array_contains("own_holidays", x["day"]), x["now"]).alias("runs"), planned(x["day"]).alias("planned"), (planned(x["day"]) & _in_base(x["day"])).alias("based")))
    own = own.withColumn("_facts", judged)
    count = lambda test: F.size(F.filter("_facts", test))
    odd_on, odd_based = count(lambda x: x["runs"]), count(lambda x: x["based"])
    odd_differ, odd_off = count(lambda x: x["runs"] != x["planned"]), count(lambda x: x["planned"] & ~x["based"])
    both = own.withColumn("odd_on", odd_on).withColumn("odd_differ", odd_differ).withColumn("n_on", F.col("odd_on") + F.col("n_base") - odd_based)
    both = both.withColumn("n_differ", F.col("odd_differ") + F.col("n_planned") - F.col("n_base") - odd_off).withColumn("by_list", F.col("n_differ") > F.col("n_on"))
    listed = F.filter("_facts", lambda x: F.when(F.col("by_list"), x["runs"]).otherwise(x["runs"] != x["planned"]))
    change = lambda day, on: F.struct(day.alias("day"), F.when(on, 1).otherwise(2).alias("exception_type"))
    # planned days that are not odd: those that run where all running days are listed, else those that do not
    wanted = (F.col("n_on") > 0) & F.when(F.col("by_list"), F.col("n_on") > F.col("odd_on")).otherwise(F.col("n_differ") > F.col("odd_differ"))
    ranges = F.when(F.col("by_list"), F.col("base")).otherwise(F.array(F.struct(F.col("valid_from").alias("s"), F.col("valid_to").alias("e"))))
    days = F.filter(F.flatten(F.transform(ranges, lambda r: F.sequence(r["s"], r["e"]))), lambda d: planned(d) & (F.col("by_list") | ~_in_base(d)))
    rest = F.when(wanted, F.transform(F.array_except(days, "odd"), lambda d: change(d, F.col("by_list"))))
    empty = F.array().cast("array<struct<day:date,exception_type:int>>")
    changes = F.concat(F.transform(listed, lambda x: change(x["day"], x["runs"])), F.coalesce(rest, empty))
    return both.select(*plans.columns, "pattern", "n_on", "by_list", F.sort_array(changes).alias("changes"))


def signature_changes(plans: DataFrame, holidays: DataFrame) -> DataFrame:
    """_sign, by_list, changes (day, exception_type) of the signatures that run at all (judged_signatures)."""
    return judged_signatures(plans, holidays).where("n_on > 0").select("_sign", "by_list", "changes")


def digest(*columns: str) -> Column:
    """16 bytes that stand for the columns."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def running_trips(trips: DataFrame, notes: DataFrame, holidays: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the trips of service_calendar() that run at all: their days are counted, and no calendar is made.

    A day that runs is a base day that is planned and not odd, or an odd day judged to run."""
    known, plans = signed_trips(trips, notes, keys, store=True)
    own = based_plans(plans)
    odd = judged_days(odd_days(own, holidays), holidays)
    seen = odd.groupBy("_sign").agg((F.count_if("runs") - F.count_if(F.col("planned") & _in_base())).alias("_more"))
    live = own.join(shuffled(seen), "_sign", "left").where(F.col("n_base") + F.coalesce("_more", F.lit(0)) > 0).select("_sign")
    return known.join(shuffled(live), "_sign", "left_semi").select(*keys)


def service_days(trips: DataFrame, notes: DataFrame, holidays: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day: all days on which each trip runs, to the end of its validity however long that is.

    trips: keys, valid_from, valid_to, codes (array of code strings). notes: keys, note_type, date_from,
    date_to; a start defaults to the validity's start, an end to the note's start; notes without a type
    do not count, and a note that ends before it starts covers nothing. The first rule that fires decides:
    service only; no service; also; week parity; from-to; then the day codes; a trip without day codes runs.
    Where only the calendar of a trip is wanted, service_calendar() makes it without these rows."""
    known, plans = signed_trips(trips, notes, keys)
    return known.join(signature_days(plans, holidays).where("runs").select("_sign", "day"), "_sign").select(*keys, "day")


def service_calendar(trips: DataFrame, notes: DataFrame, holidays: DataFrame, keys: list[str], more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(keys, the columns `more` of trips, plan of the trips that run at all; plans: plan, valid_from, valid_to, pattern, changes).

    The same as compact_calendar over service_days, made once per distinct signature from ranges of days, and written: changes
    are sorted (day, exception_type); a plan by list has neither pattern nor range. Signatures that come
    to the same calendar share a plan."""
    known, plans = signed_trips(trips, notes, keys, True, more)
    unlisted = lambda c: F.when(~F.col("by_list"), F.col(c)).alias(c)
    made = judged_signatures(plans, holidays).select("_sign", "n_on", *map(unlisted, ("valid_from", "valid_to", "pattern")), "changes")
    made = cut(made.withColumn("plan", digest("valid_from", "valid_to", "pattern", "changes"))).where("n_on > 0").drop("n_on")
    services = cut(known.join(shuffled(made.select("_sign", "plan")), "_sign").drop("_sign"))
    return services, made.drop("_sign").dropDuplicates(["plan"])


def calendar_names(services: DataFrame, plans: DataFrame, service: str, within: list[str] | None = None) -> DataFrame:
    """within, plan -> calendar_id 'CAL-<bits|exc>-<i>', i the rank, from 0, of the plan by its smallest service."""
    within = within or []
    bits = F.coalesce(F.array_join(F.transform("pattern", lambda b: F.when(b, "1").otherwise("0")), ""), F.lit("exc"))
    groups = services.groupBy(*within, "plan").agg(F.min(service).alias("_first"))
    placed = numbered(groups, [*within, "_first"], "_i")
    if within:
        placed = placed.join(placed.groupBy(*within).agg(F.min("_i").alias("_least")), within)
    else:
        placed = placed.withColumn("_least", F.lit(1))
    named = placed.join(shuffled(plans.select("plan", bits.alias("bits"))), "plan")
    return named.select(*within, "plan", F.concat_ws("-", F.lit("CAL"), "bits", (F.col("_i") - F.col("_least")).cast("string")).alias("calendar_id"))


def weekly_pattern(codes: Column) -> Column:
    """Seven booleans, Monday first: X working days, + Sunday, n the n-th day; without any, every day."""
    on = [F.array_contains(codes, str(i)) | (F.array_contains(codes, "X") if i <= 5 else F.array_contains(codes, "+") if i == 7 else F.lit(False)) for i in range(1, 8)]
    none = ~F.arrays_overlap(codes, F.array(*[F.lit(c) for c in DAY_CODES]))
    return F.array(*[o | none for o in on])


def calendar_days(calendar: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day: the days of weekly calendars (valid_from, valid_to, pattern)."""
    days = calendar.where("valid_from <= valid_to").select(*keys, "pattern", F.explode(F.sequence("valid_from", "valid_to")).alias("day"))
    return days.where(F.element_at("pattern", F.weekday("day") + 1)).select(*keys, "day")


def compact_calendar(trips: DataFrame, days: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(calendar rows, exceptions) that say the same as `days`.

    A trip that never runs is in neither. Where more days differ from the weekly pattern than it runs,
    there is no calendar row and every day is an added one (1); else the pattern, with added (1) and
    removed (2) days. One shuffle by the keys serves all steps."""
    base = trips.select(*keys, "valid_from", "valid_to", weekly_pattern(F.col("codes")).alias("pattern"))
    wanted = calendar_days(base, keys).select(*keys, "day", F.lit(False).alias("runs"), F.lit(True).alias("planned"))
    both = days.select(*keys, "day", F.lit(True).alias("runs"), F.lit(False).alias("planned")).union(wanted).repartition(*keys)
    both = both.groupBy(*keys, "day").agg(F.max("runs").alias("runs"), F.max("planned").alias("planned"))
    own = Window.partitionBy(*keys)
    both = both.withColumn("running", F.count_if("runs").over(own)).withColumn("differ", F.count_if(F.col("runs") != F.col("planned")).over(own)).where("running > 0")
    both = cut(both.withColumn("by_list", F.col("differ") > F.col("running")).where(F.when(F.col("by_list"), F.col("runs")).otherwise(F.lit(True))))
    calendar = base.join(both.where("not by_list").select(*keys).distinct(), keys).select(*keys, "valid_from", "valid_to", "pattern")
    rows = both.where(F.col("by_list") | (F.col("runs") != F.col("planned")))
    return calendar, rows.select(*keys, "day", F.when(F.col("runs"), 1).otherwise(2).alias("exception_type"))


def dedupe_calendar(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """service_id -> calendar_id: services with the same pattern, range and exceptions share 'CAL-<bits|exc>-<i>'.

    i is the rank, from 0, of the group by its smallest service id; for calendars that service_calendar()
    made, calendar_names() does the same from their plans."""
    listed = exceptions.groupBy("service_id").agg(F.sort_array(F.collect_list(F.struct("day", "exception_type"))).alias("changes"))
    both = calendar.select("service_id", "valid_from", "valid_to", "pattern").join(listed, "service_id", "full")
    both = cut(both.withColumn("plan", F.sha2(F.to_json(F.struct("valid_from", "valid_to", "pattern", "changes")), 256)))
    names = calendar_names(both, both.dropDuplicates(["plan"]), "service_id")
    return both.select("service_id", "plan").join(names, "plan").select("service_id", "calendar_id")


def bitmap_days(messages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, day of each '1' in `bitmap`, whose first character is the day `start`, moved by offset_days where negative."""
    shift = F.least(F.coalesce("offset_days", F.lit(0)), F.lit(0))
    days = messages.select(*keys, "start", shift.alias("shift"), F.posexplode(F.split("bitmap", "")).alias("i", "bit")).where("bit = '1'")
    return days.select(*keys, F.expr("date_add(start, i + shift)").alias("day"))


def days_to_bitmap(days: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, bitmap from the first day to the last."""
    own = days.groupBy(*keys).agg(F.min("day").alias("start"), F.sort_array(F.collect_set("day")).alias("set"))
    # gaps between one day and the next as runs of 0: linear in the range
    gap = F.transform("set", lambda d, i: F.concat(F.when(i > 0, F.repeat(F.lit("0"), F.datediff(d, F.get("set", i - 1)) - 1)).otherwise(""), F.lit("1")))
    return own.select(*keys, "start", F.array_join(gap, "").alias("bitmap"))


def bitmap_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def bitmap_and(a: Column, b: Column) -> Column:
    """Both bitmaps; they must be of the same length, else null."""
    both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"))
    return F.when(F.length(a) == F.length(b), F.array_join(both, ""))


def bitmap_extend(bits: Column, start: Column, to_start: Column, to_end: Column) -> Column:
    """The bitmap over a longer interval that holds its own, else null."""
    before = F.datediff(start, to_start)
    size = F.datediff(to_end, to_start) + 1
    return F.when((before >= 0) & (before + F.length(bits) <= size), F.rpad(F.concat(F.repeat(F.lit("0"), before), bits), size, "0"))


def cancel_days(days: DataFrame, cancelled: DataFrame, keys: list[str]) -> DataFrame:
    """Days that are not cancelled; a train of which none is left is gone with its last row."""
    return days.join(cancelled, [*keys, "day"], "left_anti")


def first_messages(messages: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(the first message of each key, the later ones)."""
    ranked = messages.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def negative_day_offset(locations: Column) -> Column:
    """The least arrival or departure day offset of a message's locations if that is under 0, else 0."""
    return F.least(F.coalesce(F.array_min(F.flatten(F.transform(locations, lambda x: F.array(x["arr_offset"], x["dep_offset"])))), F.lit(0)), F.lit(0))


def feed_info(days: DataFrame) -> DataFrame:
    """start_date, end_date over all: with no end at all the earliest start."""
    return days.agg(F.min("start").alias("start_date"), F.coalesce(F.max("end"), F.min("start")).alias("end_date"))
