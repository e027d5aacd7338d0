"""Reading and writing timetable batches: folders or zips of cp1250 text tables.

A record is "a","b",…,"z"; with literal "," between fields and no escaping. Every batch under a path is
read in one job; each row carries batch_id (the folder or zip).
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
import zlib
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timetide.functions.lineage import cut, shared_dir
from timetide.functions.text import null_if_empty

VERSION_FILE = "verzejdf"
#: Name of what could not be unpacked or decoded, in place of a file's.
UNREADABLE = "!unreadable"
#: Tables whose file a batch must hold, if only whole batches are taken. Fixed values of the format.
MANDATORY = ("version", "stops", "agencies", "routes", "route_stops", "trips", "trip_stops", "attribute_refs", "service_notes")
RAW = "batch_id string, file string, row_no int, cols array<string>"
#: Columns by table of layout 1.11, in file order, with kinds: s text, i integer, d date, b flag, k kilometres
#: (decimal), t stop time, a[n] n attribute columns. Fixed values of the format.
LAYOUT_111 = {
    "version": ("verzejdf", "version:s du_num:s region:s batch:s created:d name:s"),
    "stops": ("zastavky", "stop_id:i town:s district:s place:s region:s country:s attributes:a6"),
    "stop_posts": ("oznacniky", "stop_id:i post_id:i post_name:s direction:s post_code:s reserved:s"),
    "agencies": ("dopravci", "agency_id:s tax_id:s name:s kind:s person:s address:s office_phone:s dispatch_phone:s phone:s fax:s email:s url:s agency_dist:i"),
    "routes": ("linky", "route_id:s name:s agency_id:s kind:s mode:s detour:b grouped:b posts_used:b one_way:b reserved:s licence:s licence_from:d licence_to:d valid_from:d valid_to:d agency_dist:i dist:i"),
    "route_integrations": ("linext", "route_id:s entry:i system:s route_code:s preferred:b reserved:s dist:i"),
    "route_stops": ("zaslinky", "route_id:s route_stop_id:i zone:s stop_id:i stop_time:i attributes:a3 dist:i"),
    "trips": ("spoje", "route_id:s trip_id:i attributes:a10 group_id:i dist:i"),
    "trip_groups": ("spojskup", "group_id:i reserved1:s reserved2:s"),
    "trip_stops": ("zasspoje", "route_id:s trip_id:i route_stop_id:i stop_id:i post_id:i post_code:s attributes:a2 km:k arr:t dep:t min_arr:t max_dep:t dist:i"),
    "route_info": ("udaje", "route_id:s info_id:i info:s dist:i"),
    "attribute_refs": ("pevnykod", "attribute_id:i code:s reserved:s"),
    "service_notes": ("caskody", "route_id:s trip_id:i note_id:i name:s note_type:i date_from:d date_to:d note:s dist:i"),
    "transfers": ("navaznosti", "kind:s route_id:s trip_id:i route_stop_id:i to_route:s to_stop:i to_end:i from_start:i wait:i note:s dist:i"),
    "agency_alternations": ("altdop", "route_id:s trip_id:i agency_id:s attributes:a6 kind:i reserved:s date_from:d date_to:d agency_dist:i dist:i"),
    "alternate_route_names": ("altlinky", "route_id:s alternate_id:s region:s dist:i"),
    "reservation_options": ("mistenky", "route_id:s trip_id:i note:s dist:i"),
    "stop_locations": ("polzast", "stop_id:i lat:k lon:k precision:s"),
}
#: Tables that a layout lacks, columns that it lacks (filled when upgraded), and tables a batch must hold.
MISSING_TABLES = {"1.8": ("trip_groups", "transfers", "agency_alternations", "alternate_route_names", "reservation_options", "route_integrations", "stop_posts", "stop_locations"), "1.10": ("stop_locations",)}
MISSING_TABLES["1.9"] = MISSING_TABLES["1.8"]
MISSING_COLUMNS = {
    "1.10": {"routes": ("one_way",), "trip_stops": ("min_arr", "max_dep"), "transfers": ("note",)},
    "1.8": {"agencies": ("agency_dist",), "routes": ("mode", "detour", "grouped", "posts_used", "one_way", "agency_dist", "dist"), "route_stops": ("dist", "stop_time"), "trips": ("group_id", "dist"), "trip_stops": ("post_id", "post_code", "min_arr", "max_dep", "dist"), "route_info": ("dist",), "service_notes": ("dist",), "stops": ("region", "country")},
}
MISSING_COLUMNS["1.9"] = MISSING_COLUMNS["1.8"]
DEFAULTS = {"agency_dist": 0, "dist": 0, "mode": "A", "detour": False, "grouped": False, "posts_used": False, "one_way": False}
FAR = "3000-01-01"
TYPES = {"s": "string", "i": "int", "d": "date", "b": "boolean", "k": "decimal(12,6)"}


def _records(text: str):
    for line in text.splitlines():
        line = line.strip()
        if line:
            yield line.removesuffix(";").removeprefix('"').removesuffix('"').split('","')


#: Records that a task holds as Python lists at once.
ROWS = 20_000


def _unpacked(spark: SparkSession, path: str) -> DataFrame:
    """Records of all text files below the path, one row with row_no -1 per file, and one named UNREADABLE per file or archive that cannot be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    files = files.where(F.lower("path").rlike(r"\.(zip|txt)$"))

    def members(name: str, content: bytes):
        folder, _, file = name.rpartition("/")
        if not file.lower().endswith(".zip"):
            yield folder, file, content
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n in z.namelist():
                yield name, n.rpartition("/")[2], z.read(n)

    def rows(name: str, content: bytes):
        batch, file = name, name
        try:
            for batch, file, data in members(name, content):
                if file.lower().endswith(".txt"):
                    stem = re.sub(r"(\.[0-9]+)?\.txt$", "", file.lower())
                    text = data.decode("cp1250")  # whole, so that a file that is not readable gives no record
                    yield batch, stem, -1, None
                    yield from ((batch, stem, i, cols) for i, cols in enumerate(_records(text)))
        except (zipfile.BadZipFile, UnicodeDecodeError, OSError, EOFError, RuntimeError, NotImplementedError, zlib.error) as e:
            yield batch, UNREADABLE, 0, [file.rpartition("/")[2], f"{type(e).__name__}: {e}"[:200]]

    def run(batches):
        for pdf in batches:
            found = (r for name, content in zip(pdf["path"], pdf["content"]) for r in rows(name, content))
            while out := list(islice(found, ROWS)):
                yield pd.DataFrame(out, columns=["batch_id", "file", "row_no", "cols"])

    return files.mapInPandas(run, RAW)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, file (lower case, no suffix), row_no, cols of every batch below the path; files are decoded once."""
    raw = cut(_unpacked(spark, path))
    batches = raw.where(F.col("file") == VERSION_FILE).select("batch_id").distinct()
    return raw.where("row_no >= 0").join(batches, "batch_id", "left_semi")


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in spec.split()]


_CLOCK = "^([01][0-9]|2[0-3])([0-5][0-9])$"


def _cell(at: int) -> Column:
    return null_if_empty(F.trim(F.get("cols", F.lit(at))))


def _numbers(at: int, width: int) -> Column:
    return F.filter(F.transform(F.slice("cols", at + 1, width), lambda c: null_if_empty(F.trim(c))), lambda c: c.isNotNull())


def _typed(kind: str, c: Column) -> Column:
    """The cell's value; null where it has none or another form."""
    if kind == "d":
        return F.try_to_timestamp(c, F.lit("ddMMyyyy")).cast("date")
    if kind == "b":
        return F.when(c == "1", True).when(c.isNull() | (c == "0"), False)
    return c.try_cast(TYPES[kind])


def _places(table: str, version: str):
    """(name, kind, place of the first cell, cells) of the columns that a layout has."""
    at, missing = 0, MISSING_COLUMNS.get(version, {}).get(table, ())
    for name, kind in _columns(LAYOUT_111[table][1]):
        if name not in missing:
            width = int(kind[1:]) if kind[0] == "a" else 1
            yield name, kind[0], at, width
            at += width


def cell_errors(raw: DataFrame, table: str, version: str = "1.11") -> DataFrame:
    """batch_id, row_no, reason: the first cell of each row of the table that has another form than its column."""
    reason = F.lit(None).cast("string")
    for name, kind, at, width in reversed(list(_places(table, version))):
        c = _cell(at)
        if kind == "a":
            bad = F.exists(_numbers(at, width), lambda x: x.try_cast("int").isNull())
        elif kind == "t":
            bad = c.isNotNull() & ~c.isin("|", "<") & ~c.rlike(_CLOCK)
        else:
            bad = c.isNotNull() & _typed(kind, c).isNull()
        reason = reason if kind == "s" else F.when(F.coalesce(bad, F.lit(False)), f"{name} of {table}").otherwise(reason)
    rows = raw.where((F.col("file") == LAYOUT_111[table][0]) & (F.col("row_no") >= 0))
    return rows.select("batch_id", "row_no", reason.alias("reason")).where("reason is not null")


def cast_table(raw: DataFrame, table: str, version: str = "1.11") -> DataFrame:
    """Typed columns of one table in a layout; cells of another form (cell_errors) are null. A time column becomes <name>_kind ('time', 'pass', 'notpass', null) and <name>_sec."""
    rows, out = raw.where((F.col("file") == LAYOUT_111[table][0]) & (F.col("row_no") >= 0)), [F.col("batch_id")]
    for name, kind, at, width in _places(table, version):
        c = _cell(at)
        if kind == "a":
            out.append(F.filter(F.transform(_numbers(at, width), lambda x: x.try_cast("int")), lambda x: x.isNotNull()).alias(name))
        elif kind == "t":
            out.append(F.when(c == "|", "pass").when(c == "<", "notpass").when(c.isNotNull(), "time").alias(f"{name}_kind"))
            out.append(F.when(c.rlike(_CLOCK), F.substring(c, 1, 2).cast("int") * 3600 + F.substring(c, 3, 2).cast("int") * 60).alias(f"{name}_sec"))
        else:
            out.append(_typed(kind, c).alias(name))
    return rows.select(*out)


def upgrade(rows: DataFrame, table: str, version: str) -> DataFrame:
    """Columns that an older layout lacks, as 1.11 has them; a route without an end is valid to the year 3000."""
    for name, kind in _columns(LAYOUT_111[table][1]):
        if name in MISSING_COLUMNS.get(version, {}).get(table, ()):
            if kind == "t":
                rows = rows.withColumns({f"{name}_kind": F.lit(None).cast("string"), f"{name}_sec": F.lit(None).cast("int")})
            else:
                rows = rows.withColumn(name, F.lit(DEFAULTS.get(name)).cast(TYPES[kind]))
    if table == "routes":
        rows = rows.withColumn("valid_to", F.coalesce("valid_to", F.to_date(F.lit(FAR))))
    return rows


LAYOUTS = {"1.11": ("1.11",), "1.10": ("1.10",), "1.8": ("1.8", "1.9")}


def raw_rejects(raw: DataFrame, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(batches with the version of each, batch_id, v; rejects: batch_id, step, reason, item, n) of raw records.

    Rejected: batches of which a file cannot be read, whose version is none, that have a cell of another form than its
    column, and, if complete, that lack a mandatory file (one without a byte counts as missing)."""
    stated = raw.where((F.col("file") == VERSION_FILE) & (F.col("row_no") >= 0)).groupBy("batch_id").agg(F.min_by(F.get("cols", F.lit(0)), "row_no").alias("v"))
    known = [v for vs in LAYOUTS.values() for v in vs]
    good = stated.where(F.col("v").isin(known))
    named = lambda df, step, reason, item, n: df.select("batch_id", F.lit(step).alias("step"), reason.alias("reason"), item.alias("item"), n.cast("long").alias("n"))
    unread = raw.where(F.col("file") == UNREADABLE)
    own = unread.where(F.lower("batch_id").endswith(".zip")).unionByName(unread.join(stated, "batch_id", "left_semi")).distinct()
    found = [
        named(own.groupBy("batch_id").agg(F.min(F.struct(F.get("cols", F.lit(1)).alias("why"), F.get("cols", F.lit(0)).alias("file"))).alias("m"), F.count("*").alias("n")), "read", F.col("m.why"), F.col("m.file"), F.col("n")),
        named(stated.where(~F.coalesce(F.col("v").isin(known), F.lit(False))), "read", F.lit("unknown version"), F.col("v"), F.lit(1)),
    ]
    if complete:
        needed = good.select("batch_id", F.explode(F.array(*[F.lit(LAYOUT_111[t][0]) for t in MANDATORY])).alias("file"))
        lacking = needed.join(raw.select("batch_id", "file").distinct(), ["batch_id", "file"], "left_anti").join(own.select("batch_id"), "batch_id", "left_anti")
        found.append(named(lacking.groupBy("batch_id").agg(F.min("file").alias("file"), F.count("*").alias("n")), "read", F.lit("file missing"), F.col("file"), F.col("n")))
    for version, own_versions in LAYOUTS.items():
        of = raw.join(good.where(F.col("v").isin(*own_versions)).select("batch_id"), "batch_id", "left_semi")
        for table in LAYOUT_111:
            if table not in MISSING_TABLES.get(version, ()):
                errors = cell_errors(of, table, version).groupBy("batch_id", "reason").agg(F.min("row_no").alias("row_no"), F.count("*").alias("n"))
                found.append(named(errors, "cast", F.col("reason"), F.concat(F.lit("row "), F.col("row_no").cast("string")), F.col("n")))
    return good, reduce(DataFrame.unionByName, found)


def read_batches(spark: SparkSession, path: str, complete: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """(all tables of the batches that can be read, each in the layout that its version names, upgraded to 1.11; rejects of
    the others, see raw_rejects).

    Files are unpacked and decoded once and written by table, large ones in several parts, so that a table reads its own
    rows only."""
    stored = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    part = F.floor(F.greatest("row_no", F.lit(0)) / PART_LINES)
    _unpacked(spark, path).repartition("file", "batch_id", part).write.partitionBy("file").parquet(stored)
    raw = spark.read.schema(RAW).parquet(stored)
    versions, rejects = raw_rejects(raw, complete)
    rejects = cut(rejects)
    checked = cut(versions.join(rejects.select("batch_id").distinct(), "batch_id", "left_anti"))
    of = {v: raw.join(checked.where(F.col("v").isin(*vs)).select("batch_id"), "batch_id", "left_semi") for v, vs in LAYOUTS.items()}
    tables = {}
    for table in LAYOUT_111:
        parts = [upgrade(cast_table(of[v], table, v), table, v) for v in of if table not in MISSING_TABLES.get(v, ())]
        tables[table] = reduce(DataFrame.unionByName, parts)
    tables["attribute_refs"] = tables["attribute_refs"].withColumn("code", F.trim("code"))
    return tables, rejects


def read_jdf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """read_batches where every batch must be readable: the first ones that are not are an error."""
    tables, rejects = read_batches(spark, path)
    if bad := rejects.orderBy("batch_id", "reason").limit(5).collect():
        raise ValueError("batches that cannot be read: " + "; ".join(f"{r['batch_id']}: {r['reason']} ({r['item']})" for r in bad))
    return tables


def to_lines(rows: DataFrame, table: str) -> DataFrame:
    """batch_id, file, line: rows of a typed 1.11 table as records."""
    file, spec = LAYOUT_111[table]
    cells = []
    for name, kind in _columns(spec):
        if kind[0] == "a":
            n = int(kind[1:])
            cells += [F.coalesce(F.get(name, F.lit(i)).cast("string"), F.lit("")) for i in range(n)]
        elif kind == "t":
            k, s = F.col(f"{name}_kind"), F.col(f"{name}_sec")
            cells.append(F.when(k == "pass", "|").when(k == "notpass", "<").when(s.isNotNull(), F.format_string("%02d%02d", F.floor(s / 3600), F.floor(s / 60) % 60)).otherwise(""))
        elif kind == "d":
            cells.append(F.coalesce(F.date_format(name, "ddMMyyyy"), F.lit("")))
        elif kind == "b":
            cells.append(F.when(F.col(name), "1").otherwise("0"))
        elif name == "version":
            cells.append(F.lit("1.11"))
        else:
            cells.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    line = F.concat(F.lit('"'), F.concat_ws('","', *cells), F.lit('";'))
    return rows.select("batch_id", F.lit(file).alias("file"), line.alias("line"))


#: Lines that a task writes into one part of a file.
PART_LINES = 100_000


def write_jdf(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write one folder per batch with cp1250 files per table; returns batch_id, file, rows written.

    Lines are in order of their text, in parts of about PART_LINES lines: a file of more is written by
    several tasks, as <file>.txt, <file>.1.txt, …, which read_jdf reads as one table. Parts are written
    under a name of their own and renamed, so that a repeated attempt leaves one whole file."""
    lines = reduce(DataFrame.unionByName, [to_lines(t, n) for n, t in tables.items()])
    lines = cut(lines)
    wanted = F.greatest(F.lit(1), F.ceil(F.col("n") / PART_LINES))
    counts = lines.groupBy("batch_id", "file").agg(F.count("*").alias("n")).select("batch_id", "file", wanted.alias("parts"))
    dealt = lines.join(counts, ["batch_id", "file"]).withColumn("part", F.pmod(F.xxhash64("line"), "parts").cast("int"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
        batch, file, part = pdf["batch_id"].iloc[0], pdf["file"].iloc[0], int(pdf["part"].iloc[0])
        folder = f"{root}/{re.sub(r'[^A-Za-z0-9_.-]+', '_', str(batch)).strip('_')}"
        system.create_dir(folder, recursive=True)
        own = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write("".join(x + "\r\n" for x in sorted(pdf["line"])).encode("cp1250"))
        system.move(own, f"{folder}/{file}{f'.{part}' if part else ''}.txt")
        return pd.DataFrame({"batch_id": [str(batch)], "file": [file], "rows": [len(pdf)]})

    written = dealt.groupBy("batch_id", "file", "part").applyInPandas(write, "batch_id string, file string, rows long")
    return written.groupBy("batch_id", "file").agg(F.sum("rows").alias("rows"))
