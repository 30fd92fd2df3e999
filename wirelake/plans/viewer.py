"""Interactive queries: catalog search, plot fetches, playback and map data."""

from __future__ import annotations

import re
from collections import OrderedDict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.functions.bytes import display_source, file_stem

CATALOG = ["signal_source", "channel", "signal_name"]
LATLON_WORDS = ("lat", "lon", "gps")
Key = tuple[str, int, str]

_KEY = re.compile(r"^([A-Za-z_]+)(\d*)::(.*)$", re.S)


def parse_key(key: str) -> Key:
    """CAN1::Speed as (source, channel, name); channel 0 where missing."""
    m = _KEY.match(key)
    if not m:
        raise ValueError(f"not a signal key: {key!r}")
    return m[1], int(m[2] or 0), m[3]


def sql(spark, statement: str, parameters: list | None = None) -> DataFrame:
    """A statement with ``?`` markers bound to parameters."""
    return spark.sql(statement, args=parameters or [])


def any_key(keys: list[Key]) -> Column:
    """An OR of equalities, which reaches the scan (a tuple IN would not)."""
    out = F.lit(False)
    for source, channel, name in keys:
        out = out | ((F.col("signal_source") == source) & (F.col("channel") == channel) & (F.col("signal_name") == name))
    return out


def source_files(files: DataFrame, most: int = 200) -> DataFrame:
    return files.select("_source_file").orderBy("_source_file").limit(most)


def _capped(rows: DataFrame, per_source: int | None) -> DataFrame:
    if per_source is not None:
        w = Window.partitionBy("signal_source").orderBy("channel", "signal_name")
        rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_source).drop("__n")
    return rows.orderBy(*CATALOG)


def browse(catalog: DataFrame, files: list[str] | None = None, where: Column | None = None, per_source: int | None = None) -> DataFrame:
    """Catalog rows in order, at most ``per_source`` of each source. With
    ``files`` the catalog is the one by file."""
    rows = catalog.where(F.col("_source_file").isin(files)) if files else catalog
    rows = rows.select(*CATALOG)
    rows = rows.distinct() if files else rows
    return _capped(rows if where is None else rows.where(where), per_source)


def matches(words: list[str]) -> Column:
    """Every word occurs, whatever its case, in the name, the source, its shown
    source, the channel or source and channel together."""
    shown, channel = display_source(), F.col("channel").cast("string")
    fields = [F.col("signal_name"), F.col("signal_source"), shown, channel, F.concat("signal_source", channel), F.concat(shown, channel)]
    out = F.lit(True)
    for w in words:
        found = F.lit(False)
        for f in fields:
            found = found | F.coalesce(F.contains(F.lower(f), F.lit(w.lower())), F.lit(False))
        out = out & found
    return out


def search(catalog: DataFrame, text: str, files: list[str] | None = None, limit: int = 500) -> DataFrame:
    """Matches with ``truncated``: whether their source had more than its share."""
    share = max(1, limit // 3)
    found = browse(catalog, files, matches(text.split()), share + 1)
    w = Window.partitionBy("signal_source")
    n = F.row_number().over(w.orderBy("channel", "signal_name"))
    counted = found.withColumns({"__n": n, "truncated": F.count(F.lit(1)).over(w) > share})
    return counted.where(F.col("__n") <= share).drop("__n").orderBy(*CATALOG)


def latlon_candidates(catalog: DataFrame, files: list[str] | None = None, limit: int = 100) -> DataFrame:
    name = F.lower("signal_name")
    found = F.lit(False)
    for w in LATLON_WORDS:
        found = found | F.contains(name, F.lit(w))
    return browse(catalog, files, found, max(1, limit // 3))


def channels(catalog: DataFrame, files: list[str] | None = None) -> DataFrame:
    rows = catalog.where(F.col("_source_file").isin(files)) if files else catalog
    return rows.select("signal_source", "channel").distinct().orderBy("signal_source", "channel")


def file_scopes(by_file: DataFrame, keys: list[Key], files: list[str]) -> DataFrame:
    """Keys that none of ``files`` holds: the files that do, sorted, or none at
    all for unknown keys (``files`` NULL)."""
    spark = by_file.sparkSession
    wanted = spark.createDataFrame(keys, "signal_source string, channel int, signal_name string")
    held = by_file.where(any_key(keys)).groupBy(*CATALOG).agg(F.array_sort(F.collect_set("_source_file")).alias("files"))
    selected = F.array(*(F.lit(f) for f in files))
    out = wanted.join(held, CATALOG, "left")
    return out.where(F.col("files").isNull() | ~F.arrays_overlap("files", selected)) if files else out.where(F.lit(False))


def time_bounds(gold: DataFrame) -> DataFrame:
    """One row; NULL bounds where nothing matched mean: keep the current ones."""
    return gold.agg(F.min("timestamp_s").alias("t_min"), F.max("timestamp_s").alias("t_max"), F.min("event_time").alias("t0"))


SAMPLE = ["event_time", "timestamp_s", "timestamp_ns", "signal_value", "signal_str"]


def selection(keys: list[Key], files: list[str] | None = None, extra_scope: dict[Key, list[str]] | None = None) -> Column:
    """Keys within ``files``; those of ``extra_scope`` within their own files."""
    extra = {k: v for k, v in (extra_scope or {}).items() if k in keys and v}
    rest = [k for k in keys if k not in extra]
    out = any_key(rest) & F.col("_source_file").isin(files) if files else any_key(rest)
    for k in sorted(extra):
        out = out | (any_key([k]) & F.col("_source_file").isin(extra[k]))
    return out


#: A time line is cut into so many equal stretches, each of which one task can hold.
STRETCHES = 256


def stretched(df: DataFrame, by: list[str], on: str) -> DataFrame:
    """Adds ``__cell``, the stretch of its line (one per ``by``) that a row lies
    in. The ends of the lines are one small row each."""
    ends = df.groupBy(*by).agg(F.min(on).alias("__lo"), F.max(on).alias("__hi"))
    placed = _with_line(df, ends, by)
    share = F.try_divide((F.col(on) - F.col("__lo")).cast("double"), (F.col("__hi") - F.col("__lo")).cast("double"))
    return placed.withColumn("__cell", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * STRETCHES), F.lit(STRETCHES - 1)).cast("int")).drop("__lo", "__hi")


def _with_line(df: DataFrame, lines: DataFrame, by: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Joins what is known per line (and ``extra``); nulls in ``by`` are a line too."""
    renamed = lines.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate((*by, *extra))), *(c for c in lines.columns if c not in (*by, *extra)))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate((*by, *extra))]
    joined = df.join(renamed, reduce(lambda a, b: a & b, same), "left") if same else df.crossJoin(F.broadcast(renamed))  # one row
    return joined.drop(*(f"__{i}" for i in range(len(same))))


def numbered(df: DataFrame, by: list[str], on: str, order: list[str]) -> DataFrame:
    """Adds ``__row`` (from 0) and ``__rows``: a row's place in its line by
    ``order``, which starts with ``on``, and the line's length; nulls come last.
    Rows are numbered within stretches, to which the stretches before are added."""
    cells = stretched(df, by, on)
    cells = cells.withColumn("__cell", F.when(F.col(on).isNull(), F.lit(STRETCHES)).otherwise(F.col("__cell")))
    counts = cells.groupBy(*by, "__cell").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "__cell", before.alias("__before"), F.sum("__n").over(w).alias("__rows"))
    inside = F.row_number().over(Window.partitionBy(*by, "__cell").orderBy(*(F.col(c).asc_nulls_last() for c in order))) - 1
    placed = _with_line(cells.withColumn("__in", inside), counts, by, ("__cell",))
    return placed.withColumn("__row", F.col("__before") + F.col("__in")).drop("__cell", "__in", "__before")


def downsample(samples: DataFrame, max_pts: int) -> DataFrame:
    """The lowest and highest sample of each of ``max_pts`` equal slices of a
    signal: at most 2 * max_pts rows. Equal times and values are told apart by
    the sample's other fields. The first slices take what doesn't divide."""
    rows = numbered(samples, list(CATALOG), "timestamp_ns", ["timestamp_ns", "signal_value", "signal_str"])
    size, more = F.floor(F.col("__rows") / max_pts), F.col("__rows") % max_pts
    wide = more * (size + 1)
    bucket = F.when(F.col("__row") < wide, F.floor(F.col("__row") / (size + 1))).otherwise(more + F.floor((F.col("__row") - wide) / size))
    sliced = rows.select(*CATALOG, F.struct(*SAMPLE).alias("sample"), bucket.alias("bucket"))
    low, high = F.struct("sample.signal_value", "sample.timestamp_ns"), F.struct(F.col("sample.signal_value"), -F.col("sample.timestamp_ns"))
    ends = sliced.groupBy(*CATALOG, "bucket").agg(F.min_by("sample", low).alias("lo"), F.max_by("sample", high).alias("hi"))
    return ends.select(*CATALOG, F.inline(F.array("lo", "hi"))).orderBy(*CATALOG, "event_time", "timestamp_ns")


@dataclass
class Fetch:
    rows: DataFrame
    bounds: DataFrame
    widened: bool


def fetch_signals(gold: DataFrame, keys: list[Key], max_pts: int = 2000, files: list[str] | None = None, time_range: tuple[float, float] | None = None, extra_scope: dict[Key, list[str]] | None = None) -> Fetch:
    """Downsampled samples of ``keys``, with the bounds of all their samples.
    Where the time range hides a key that has samples outside, it is dropped."""
    chosen = gold.where(selection(keys, files, extra_scope))
    inside, widened = chosen, False
    if time_range:
        inside = chosen.where(F.col("timestamp_s").between(*time_range))
        here = {tuple(r) for r in inside.select(*CATALOG).distinct().collect()}  # the keys asked for
        if set(keys) - here:
            anywhere = {tuple(r) for r in chosen.select(*CATALOG).distinct().collect()}
            widened = bool(anywhere - here)
    return Fetch(downsample(chosen if widened else inside, max_pts), time_bounds(chosen), widened)


def unfetched(keys: DataFrame, fetched: DataFrame) -> DataFrame:
    return keys.join(fetched.select(*CATALOG).distinct(), CATALOG, "left_anti").agg(F.count(F.lit(1)).alias("n"))


def asof_nearest(left: DataFrame, right: DataFrame, on: str, value: str, by: list[str] | None = None, prefix: str = "right_") -> DataFrame:
    """Each left row with the right row nearest on ``on`` within ``by``; the
    earlier one where both are as near. Both sides are laid out on one time line,
    which is cut into stretches; the last and next right row are carried over each
    stretch, and from one to the others as a row per stretch. No pairs are formed
    and no task holds a whole line."""
    by = by or []
    other = F.struct(F.col(on), F.col(value))
    kept = [c for c in left.columns if c not in (*by, on)]
    a = left.select(*by, on, F.struct(*kept).alias("l"), F.lit(None).cast(right.select(other.alias("r")).schema["r"].dataType).alias("r"))
    b = right.where(F.col(value).isNotNull()).select(*by, on, F.lit(None).cast(a.schema["l"].dataType).alias("l"), other.alias("r"))
    line = stretched(a.unionByName(b), by, on)
    carried = F.last("r", ignorenulls=True)
    # the right rows at the ends of each stretch, carried over the stretches
    known = line.where("r is not null").groupBy(*by, "__cell").agg(F.max_by("r", on).alias("__last"), F.min_by("r", on).alias("__first"))
    cells = line.select(*by, "__cell").distinct()
    cells = _with_line(cells, known, by, ("__cell",))
    w = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "__cell", F.last("__last", ignorenulls=True).over(w.orderBy(F.col("__cell").asc())).alias("__from"), F.last("__first", ignorenulls=True).over(w.orderBy(F.col("__cell").desc())).alias("__to"))
    # both frames grow from one end: a frame to the far end is recomputed for every row
    w = Window.partitionBy(*by, "__cell")
    back = carried.over(w.orderBy(F.col(on).asc()).rangeBetween(Window.unboundedPreceding, 0))
    ahead = carried.over(w.orderBy(F.col(on).desc()).rangeBetween(Window.unboundedPreceding, 0))
    found = _with_line(line.withColumns({"__b": back, "__a": ahead}).where("l is not null"), cells, by, ("__cell",))
    found = found.withColumns({"__b": F.coalesce("__b", "__from"), "__a": F.coalesce("__a", "__to")})
    gap_b, gap_a = F.col(on) - F.col(f"__b.{on}"), F.col(f"__a.{on}") - F.col(on)
    near = F.when(F.col("__a").isNull() | (gap_b <= gap_a), F.col("__b")).otherwise(F.col("__a"))
    return found.withColumn("__n", near).select(*by, on, "l.*", F.col(f"__n.{on}").alias(prefix + on), F.col(f"__n.{value}").alias(prefix + value))


def wrap_lat(lat: Column) -> Column:
    """Into [-90, 90], over the poles."""
    turned = F.pmod(lat + 90, F.lit(360.0)) - 90
    return F.when(turned > 90, 180 - turned).otherwise(turned)


def wrap_lon(lon: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def gps_track(gold: DataFrame, lat: Key, lon: Key) -> DataFrame:
    """(_source_file, timestamp_ns, event_time, timestamp_s, lat, lon): each
    latitude with the nearest longitude of its file."""
    lats = gold.where(any_key([lat])).select("_source_file", "timestamp_ns", "event_time", "timestamp_s", F.col("signal_value").alias("lat"))
    lons = gold.where(any_key([lon])).select("_source_file", "timestamp_ns", F.col("signal_value").alias("lon"))
    met = asof_nearest(lats.where("lat is not null"), lons, "timestamp_ns", "lon", ["_source_file"])
    return met.where("right_lon is not null").select("_source_file", "timestamp_ns", "event_time", "timestamp_s", wrap_lat(F.col("lat")).alias("lat"), wrap_lon(F.col("right_lon")).alias("lon"))


def scale_traces(samples: DataFrame) -> DataFrame:
    """Adds ``scaled``: numeric traces on [-1, 1]; flat and categorical ones as
    they are."""
    w = Window.partitionBy(*CATALOG)
    low, high = F.min("signal_value").over(w), F.max("signal_value").over(w)
    text = F.max(F.col("signal_str").isNotNull()).over(w)
    plain = text | (low == high)
    return samples.withColumn("scaled", F.when(plain, F.col("signal_value")).otherwise(F.try_divide(F.col("signal_value") - (high + low) / 2, (high - low) / 2)))


def pivot_grid(samples: DataFrame, keys: list[Key]) -> DataFrame:
    """One row per position within the traces: the first trace's time and one
    column per trace. All positions are returned; who shows them cuts pages."""
    placed = numbered(samples.where(any_key(keys)), list(CATALOG), "timestamp_ns", ["timestamp_ns", "signal_value", "signal_str"])
    placed = placed.withColumn("position", (F.col("__row") + 1).cast("int"))

    def cell(k: Key) -> Column:
        shown = "ETH" if k[0] == "SOMEIP" else k[0]
        return F.max(F.when(any_key([k]), F.coalesce("signal_str", F.col("signal_value").cast("string")))).alias(f"{shown}{k[1]}::{k[2]}")

    time = F.max(F.when(any_key(keys[:1]), F.col("timestamp_s"))).alias("time")
    return placed.groupBy("position").agg(time, *(cell(k) for k in keys)).orderBy("position")


def per_file_ranges(gold: DataFrame, files: list[str], keys: list[Key] | None = None) -> DataFrame:
    rows = gold.where(F.col("_source_file").isin(files))
    rows = rows.where(any_key(keys)) if keys else rows
    return rows.groupBy(F.col("_source_file").alias("source_file")).agg(F.min("timestamp_s").alias("t_min"), F.max("timestamp_s").alias("t_max"), F.min("event_time").alias("t0"))


def playlist(gold: DataFrame, videos: DataFrame, files: list[str], keys: list[Key]) -> DataFrame:
    """Per file its video and span: that of the keys, else the whole file's; by
    start time, then file."""
    own, whole = per_file_ranges(gold, files, keys), per_file_ranges(gold, files)
    spans = whole.alias("w").join(own.alias("o"), "source_file", "left").select("source_file", *(F.coalesce(f"o.{c}", f"w.{c}").alias(c) for c in ("t_min", "t_max", "t0")))
    return match_videos(spans, videos).orderBy(F.col("t0").asc_nulls_last(), "source_file")


def match_videos(files: DataFrame, videos: DataFrame, column: str = "source_file") -> DataFrame:
    """Files with the video of the same stem (the first by path)."""
    first = videos.groupBy("_video_stem").agg(F.min("_video_path").alias("_video_path"), F.min_by("_video_mtime", "_video_path").alias("_video_mtime"))
    return files.join(first, file_stem(column) == F.col("_video_stem"), "left").drop("_video_stem")


def marker_times(markers: DataFrame, t0: str | None, t_min: float) -> DataFrame:
    """Adds ``x``: the marker's wall-clock time where the recording's is known,
    else NULL (plots then count seconds)."""
    start = F.lit(t0).cast("timestamp")
    micros = F.round((F.col("timestamp_s") - t_min) * 1e6).cast("long")
    return markers.withColumn("x", F.when(start.isNotNull(), F.timestamp_micros(F.unix_micros(start) + micros)))


def folders(files: DataFrame) -> DataFrame:
    """Files by folder."""
    folder = F.regexp_extract("_source_file", r"^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.array_sort(F.collect_list("_source_file")).alias("files")).orderBy("folder")


class ResultCache:
    """Results by session key, the least recently used one leaves first."""

    def __init__(self, most: int = 50):
        self.most, self.held = most, OrderedDict()

    def get(self, key):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        return None

    def put(self, key, value) -> None:
        self.held[key] = value
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            _, old = self.held.popitem(last=False)
            if isinstance(old, DataFrame):
                old.unpersist()
