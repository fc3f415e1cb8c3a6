"""Position sentences (AIVDM) as columns: checksum, fragments, six-bit payload, message fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import geo


def checksum_ok(line: str) -> Column:
    """Exclusive-or of the characters between the first sign and the star equals the hexadecimal after it."""
    body = F.substring_index(F.substring(F.col(line), 2, 100_000), "*", 1)
    xor = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), lambda i: F.ascii(F.substr(body, i, F.lit(1)))), F.lit(0), lambda a, b: a.bitwiseXOR(b))
    return F.coalesce(F.upper(F.substring(F.substring_index(F.col(line), "*", -1), 1, 2)) == F.lpad(F.hex(xor.cast("long")), 2, "0"), F.lit(False))


def sentences(lines: DataFrame, line: str = "line") -> DataFrame:
    """Parsed sentences: ok, n_parts, part, seq, channel, payload."""
    f = F.split(F.substring_index(F.col(line), "*", 1), ",")
    shape = F.col(line).rlike(r"^[!$][A-Z]{5},\d,\d,\d?,[AB]?,[^,]*,\d\*[0-9A-Fa-f]{2}")
    return lines.select(
        "*", (shape & checksum_ok(line)).alias("ok"), F.get(f, F.lit(1)).cast("int").alias("n_parts"), F.get(f, F.lit(2)).cast("int").alias("part"), F.get(f, F.lit(3)).alias("seq"), F.get(f, F.lit(4)).alias("channel"), F.get(f, F.lit(5)).alias("payload")
    )


def assembled(parsed: DataFrame, ts: str = "ts", window_s: int = 60) -> DataFrame:
    """Whole payloads: single sentences, and fragments of one sequence and channel whose first part is at most window_s old.

    A first part begins a message, wherever minutes end; later parts join the latest one begun. Repeated parts count once.
    """
    ok = parsed.filter("ok")
    whole = ok.filter("n_parts = 1").select(ts, "channel", "payload")
    w = Window.partitionBy("seq", "channel", "n_parts", "_day").orderBy(ts, "part")
    # A message may straddle midnight: its parts are looked for on both days, and the first part's day keeps it.
    at = F.unix_timestamp(F.col(ts).cast("timestamp"))
    days = F.array_distinct(F.array(F.floor(at / 86_400), F.floor((at - window_s) / 86_400)))
    parts = ok.filter("n_parts > 1").withColumn("_at", at).withColumn("_day", F.explode(days))
    parts = parts.withColumn("_first", F.last(F.when(F.col("part") == 1, F.struct(F.col("_at").alias("t"), F.col("payload").alias("i"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    live = parts.filter((F.col("_at") - F.col("_first.t") <= window_s) & (F.floor(F.col("_first.t") / 86_400) == F.col("_day")))
    joined = live.groupBy("_first", "_day", "seq", "channel", "n_parts").agg(F.count_distinct("part").alias("k"), F.min(ts).alias(ts), F.array_sort(F.collect_set(F.struct("part", "payload"))).alias("p"))
    joined = joined.filter("n_parts = k").select(ts, "channel", F.array_join(F.col("p.payload"), "").alias("payload"))
    return whole.unionByName(joined)


def bits(payload: str) -> Column:
    """The payload as a text of bits, six a character."""
    code = lambda ch: F.ascii(ch) - 48 - F.when(F.ascii(ch) > 88, 8).otherwise(0)
    return F.array_join(F.transform(F.filter(F.split(F.col(payload), ""), lambda ch: ch != ""), lambda ch: F.lpad(F.bin(code(ch).cast("long")), 6, "0")), "")


def unsigned(b: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(b, start + 1, n), 2, 10).cast("long")


def signed(b: Column, start: int, n: int) -> Column:
    v = unsigned(b, start, n)
    return F.when(v >= 1 << (n - 1), v - (1 << n)).otherwise(v)


def positions(payloads: DataFrame) -> DataFrame:
    """Reports of types 1, 2, 3 and 18 with sentinels nulled; those without a place are dropped."""
    b = payloads.withColumn("b", bits("payload"))
    kind = unsigned(F.col("b"), 0, 6)
    rows = b.withColumn("msg_type", kind).filter(F.col("msg_type").isin(1, 2, 3, 18))
    at = lambda one, other: F.when(F.col("msg_type") == 18, F.lit(other)).otherwise(F.lit(one))  # noqa: E731,F841
    pick = lambda f, one, other, n: F.when(F.col("msg_type") == 18, f(F.col("b"), other, n)).otherwise(f(F.col("b"), one, n))
    rows = rows.select(
        "ts", "msg_type", unsigned(F.col("b"), 8, 30).alias("mmsi"), geo.nulled(pick(signed, 89, 85, 27) / 600_000.0, "lat", 1e-6).alias("lat"), geo.nulled(pick(signed, 61, 57, 28) / 600_000.0, "lon", 1e-6).alias("lon"),
        geo.nulled(pick(unsigned, 50, 46, 10) / 10.0, "sog").alias("sog"), geo.nulled(pick(unsigned, 116, 112, 12) / 10.0, "cog").alias("cog"), geo.nulled(pick(unsigned, 128, 124, 9).cast("double"), "heading").alias("heading"),
    )
    return rows.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def from_json(lines: DataFrame, column: str = "line") -> DataFrame:
    """Reports from JSON with any of the usual field names."""
    names = {"mmsi": ("mmsi", "MMSI", "userid"), "lat": ("lat", "latitude", "LAT"), "lon": ("lon", "lng", "longitude", "LON"), "sog": ("sog", "speed", "SOG"), "cog": ("cog", "course", "COG"), "ts": ("ts", "timestamp", "BaseDateTime")}
    pick = lambda c: F.coalesce(*(F.get_json_object(F.col(column), f"$.{n}") for n in names[c]))
    out = lines.select(*(pick(c).cast("timestamp" if c == "ts" else "long" if c == "mmsi" else "double").alias(c) for c in names))
    return out.withColumns({c: geo.nulled(c, c) for c in ("lat", "lon", "sog", "cog")}).filter("lat is not null and lon is not null")


def text(b: Column, start: int, n: int) -> Column:
    """Six-bit characters as text; padding goes, and an empty text is null."""
    codes = F.transform(F.sequence(F.lit(start), F.lit(start + n - 6), F.lit(6)), lambda i: F.conv(F.substr(b, i + 1, F.lit(6)), 2, 10).cast("int"))
    chars = F.transform(codes, lambda c: F.char(F.when(c < 32, c + 64).otherwise(c)))
    out = F.trim(F.replace(F.array_join(chars, ""), F.lit("@"), F.lit("")))
    return F.when(out != "", out)


def static_reports(payloads: DataFrame) -> DataFrame:
    """Voyage reports (type 5, at least 420 bits): identity, number, call sign, name, type and length."""
    b = payloads.withColumn("b", bits("payload")).filter((unsigned(F.col("b"), 0, 6) == 5) & (F.length("b") >= 420))
    u = lambda start, n: unsigned(F.col("b"), start, n)
    return b.select(
        "ts", u(8, 30).alias("mmsi"), F.when(u(40, 30) > 0, u(40, 30)).alias("imo"), text(F.col("b"), 70, 42).alias("call_sign"), text(F.col("b"), 112, 120).alias("name"), u(232, 8).alias("ship_type"),
        F.when(u(240, 9) + u(249, 9) > 0, u(240, 9) + u(249, 9)).alias("length_m"),
    )
