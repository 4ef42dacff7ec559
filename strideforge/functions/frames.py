"""Projections of lines and frames: parsing, checksums, representations, centre of pressure. Column expressions only."""

from pyspark.sql import functions as F

from strideforge.schemas import CALIBRATION_CEILING, CENTRES_MM, CHANNELS, FULL_SCALE, LENGTH_MM, SATURATION_MARGIN

INTEGER = r"^\s*[+-]?\d+\s*$"


def _int(c):
    return F.when(c.rlike(INTEGER), F.trim(c).try_cast("bigint"))


def checksum(*cols):
    """Sum of the columns modulo 256, never negative."""
    total = F.lit(0).cast("bigint")
    for c in cols:
        total = total + F.col(c).cast("bigint")
    return F.pmod(total, F.lit(256))


def parse_frames(lines):
    """lines(session_id, line_no, value) with status, seq, ts_us and channels; the numbers are null unless status is valid.

    In this order a line is empty, a status line (#), malformed (fields, sync word, integers), of a bad checksum, malformed
    (a channel outside 0..4095), valid. Integers are plain decimals that fit 64 bits, blanks around them allowed.
    """
    v = F.regexp_replace(F.coalesce("value", F.lit("")), r"^\s+|\s+$", "")
    names = ["seq", "ts_us", *CHANNELS, "_check"]
    cells = [_int(F.get("_f", F.lit(i + 1))).alias(n) for i, n in enumerate(names)]
    framed = ((F.size("_f") == 10) & (F.get("_f", F.lit(0)) == "INS")).alias("_framed")
    rows = lines.withColumn("_v", v).withColumn("_f", F.split("_v", ","))
    # the numbers leave a generator, so that a filter on status cannot pull the splitting and matching into itself
    rows = rows.select(*lines.columns, F.substring("_v", 1, 1).alias("_v"), F.inline(F.array(F.struct(*cells, framed))))
    absent = F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1
    outside = F.greatest(*[(~F.col(c).between(0, FULL_SCALE)).cast("int") for c in CHANNELS]) == 1
    total = F.try_add("seq", "ts_us")
    for c in CHANNELS:
        total = F.try_add(total, F.col(c))
    status = (
        F.when(F.col("_v") == "", "empty")
        .when(F.col("_v") == "#", "status")
        .when(~F.col("_framed") | absent, "malformed")
        .when(F.coalesce(F.pmod(total, F.lit(256)), F.lit(-1)) != F.col("_check"), "bad_checksum")
        .when(outside, "malformed")
        .otherwise("valid")
    )
    rows = rows.withColumn("status", status)
    good = F.col("status") == "valid"
    types = {"seq": "int", "ts_us": "bigint"} | dict.fromkeys(CHANNELS, "int")
    return rows.withColumns({n: F.when(good, F.col(n)).try_cast(t) for n, t in types.items()}).drop("_v", "_framed", "_check")


def encode_frames(frames):
    """frames with value: the checksummed text line of each."""
    cols = ["seq", "ts_us", *CHANNELS]
    return frames.withColumn("value", F.concat_ws(",", F.lit("INS"), *cols, checksum(*cols)))


def parse_kv(lines):
    """Status and summary lines with a map of their k=v tokens."""
    tokens = F.filter(F.split(F.regexp_replace("value", r"^\s*#?\s*", ""), r"\s+"), lambda t: F.instr(t, "=") > 1)
    return lines.withColumn("kv", F.str_to_map(F.array_join(tokens, " "), F.lit(" "), F.lit("="))).filter(F.size(tokens) > 0)


def in_range(full_scale=FULL_SCALE):
    """All channels lie in 0..full_scale."""
    cond = F.lit(True)
    for c in CHANNELS:
        cond = cond & F.col(c).between(0, full_scale)
    return cond


def clean(frames, full_scale=FULL_SCALE):
    """Frames without those that have a channel outside the range (a null is outside)."""
    return frames.filter(F.coalesce(in_range(full_scale), F.lit(False)))


def total_force(channels=CHANNELS):
    return sum((F.col(c) for c in channels[1:]), F.col(channels[0]))


def conductance(c, full_scale=FULL_SCALE):
    """c / (full scale - c), null outside 0 < c < full scale."""
    if full_scale <= 0:
        raise ValueError("full scale must be positive")
    x = F.col(c).cast("double")
    return F.when((x > 0) & (x < full_scale), x / (full_scale - x))


def is_saturated(c, full_scale=FULL_SCALE, margin=SATURATION_MARGIN):
    return F.col(c) >= full_scale - margin


def conductance_capped(c, full_scale=FULL_SCALE):
    """Conductance with 0 at 0 and the value of full scale - 1 above it."""
    if full_scale <= 1:
        raise ValueError("full scale must exceed one")
    x = F.greatest(F.least(F.col(c), F.lit(full_scale - 1)), F.lit(0)).cast("double")
    return x / (full_scale - x)


def transform(frames, rep, gains=None, full_scale=FULL_SCALE):
    """Channels in a representation: raw, conductance or gain_matched (gains by channel number, 1 where none is given)."""
    if rep == "raw":
        return frames
    if rep == "conductance":
        return frames.withColumns({c: conductance_capped(c, full_scale) for c in CHANNELS})
    if rep == "gain_matched":
        gains = gains or {}
        return frames.withColumns({c: conductance_capped(c, full_scale) * float(gains.get(i, 1.0)) for i, c in enumerate(CHANNELS)})
    raise ValueError(f"unknown representation: {rep}")


def apply_gain_match(frames, gains, full_scale=FULL_SCALE, margin=SATURATION_MARGIN):
    """Columns g0..g5: gain times conductance; null without a gain, at saturation, or at zero."""
    def one(i, c):
        if gains.get(i) is None:
            return F.lit(None).cast("double")
        return F.when(~is_saturated(c, full_scale, margin), conductance(c, full_scale) * float(gains[i]))

    return frames.withColumns({f"g{i}": one(i, c) for i, c in enumerate(CHANNELS)})


def apply_calibration(frames, fits, extrapolate=True, clamp=False, full_scale=FULL_SCALE, margin=SATURATION_MARGIN):
    """Columns f0..f5 in newtons by fits[i] = (a, b, flag, x_min, x_max); null where the fit or the count allows none."""
    def one(i, c):
        fit = fits.get(i)
        if fit is None or fit["flag"] not in ("ok", "poor_fit"):
            return F.lit(None).cast("double")
        x = F.when(~is_saturated(c, full_scale, margin), conductance(c, full_scale))
        force = fit["a"] * x + fit["b"]
        if not extrapolate:
            force = F.when(x.between(fit["x_min"], fit["x_max"]), force)
        return F.when(force < 0, 0.0).otherwise(force) if clamp else force

    return frames.withColumns({f"f{i}": one(i, c) for i, c in enumerate(CHANNELS)})


def grams_to_newtons(grams, g=9.80665):
    return F.col(grams) / 1000.0 * g


def interval_force(low, high, g=9.81):
    """Mean force of a reading between low and high grams, and the deviation of a uniform spread."""
    return (F.col(low) + F.col(high)) / 2000.0 * g, (F.col(high) - F.col(low)) / 1000.0 * g / (12**0.5)


def centre(axis, channels=CHANNELS, centres=CENTRES_MM):
    """Coordinate of the centre of pressure, in units of the foot's length; null for an empty frame."""
    total = total_force(channels).cast("double")
    weighted = sum((F.col(c) * (centres[i][axis] / LENGTH_MM) for i, c in enumerate(channels)), F.lit(0.0))
    return F.when(total != 0, weighted / total)


def cop(frames, channels=CHANNELS, names=("cop_x", "cop_y")):
    return frames.withColumns({n: centre(i, channels) for i, n in enumerate(names)})


def frame_flags(frames, ceiling=CALIBRATION_CEILING):
    return frames.withColumns(
        {"extrapolating": F.greatest(*CHANNELS) > ceiling, "s4_zero": F.col("s4") == 0, "all_zero": F.greatest(*CHANNELS) == 0}
    )


def resolve_representation(meta, gains=None):
    """The representation that a model names; refused when absent, unknown, or gain matched without gains."""
    rep = (meta or {}).get("representation")
    if rep not in ("raw", "conductance", "gain_matched"):
        raise ValueError(f"the model names no known representation: {rep!r}")
    if rep == "gain_matched" and not gains:
        raise ValueError("the model needs gains and none are given")
    return rep
