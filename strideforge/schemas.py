"""Table schemas and constants of the sensor jobs."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# Fixed values of the device and of the detector; every operator takes them as defaults of its parameters.
CHANNELS = ["s0", "s1", "s2", "s3", "s4", "s5"]
T_ON, T_OFF, MIN_DURATION, MAX_DURATION, GAP_MERGE = 1200, 450, 15, 200, 12
LENGTH_MM, WIDTH_MM = 274.0, 91.0
CENTRES_MM = [(33.0, 50.8), (50.8, 50.8), (76.2, 152.4), (81.3, 185.4), (25.4, 203.2), (25.4, 254.0)]
FRAME_PERIOD_US, TIMING_TOLERANCE_US, BLE_LOSS_LIMIT, STALL_S = 10_000, 3_000, 2.0, 3.0
FULL_SCALE, SATURATION_MARGIN, CALIBRATION_CEILING = 4095, 25, 824
FLAT_RANGE, MIN_R2, MIN_POINTS = 100, 0.90, 3
SETTLE_S, MIN_STEADY = 1.0, 20
REST_MIN, FORCE_RANGE = 35.0, (11.4, 12.1)
TRAIN_FRACTION, REPEATS, BLOCKS, SEED = 0.6, 20, 5, 0
RANK_TOLERANCE, WILSON_Z = 1e-4, 1.96
G_CALIBRATION, G_SCALE = 9.80665, 9.81
FORCE_FEATURES = ["peak_counts", "time_to_peak_s", "contact_time_s", "loading_rate_cps", "impulse_counts_s"]
COP_FEATURES = ["cop_path_len", "cop_displacement"]
FEATURES = FORCE_FEATURES + COP_FEATURES


def struct(**fields):
    return StructType([StructField(k, v) for k, v in fields.items()])


_counts = {c: IntegerType() for c in CHANNELS}
LINES = struct(session_id=StringType(), line_no=LongType(), value=StringType())
CAPTURE_CSV = struct(seq=IntegerType(), ts_us=LongType(), **_counts)
FRAMES = struct(session_id=StringType(), frame_idx=LongType(), seq=IntegerType(), ts_us=LongType(), **_counts)
CHUNKS = struct(session_id=StringType(), chunk_no=LongType(), bytes=StringType())
MANIFEST = struct(
    sensor=IntegerType(), trial=IntegerType(), csv_path=StringType(), g_min=DoubleType(), g_max=DoubleType(),
    force_n=DoubleType(), sigma_force_n=DoubleType(), n_samples=IntegerType(), count_mean=DoubleType(),
    count_sd=DoubleType(), saturated_frac=DoubleType(), timestamp_iso=TimestampType(),
)
MODEL = struct(
    kind=StringType(), classes=ArrayType(StringType()), means=ArrayType(ArrayType(DoubleType())),
    priors=ArrayType(DoubleType()), counts=ArrayType(LongType()), cov=ArrayType(ArrayType(DoubleType())),
    covs=ArrayType(ArrayType(ArrayType(DoubleType()))), meta=MapType(StringType(), StringType()),
)
GAIN_MATCH = struct(
    kind=StringType(), k=MapType(StringType(), DoubleType()), corrections=MapType(StringType(), DoubleType()),
    full_scale=IntegerType(),
)
CALIBRATION = struct(
    sensor=IntegerType(), a=DoubleType(), b=DoubleType(), r2=DoubleType(), flag=StringType(), n_points=LongType(),
    x_min=DoubleType(), x_max=DoubleType(),
)
