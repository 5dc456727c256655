"""Dimension tables: channel metadata, label hierarchy, phases, severities.

These are the small lookup tables every plan joins against.  They have a
fixed, data-independent size, which is what makes broadcasting them safe.
The same code runs on the real sensor schema and on the test-table
mappings: operators take a ``ChannelSet`` rather than hard-coded names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Sensor channel order (23 raw sensors, snake_case names), clip bounds,
# channel sets, descriptions, groups, label -> hierarchy map, phase weights,
# severity cut-offs and texts.
# --------------------------------------------------------------------------

RAW_SENSORS = [
    "volt1", "volt2", "amp1", "amp2",
    "fqty_l", "fqty_r", "e1_fflow",
    "e1_oilt", "e1_oilp", "e1_rpm",
    "e1_cht1", "e1_cht2", "e1_cht3", "e1_cht4",
    "e1_egt1", "e1_egt2", "e1_egt3", "e1_egt4",
    "oat", "ias", "vspd", "normac", "altmsl",
]

DERIVED_CHANNELS = [
    "cht_spread", "cht_mean", "cht4_minus_cht1",
    "egt_spread", "egt_mean", "egt_cht_divergence",
    "fqty_imbalance", "is_cruise",
]

ALL_CHANNELS = RAW_SENSORS + DERIVED_CHANNELS

CLIP_BOUNDS = {
    "volt1": (0, 35),
    "volt2": (0, 35),
    "amp1": (-100, 150),
    "amp2": (-50, 50),
    "fqty_l": (0, 35),
    "fqty_r": (0, 35),
    "e1_fflow": (0, 20),
    "e1_oilt": (0, 300),
    "e1_oilp": (0, 115),
    "e1_rpm": (0, 2800),
    "e1_cht1": (0, 500),
    "e1_cht2": (0, 500),
    "e1_cht3": (0, 500),
    "e1_cht4": (0, 500),
    "e1_egt1": (0, 1800),
    "e1_egt2": (0, 1800),
    "e1_egt3": (0, 1800),
    "e1_egt4": (0, 1800),
    "oat": (-60, 60),
    "ias": (0, 163),
    "vspd": (-3000, 3000),
    "normac": (-5, 5),
    "altmsl": (-500, 20000),
}

SKIP_CHANNELS = {"is_cruise", "volt2"}

MAINTENANCE_CHANNELS = {
    "e1_oilt", "e1_oilp", "e1_rpm",
    "e1_cht1", "e1_cht2", "e1_cht3", "e1_cht4",
    "e1_egt1", "e1_egt2", "e1_egt3", "e1_egt4",
    "e1_fflow", "fqty_l", "fqty_r",
    "cht_spread", "cht_mean", "cht4_minus_cht1",
    "egt_spread", "egt_mean", "egt_cht_divergence",
    "fqty_imbalance",
}

PILOT_CHANNELS = {"normac", "vspd", "ias", "altmsl", "oat", "volt1", "amp1", "amp2"}

# The 16 sensors of the fleet and single-flight reports, in display order.
DISPLAY_CHANNELS = [
    "e1_oilt", "e1_oilp", "e1_rpm",
    "e1_cht1", "e1_cht2", "e1_cht3", "e1_cht4",
    "e1_egt1", "e1_egt2", "e1_egt3", "e1_egt4",
    "e1_fflow", "cht_spread", "egt_spread",
    "egt_cht_divergence", "fqty_imbalance",
]

DESCRIPTIONS = {
    "e1_oilt": "Engine oil temperature",
    "e1_oilp": "Engine oil pressure",
    "e1_rpm": "Engine RPM",
    "e1_cht1": "Cylinder 1 head temperature",
    "e1_cht2": "Cylinder 2 head temperature",
    "e1_cht3": "Cylinder 3 head temperature",
    "e1_cht4": "Cylinder 4 head temperature",
    "e1_egt1": "Cylinder 1 exhaust temperature",
    "e1_egt2": "Cylinder 2 exhaust temperature",
    "e1_egt3": "Cylinder 3 exhaust temperature",
    "e1_egt4": "Cylinder 4 exhaust temperature",
    "e1_fflow": "Fuel flow rate",
    "fqty_l": "Left fuel tank quantity",
    "fqty_r": "Right fuel tank quantity",
    "volt1": "Main bus voltage",
    "amp1": "Main battery current",
    "cht_spread": "Cylinder temperature spread",
    "cht_mean": "Average cylinder temperature",
    "cht4_minus_cht1": "Cylinder temperature gradient",
    "egt_spread": "Exhaust temperature spread",
    "egt_mean": "Average exhaust temperature",
    "egt_cht_divergence": "Exhaust-cylinder temp divergence",
    "fqty_imbalance": "Fuel tank imbalance",
    "oat": "Outside air temperature",
    "ias": "Indicated airspeed",
    "altmsl": "Altitude MSL",
}

SENSOR_GROUPS = {
    "engine": {"e1_oilt", "e1_oilp", "e1_rpm"},
    "cylinder": {"e1_cht1", "e1_cht2", "e1_cht3", "e1_cht4",
                 "cht_spread", "cht_mean", "cht4_minus_cht1"},
    "combustion": {"e1_egt1", "e1_egt2", "e1_egt3", "e1_egt4",
                   "egt_spread", "egt_mean", "egt_cht_divergence"},
    "fuel": {"e1_fflow", "fqty_l", "fqty_r", "fqty_imbalance"},
}

LABEL_HIERARCHY = {
    "baffle crack/damage/loose/miss": "baffle",
    "baffle plug need repair/replace": "baffle",
    "baffle screw miss/loose": "baffle",
    "baffle seal loose/damage": "baffle",
    "baffle tie/tie rod loose or damage": "baffle",
    "baffle rivet loose/miss/damage": "baffle",
    "baffle spring damage": "baffle",
    "baffle mount loose/damage": "baffle",
    "baffle bracket loose/damage": "baffle",
    "engine run rough": "engine",
    "engine failure/fire/time out": "engine",
    "engine idle/rpm issue": "engine",
    "engine need repair/reinstall/clean": "engine",
    "engine seal/tube/bolt loose or damage": "engine",
    "engine/propeller overspeed or damage": "engine",
    "engine crankcase/crankshaft/firewall near repair": "engine",
    "intake gasket leak/damage": "engine",
    "intake tube/bolt/seal/boot loose or damage": "engine",
    "induction damage/hardware fail": "engine",
    "magneto failure": "engine",
    "spark plug need repair/replace": "engine",
    "mixture fail/need adjust": "engine",
    "aircraft start/external issue": "engine",
    "cylinder compression issue": "cylinder",
    "cylinder crack/fail/need part repair": "cylinder",
    "cylinder/exhaust push rod/tube damage": "cylinder",
    "cylinder head/exhaust gas temperature issue": "cylinder",
    "cylinder exhaust valve/stuck valve issue": "cylinder",
    "rocker cover leak/loose/damage": "cylinder",
    "oil cooler need maintenance": "oil",
    "oil leak/pressure issue": "oil",
    "oil return line issue": "oil",
    "oil dipstick/tube need repair": "oil",
    "cowling miss/loose/damage": "other",
    "drain line/tube damage": "other",
    "pilot/in-flight noticed issue": "other",
}

# phase name, order, weight (the order is the phase code 0..3)
PHASES = [("taxi", 0, 0.5), ("takeoff", 1, 1.0), ("cruise", 2, 2.0), ("descent", 3, 1.0)]

# Phase limits on normalised IAS / AltMSL (raw 70 kts / 1500 ft / 30 kts / 500 ft).
CRUISE_IAS_NORM = 0.531
CRUISE_ALT_NORM = -0.277
TAXI_IAS_NORM = -0.407
TAXI_ALT_NORM = -0.899

# Raw cruise flag limits (derived channel is_cruise).
CRUISE_IAS_MIN = 70.0
CRUISE_ALT_MIN = 1500.0

# severity, lower probability bound, message
SEVERITIES = [
    ("CRITICAL", 0.80, "Ground aircraft immediately — critical maintenance required"),
    ("HIGH", 0.60, "Inspect before next flight — high risk detected"),
    ("MEDIUM", 0.40, "Monitor closely — elevated maintenance risk"),
    ("NORMAL", None, "Aircraft appears airworthy — no immediate action required"),
]

# Summary templates; %s is the probability formatted as '%.1f'.
SUMMARY_TEMPLATES = {
    "CRITICAL": "CRITICAL ALERT: Aircraft shows %s%% probability of maintenance within 2 days. "
                "Immediate grounding recommended.",
    "HIGH": "HIGH RISK: %s%% maintenance probability detected. Inspect before next flight.",
    "MEDIUM": "ELEVATED RISK: %s%% maintenance probability. Monitor closely.",
    "NORMAL": "Aircraft appears airworthy. %s%% maintenance probability — below alert threshold.",
}

GROUP_INSIGHTS = [
    ("engine", "Engine oil system parameters show unusual patterns — check oil level and pressure."),
    ("cylinder", "Cylinder temperature patterns suggest potential compression or cooling issue — "
                 "inspect cylinder heads."),
    ("combustion", "Exhaust temperature imbalance detected — possible intake gasket or fuel mixture issue."),
    ("fuel", "Fuel system anomaly detected — check fuel flow and tank balance."),
]

CRITICAL_ACTION_PREFIX = "Ground aircraft immediately. Do not fly until full inspection completed. Priority: "
CRITICAL_PRIORITY = [("engine", "engine/oil system"), ("cylinder", "cylinder/exhaust system"),
                     ("fuel", "fuel system")]
CRITICAL_FALLBACK = "full system check"
HIGH_ACTION_PREFIX = "Complete pre-flight inspection before next flight. Focus on: "
HIGH_PRIORITY = [("engine", "oil level, pressure, and temperature"),
                 ("cylinder", "cylinder compression and cooling"),
                 ("fuel", "fuel system and flow")]
HIGH_FALLBACK = "full visual inspection"
MEDIUM_ACTION = "Monitor for next 2 flights. Log any unusual sounds or performance changes."
NORMAL_ACTION = "Continue normal operations. Schedule routine maintenance as planned."

# Detector and report parameters (defaults of the reference code).
Z_THRESHOLD = 2.5
MIN_PHASE_ROWS = 30
PERSISTENCE = 0.05
STD_FLOOR = 1e-6
LOCAL_Z_THRESHOLD = 2.5
LOCAL_SHARE = 0.03
DECISION_THRESHOLD = 0.35
N_TIMESTEPS = 4096
MIN_FLIGHT_ROWS = 10
MIN_FLIGHT_LENGTH = 1800.0
ENDURANCE_LIMIT = 19800.0
RUL_THRESHOLD = -2
DATE_DIFF_LIMIT = 30
PSI_BINS = 10
PSI_EPSILON = 1e-6
DRIFT_THRESHOLD = 0.2
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Channel:
    name: str
    description: str | None = None
    maintenance: bool = False
    pilot: bool = False
    skip: bool = False
    display: bool = False
    group: str | None = None
    clip: tuple | None = None


@dataclass(frozen=True)
class ChannelSet:
    """Ordered channel metadata; the position is the channel index."""
    channels: tuple = field(default_factory=tuple)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.channels]

    def select(self, pred) -> list[str]:
        return [c.name for c in self.channels if pred(c)]

    @property
    def scored(self) -> list[str]:
        """Channels that get a z-score (not in the skip set)."""
        return self.select(lambda c: not c.skip)

    def index(self, name: str) -> int:
        return self.names.index(name)


def _group_of(name: str) -> str | None:
    for g, members in SENSOR_GROUPS.items():
        if name in members:
            return g
    return None


def default_channels() -> ChannelSet:
    return ChannelSet(tuple(
        Channel(name=n, description=DESCRIPTIONS.get(n), maintenance=n in MAINTENANCE_CHANNELS,
                pilot=n in PILOT_CHANNELS, skip=n in SKIP_CHANNELS, display=n in DISPLAY_CHANNELS,
                group=_group_of(n), clip=CLIP_BOUNDS.get(n))
        for n in ALL_CHANNELS))


@dataclass(frozen=True)
class PhaseSpec:
    """Phase limits on two channels (airspeed-like and altitude-like)."""
    ias: str = "ias"
    alt: str = "altmsl"
    cruise_ias: float = CRUISE_IAS_NORM
    cruise_alt: float = CRUISE_ALT_NORM
    taxi_ias: float = TAXI_IAS_NORM
    taxi_alt: float = TAXI_ALT_NORM


CHANNEL_DIM_SCHEMA = T.StructType([
    T.StructField("channel", T.StringType(), False),
    T.StructField("idx", T.IntegerType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("is_maintenance", T.BooleanType(), False),
    T.StructField("is_pilot", T.BooleanType(), False),
    T.StructField("is_skip", T.BooleanType(), False),
    T.StructField("is_display", T.BooleanType(), False),
    T.StructField("sensor_group", T.StringType(), True),
    T.StructField("clip_lo", T.DoubleType(), True),
    T.StructField("clip_hi", T.DoubleType(), True),
])


def channel_dim(spark: SparkSession, channels: ChannelSet) -> DataFrame:
    rows = [(c.name, i, c.description, c.maintenance, c.pilot, c.skip, c.display, c.group,
             None if c.clip is None else float(c.clip[0]), None if c.clip is None else float(c.clip[1]))
            for i, c in enumerate(channels.channels)]
    return spark.createDataFrame(rows, CHANNEL_DIM_SCHEMA)


def label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LABEL_HIERARCHY.items()), "label string, dim_hierarchy string")


def phase_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHASES, "phase string, phase_ord int, weight double")


def severity_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, i, lo, msg) for i, (s, lo, msg) in enumerate(SEVERITIES)]
    return spark.createDataFrame(rows, "severity string, severity_ord int, min_prob double, message string")
