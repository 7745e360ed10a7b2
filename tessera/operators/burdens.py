"""Burdens that a claim leaves out: which a text hints at, which measurements are missing for them, and how grave that is.

A family of claims admits some burdens only (FAMILY_BURDENS; unclear admits all). The measurement matrix is one of them:
an efficiency told without the other metrics it would have to be compared by. Text of low trust is looked at for
contamination and for the matrix only, and asks for the body's own text.

Covered are the main path and that of low trust. Captions, tables and stable references, and the prose that explains each
burden, are not.

Defined results: text is compared in lower case with white space run together; null text counts as empty, a null family as
unclear, a null trust as trusted; numbers that do not parse count as not told. Rows stay one by one, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rules import first_match, signals
from tessera.functions.text import squeeze

CONTAMINATION, MATRIX = "contamination_tax", "measurement_matrix_tax"
# What hints at a burden, as parts of a text.
HINTS: dict[str, tuple[str, ...]] = {
    "solvent_management_tax": ("electrolyte", "solvent", "donor", "additive", "water", "li salt", "lithium salt", "thf"),
    "resistance_or_renewal_tax": ("sei", "interphase", "passivation", "resistance", "impedance", "renewal"),
    "wetting_outlet_capture_tax": ("flow", "gde", "ssc", "gas diffusion", "outlet", "flooding", "wetting", "capture"),
    "hydrogen_logistics_tax": (" hor", "hydrogen oxidation", " h2 ", "h2,", "h2.", "h2 feed", "proton economy"),
    CONTAMINATION: ("contamination", "nox", "nitrate", "nitrite", "background ammonia", "false positive", "impurity"),
}
# What to measure for a burden; the matrix asks for its missing metrics.
MEASUREMENTS: dict[str, tuple[str, ...]] = {
    "solvent_management_tax": ("solvent inventory", "electrolyte replacement or recycle", "donor/additive consumption"),
    "resistance_or_renewal_tax": ("impedance over runtime", "renewal schedule", "passivation or failure onset"),
    "wetting_outlet_capture_tax": ("outlet product state", "gas/liquid product split", "wetting or flooding diagnosis", "capture efficiency"),
    "hydrogen_logistics_tax": ("hydrogen source boundary", "H2 consumption", "HOR-off control"),
    CONTAMINATION: ("NOx/nitrate/nitrite screen", "background ammonia", "blank controls"),
}
# The matrix' metrics and the parts of a text that tell of them.
METRICS: dict[str, tuple[str, ...]] = {
    "NH3 yield": ("nh3 yield", "ammonia yield", "yield rate", "production rate"),
    "energy efficiency": ("energy efficiency", " ee "),
    "voltage or potential": ("potential", "voltage", " v vs", "vvs", "two-electrode"),
    "current density": ("current density", " ma cm", "ma/cm"),
    "runtime or stability": ("runtime", "stability", "hours", "electrolysis"),
    "product state": ("gas-phase ammonia", "gas phase ammonia", "aqueous ammonia", "aqueous nh3", "nh4+", "ammonium", "acid trap", "outlet"),
}
# What, besides metrics, makes a text of low trust one on performance.
PERFORMANCE = ("faradaic", "nh3", "ammonia", "yield", "selectivity", "energy efficiency", "ma cm", "ma/cm", "%")
# The burdens of each family.
_BOTH = (CONTAMINATION, MATRIX)
FAMILY_BURDENS: dict[str, tuple[str, ...]] = {"eNRR": _BOTH, "LiNRR": (*HINTS, MATRIX), "NO3RR": _BOTH, "NO2RR": _BOTH, "NORR": _BOTH, "mixed": _BOTH}
# What a text of low trust always lacks; the efficiency and the number of burdens that are grave.
BODY = "primary_body_text_required"
GRAVE_EFFICIENCY, MANY = 50.0, 3
UNCLEAR = "unclear"


def _hints(text: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def with_burdens(df: DataFrame, text: str, efficiency: str | None = None, told: Mapping[str, Sequence[str]] | None = None, family: str | None = None, low_trust: str | None = None, families: Mapping[str, Sequence[str]] = FAMILY_BURDENS) -> DataFrame:
    """`df` with burdens, missing_measurements (both arrays in the order of the tables here) and severity (low, medium, high).

    `told`: for a metric the columns that hold its number; for the product state, any value counts. `efficiency`: the column
    of its number. A family that `families` lacks admits no burdens.
    """
    # A column of its own: an expression would be worked out anew for nearly each of the hints.
    df = df.withColumn("_body", F.lower(squeeze(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    body = F.col("_body")
    number = F.col(efficiency).cast("string").try_cast("double") if efficiency else F.lit(None).cast("double")
    in_text = body.rlike(r"\b(?:faradaic efficiency|fe)\b") & (body.contains("%") | body.contains("percent"))
    has_efficiency = number.isNotNull() | in_text

    def has(metric: str) -> Column:
        found = _hints(body, METRICS[metric])
        for name in (told or {}).get(metric, ()):
            value = F.col(name).cast("string")
            found = found | (F.trim(value) != "" if metric == "product state" else value.try_cast("double").isNotNull())
        return F.coalesce(found, F.lit(False))

    kind = F.coalesce(F.col(family), F.lit(UNCLEAR)) if family else F.lit(UNCLEAR)
    doubtful = F.coalesce(F.col(low_trust), F.lit(False)) if low_trust else F.lit(False)
    known = {name: has(name) for name in METRICS}
    lacking = signals({name: ~found for name, found in known.items()})
    # Whatever of the matrix a text of low trust tells, it is no complete one.
    performs = has_efficiency | _hints(body, PERFORMANCE)
    for name in ("NH3 yield", "voltage or potential", "current density", "runtime or stability"):
        performs = performs | known[name]

    def holds(burden: str) -> Column:
        admitted = kind.isin(UNCLEAR, *(f for f, own in families.items() if burden in own))
        if burden == MATRIX:
            return F.when(doubtful, performs).otherwise(admitted & has_efficiency & (F.size(lacking) > 0))
        hinted = _hints(body, HINTS[burden])
        return F.when(doubtful, hinted if burden == CONTAMINATION else F.lit(False)).otherwise(admitted & hinted)

    burdens = F.col("burdens")
    wanted = [F.when(F.array_contains(burdens, b), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for b, names in MEASUREMENTS.items()]
    wanted.append(F.when(F.array_contains(burdens, MATRIX), lacking).otherwise(F.array().cast("array<string>")))
    n, matrix, contaminated = F.size(burdens), F.array_contains(burdens, MATRIX), F.array_contains(burdens, CONTAMINATION)
    grave = (matrix & F.coalesce(number >= GRAVE_EFFICIENCY, F.lit(False))) | (contaminated & matrix) | (n >= MANY)
    severity = first_match([("low", n == 0), ("high", F.when(doubtful, contaminated).otherwise(grave))], "medium")
    found = df.withColumn("burdens", signals({b: holds(b) for b in (*HINTS, MATRIX)}))
    wanted.insert(0, F.when(doubtful, F.array(F.lit(BODY))).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("missing_measurements", F.array_distinct(F.concat(*wanted))).withColumn("severity", severity)
    return found.drop("_body")
