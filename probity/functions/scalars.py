"""Scalar functions of the integrity analytics, as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Severities in ascending order and their weights.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY_WEIGHT = {"INFO": 0.05, "LOW": 0.2, "MEDIUM": 0.45, "HIGH": 0.75, "CRITICAL": 0.95}
#: Failure categories of records, the most telling first.
FAILURE_PRIORITY = (
    "FORGED_RECORD", "TAMPERED_OUTPUT", "TAMPERED_RECORD", "TAMPERED_CONFIG", "REPLAY",
    "MODEL_MISMATCH", "INPUT_MISMATCH", "REEXEC_MISMATCH", "CHAIN_BROKEN",
)
#: Event types that are conclusions rather than observations.
DERIVED_EVENTS = (
    "finding.", "evidence.", "case.created", "assurance.dataset_checked", "assurance.model_checked",
    "assurance.inference_verified", "assurance.shift_assessed", "assurance.run_completed",
)
GENESIS = "0" * 64
#: The names of a 4 by 4 grid's rows and columns.
REGION_ROWS, REGION_COLUMNS = ("top", "upper-middle", "lower-middle", "bottom"), ("left", "centre-left", "centre-right", "right")


def source_key(contributor: Column, batch: Column) -> Column:
    return F.concat_ws("/", F.coalesce(contributor, F.lit("unknown")), F.coalesce(batch, F.lit("unknown")))


def severity_rank(severity: Column) -> Column:
    """0 to 4 in the order of severities, never alphabetical; null for other values."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1
    return F.when(rank >= 0, rank)


def severity_name(rank: Column) -> Column:
    # A null index is kept out of element_at: compiled code would take it for the last place.
    return F.when(rank.isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.coalesce(rank + 1, F.lit(1)).cast("int")))


def severity_weight(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY_WEIGHT.items() for x in pair]), severity)


def primary_category(categories: Column) -> Column:
    """The category of the array that comes first in the order of priority."""
    order = F.array(*map(F.lit, FAILURE_PRIORITY))
    return F.get(F.filter(order, lambda c: F.array_contains(categories, c)), F.lit(0))


def event_kind(event_type: Column, simulated: Column) -> Column:
    """simulated before derived before observed."""
    derived = F.lit(False)
    for prefix in DERIVED_EVENTS:
        derived = derived | event_type.startswith(prefix)
    return F.when(F.coalesce(simulated, F.lit(False)) | event_type.startswith("attacklab."), "simulated").when(derived, "derived").otherwise("observed")


def region_name(index: Column) -> Column:
    """Name of a cell of the 4 by 4 grid, counted row by row."""
    row = F.element_at(F.array(*map(F.lit, REGION_ROWS)), (index.cast("int") / 4).cast("int") + 1)
    col = F.element_at(F.array(*map(F.lit, REGION_COLUMNS)), (index % 4).cast("int") + 1)
    return F.concat_ws("-", row, col)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def zero_pad(prefix: str, number: Column, width: int) -> Column:
    """Ids such as F-001; a longer number keeps all digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def prefix(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def ellipsis(s: Column, n: int) -> Column:
    """At most ``n`` characters, with a mark where some were cut off."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def hex_pad(number: Column) -> Column:
    """Sixteen hex digits of a 64-bit number."""
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def percent(share: Column) -> Column:
    return F.format_string("%.0f%%", share.cast("double") * 100)


def formatted(number: Column, spec: str) -> Column:
    """A number as Python formats it: the exact binary value is rounded, which Java's formatter doesn't do. Null and NaN give null."""

    @F.pandas_udf(T.StringType())
    def text(values: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else format(v, spec) for v in values.tolist()], dtype=object)

    return text(number.cast("double"))


def fixed(number: Column, places: int = 3) -> Column:
    """A number with so many places."""
    return formatted(number, f".{places}f")


def scientific(number: Column, places: int = 2) -> Column:
    """A number as 1.23e-04: so many places and an exponent of at least two digits."""
    return formatted(number, f".{places}e")


def age(then: Column, now: Column) -> Column:
    """How long ago a time stamp was, in the largest whole unit: 5s, 3m, 2h, 4d; what lies ahead is now."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp")))
    unit = lambda n, name: F.concat(F.floor(seconds / n).cast("string"), F.lit(name))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def nonce() -> Column:
    """128 random bits as 32 hex digits."""
    return F.lower(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def clock(ts: Column) -> Column:
    """The time of day of a time stamp."""
    return F.date_format(ts, "HH:mm:ss")


def iso_now() -> Column:
    """The time of the query in UTC, as ISO text with milliseconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def one_of(s: Column, known: tuple[str, ...]) -> Column:
    """Whether a text is in the vocabulary, in any case of letters."""
    return F.upper(s).isin(*known)


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; the right one's values win."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalized(v: Column, epsilon: float = 1e-6) -> Column:
    norm = F.sqrt(dot(v, v)) + F.lit(epsilon)
    return F.transform(v, lambda x: x.cast("double") / norm)


def relative_change(current: Column, reference: Column) -> Column:
    return (current - reference) / (F.abs(reference) + F.lit(1e-6))


def z_score(x: Column, mean: Column, sd: Column, floor: float = 1e-3) -> Column:
    return F.abs((x - mean) / (sd + F.lit(floor)))


def softmax(v: Column) -> Column:
    exps = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda s, y: s + y))


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.coalesce(s, F.lit("—"))


def key_id(public_key_hex: Column) -> Column:
    return F.substring(F.sha2(F.unhex(public_key_hex), 256), 1, 16)


@F.pandas_udf(T.StringType())
def canonical_json(doc: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces, non-ASCII kept; null for what isn't JSON."""

    def one(s: str | None) -> str | None:
        try:
            return json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if s is not None else None
        except ValueError:
            return None

    return doc.map(one)
