"""Column functions: cleaning, normalising, grading, masking, formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from pulsewarden.config import DEFAULTS, Severity


def nan_to_num(c: Column) -> Column:
    """NaN, ±Inf and null become 0."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, 0.0).otherwise(c)


def nan_to_num_array(c: Column) -> Column:
    return F.transform(c, nan_to_num)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, not once per array element."""
    return F.transform(F.array(value), body)[0]


def normalize(vector: Column, method: str = "zscore") -> Column:
    """Scale an ``array<double>`` by its own mean and deviation, or by its range.

    A vector without spread and an unknown method leave it unchanged.
    """
    if method == "zscore":
        n = F.size(vector)

        def scaled(mean: Column) -> Column:
            sq = F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
            return bind(F.sqrt(sq / n), lambda sd: F.when(
                sd > 0, F.transform(vector, lambda x: (x - mean) / sd)).otherwise(vector))

        return bind(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x) / n, scaled)
    if method == "minmax":
        ends = F.struct(F.array_min(vector).alias("lo"), F.array_max(vector).alias("hi"))
        return bind(ends, lambda e: F.when(
            e["hi"] > e["lo"], F.transform(vector, lambda x: (x - e["lo"]) / (e["hi"] - e["lo"]))
        ).otherwise(vector))
    return vector


def feature_vector(values: Mapping[str, Column] | Sequence[str]) -> Column:
    """Array over the names in sorted order; a missing value gives 0.0."""
    if not isinstance(values, Mapping):
        values = {n: F.col(f"`{n}`") for n in values}
    return F.array(*[F.coalesce(values[n].cast("double"), F.lit(0.0)) for n in sorted(values)])


def map_vector(features: Column, names: Sequence[str]) -> Column:
    """The same from a ``map<string,double>``."""
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)) for n in sorted(names)])


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def severity(score: Column, levels: Sequence[Severity] = DEFAULTS.severity_levels) -> Column:
    """Highest level whose ``min_score`` is reached, else ``info``."""
    out = F.lit("info")
    for level in sorted(levels, key=lambda s: s.min_score):
        out = F.when(score >= level.min_score, F.lit(level.name)).otherwise(out)
    return out


def counter_severity(score: Column) -> Column:
    """Label of the detection counter; unlike ``severity``, strictly above .85."""
    return F.when(score > 0.85, F.lit("critical")).otherwise(F.lit("warning"))


def fixed(c: Column, digits: int) -> Column:
    """Number as text with a fixed number of decimals."""
    return F.round(c, digits).cast(f"decimal(38,{digits})").cast("string")


def alert_message(server: Column, metric: Column, score: Column, is_predicted: Column,
                  actual: Column | None = None, forecast: Column | None = None,
                  levels: Sequence[Severity] = DEFAULTS.severity_levels) -> Column:
    """Text of an alert: predicted, off its forecast, or simply anomalous."""
    # The three message templates.
    grade = F.upper(severity(score, levels))
    shown = fixed(score, 2)
    actual = actual if actual is not None else F.lit(None).cast("double")
    forecast = forecast if forecast is not None else F.lit(None).cast("double")
    now = F.coalesce(F.concat(fixed(actual, 1), F.lit("%")), F.lit("unknown"))
    predicted = F.concat(
        F.lit("[PREDICTED] "), metric, F.lit(" on "), server,
        F.lit(" is forecast to reach anomalous levels within the prediction horizon (score: "),
        shown, F.lit(")"),
    )
    deviates = F.concat(
        grade, F.lit(": "), metric, F.lit(" on "), server, F.lit(" at "), now,
        F.lit(" deviates from predicted normal of "), fixed(forecast, 1),
        F.lit("% (anomaly score: "), shown, F.lit(")"),
    )
    generic = F.concat(
        grade, F.lit(": "), metric, F.lit(" on "), server,
        F.lit(" shows anomalous behavior (score: "), shown, F.lit(", threshold exceeded)"),
    )
    return F.when(is_predicted, predicted).when(forecast.isNotNull(), deviates).otherwise(generic)


def dashboard_url(server: Column, base: str = DEFAULTS.dashboard_base) -> Column:
    if not base:
        return F.lit("")
    return F.concat(F.lit(f"{base}/d/server-detail?var-server="), server)


def dispatch_gate(is_anomaly: Column, score: Column) -> Column:
    return is_anomaly | (score > 0.5)


def alert_gate(is_anomaly: Column, score: Column,
               levels: Sequence[Severity] = DEFAULTS.severity_levels) -> Column:
    return is_anomaly | (severity(score, levels) != "info")


# Patterns of text that must not be shown. ``(?U)`` gives the
# Unicode reading of word borders and digits.
PII_PATTERNS = (
    r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)",
    r"(?U)\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
)
MASK = "***MASKED***"


def mask_pii(c: Column) -> Column:
    """Hide text that holds a secret's name, an id number or a mail address."""
    hit = F.lit(False)
    for pattern in PII_PATTERNS:
        hit = hit | c.rlike(pattern)
    parts = F.split(c, "@", 3)
    mail = F.concat(F.substring(parts[0], 1, 2), F.lit("***@"), parts[1])
    return F.when(hit, F.when(F.contains(c, F.lit("@")), mail).otherwise(F.lit(MASK))).otherwise(c)


def mask_pii_map(c: Column) -> Column:
    return F.transform_values(c, lambda _, v: mask_pii(v))


def hash_key(c: Column) -> Column:
    return F.sha2(c, 256)


def iso_time(ts: Column) -> Column:
    """ISO 8601 in UTC; microseconds only where there are any."""
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(plain, F.when(micros != ".000000", micros).otherwise(F.lit("")), F.lit("+00:00"))


def alert_json(**columns: Column) -> Column:
    """Fifteen-field JSON text of an alert row; columns default to their names."""
    c = {n: columns.get(n, F.col(n)) for n in (
        "alert_id", "server_id", "metric_name", "anomaly_score", "severity", "is_predicted",
        "prediction_horizon", "message", "suggested_action", "model_details", "dashboard_url",
        "timestamp", "correlation_id", "acknowledged", "acknowledged_by",
    )}
    c["anomaly_score"] = F.round(c["anomaly_score"], 4)
    c["timestamp"] = iso_time(c["timestamp"])
    return F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]), {"ignoreNullFields": "false"})


def label_filter(labels: Column, equals: Mapping[str, str] | None = None,
                 matches: Mapping[str, str] | None = None) -> Column:
    """Selector on labels; a pattern must match the whole label."""
    keep = F.lit(True)
    for k, v in (equals or {}).items():
        keep = keep & (F.coalesce(labels[k], F.lit("")) == v)
    for k, v in (matches or {}).items():
        keep = keep & F.coalesce(labels[k], F.lit("")).rlike(f"^(?:{v})$")
    return keep


def glob_regex(pattern: str) -> str:
    """Whole-string regular expression for a shell pattern (``* ? [seq] [!seq]``)."""
    out, rest = "", pattern
    while rest:
        head, rest = rest[0], rest[1:]
        close = rest.find("]", 2 if rest.startswith("!") else 1) if head == "[" else -1
        if head == "*":
            out += ".*"
        elif head == "?":
            out += "."
        elif close > 0:
            body, rest = rest[:close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&"), rest[close + 1:]
            body = "^" + body[1:] if body.startswith("!") else body.replace("^", r"\^", 1) if body.startswith("^") else body
            out += f"[{body}]"
        else:
            out += head if head.isalnum() or head == "_" else "\\" + head
    return rf"(?s)\A{out}\z"
