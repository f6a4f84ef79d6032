"""Expressions over benchmark records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Methods by where they run, and their pairs (baseline, checked).
SINGLE, MULTI = ("basic", "tolerance_queue"), ("multigpu_basic", "multigpu")
MODES = {"1gpu": SINGLE, "multigpu": MULTI}
#: The timings of a rank, in milliseconds, the last two being sums of others.
METRICS = (
    "main_loop", "gpu_compute", "graph_kernel", "cpu_check_drain", "nccl_exchange", "mpi_sync", "postcheck_total", "postcheck_mpi", "communication", "algorithm_total",
)


def gpu_mode(method: Column) -> Column:
    return F.when(method.isin(*SINGLE), F.lit("1gpu")).when(method.isin(*MULTI), F.lit("multigpu"))


def padded(repeat: Column) -> Column:
    return F.concat(F.lit("r"), F.when(repeat < 1000, F.lpad(repeat.cast("string"), 3, "0")).otherwise(repeat.cast("string")))


def record_id(algorithm: Column, dataset: Column, phase: Column, repeat: Column, method: Column) -> Column:
    return F.concat_ws(".", algorithm, dataset, phase, padded(repeat), method)


def pair_id(algorithm: Column, dataset: Column, repeat: Column, mode: Column) -> Column:
    return F.concat_ws("|", algorithm, dataset, padded(repeat), mode)


def finite(value: Column) -> Column:
    """A number, or null for what is absent, not a number or infinite."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def overhead_pct(baseline: Column, checked: Column) -> Column:
    return F.when(baseline > 0, (checked / baseline - 1) * 100)


def imbalance_pct(largest: Column, mean: Column) -> Column:
    return F.when(mean > 0, (largest / mean - 1) * 100)


def tolerance(*values: Column) -> Column:
    """How far timings may be apart that should be equal."""
    return F.greatest(F.lit(0.003), F.lit(1e-5) * F.greatest(F.lit(1.0), *[F.abs(v) for v in values]))


def close(left: Column, right: Column) -> Column:
    return F.abs(left - right) <= tolerance(left, right)


def within(part: Column, whole: Column) -> Column:
    return part <= whole + tolerance(part, whole)


def parse_pairs(line: Column) -> Column:
    """A map of the ``key=value`` tokens after a line's first word; null if a key repeats or a value is no finite number."""
    tokens = F.slice(F.split(F.trim(line), r"\s+"), F.lit(2), F.size(F.split(F.trim(line), r"\s+")))
    keys = F.transform(tokens, lambda t: F.regexp_extract(t, r"^([A-Za-z_0-9]+)=", 1))
    values = F.transform(tokens, lambda t: finite(F.nullif(F.regexp_extract(t, r"^[A-Za-z_0-9]+=(.*)$", 1), F.lit(""))))
    good = (F.size(keys) == F.size(F.array_distinct(keys))) & ~F.array_contains(keys, "") & F.forall(values, lambda v: v.isNotNull())
    return F.when(good, F.map_from_arrays(keys, values))


def duration(seconds: Column) -> Column:
    """HH:MM:SS, after the days and a dash if there are any."""
    part = lambda size, most: F.lpad(F.pmod(F.floor(seconds / size), F.lit(most)).cast("string"), 2, "0")
    clock = F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60))
    days = F.floor(seconds / 86400)
    return F.when(days > 0, F.concat_ws("-", days.cast("string"), clock)).otherwise(clock)


def stats(value: Column, prefix: str) -> list[Column]:
    """n, mean, median, std, p25, p75, min and max; the deviation of a single value is 0."""
    n = F.count(value)
    found = {
        "n": n, "mean": F.avg(value), "median": F.percentile(value, F.lit(0.5)), "std": F.when(n > 1, F.stddev_samp(value)).when(n == 1, F.lit(0.0)),
        "p25": F.percentile(value, F.lit(0.25)), "p75": F.percentile(value, F.lit(0.75)), "min": F.min(value), "max": F.max(value),
    }
    return [c.alias(f"{prefix}_{k}") for k, c in found.items()]


def rank_sums(value) -> dict[str, Column]:
    """All metrics from the measured ones: ``value`` gives the column of a metric."""
    out = {name: value(name) for name in METRICS[:-2]}
    out["communication"] = out["nccl_exchange"] + out["mpi_sync"] + out["postcheck_mpi"]
    out["algorithm_total"] = out["main_loop"] + out["cpu_check_drain"] + out["postcheck_total"]
    return out


def joined_url(base: Column, href: Column) -> Column:
    """The URL that ``href`` names on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^([^#]*)", 1)
    own = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.substring(href, F.length(own) + 1, F.length(href))
    whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), r"^(.*/)", 1), own))
    parts = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done).when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, part)),
    )
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when((own == "") & F.startswith(rest, F.lit("?")), F.concat(origin, path, rest))
        .when(own == "", F.concat(query, rest))
        .otherwise(F.concat(origin, F.array_join(parts, "/"), rest))
    )
