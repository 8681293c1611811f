"""Projections of a path and of a size: names, extensions, estimates, type flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoweave.functions import fixed
from repoweave.functions.globs import glob_regex
from repoweave.functions.text import Text, column, is_in, lookup, shared, starts_with_any


@shared
def basename(path: Text = "path") -> Column:
    return F.substring_index(column(path), "/", -1)


@shared
def dirname(path: Text = "path") -> Column:
    """Directory part; ``.`` for a file in the root."""
    path = column(path)
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit("."))


@shared
def extname(path: Text = "path") -> Column:
    """From the last dot of the base name, unless that dot opens it: ``.env`` has none."""
    return F.regexp_extract(basename(path), r"^[\s\S]+(\.[^.]*)\z", 1)


@shared
def lower_ext(path: Text = "path") -> Column:
    return F.lower(extname(path))


@shared
def directories(path: Text = "path") -> Column:
    """The directory names on the way to the file, root first."""
    parts = F.split(column(path), "/", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


@shared
def token_estimate(units: Text) -> Column:
    """Units divided by four, rounded up."""
    return F.floor((column(units) + fixed.CHARS_PER_TOKEN - 1) / F.lit(fixed.CHARS_PER_TOKEN)).cast("bigint")


@shared
def human_size(size: Text = "size") -> Column:
    """Decimal units with at most two decimals and no trailing zeros: ``265.32 kB``."""
    units = ["B", "kB", "MB", "GB", "TB", "PB"]
    scales = F.array(*[F.lit(1000.0 ** power) for power in range(len(units))])
    whole = column(size).cast("string")
    # Three digits to a unit; the number of digits is exact where a logarithm is not.
    power = F.least(F.floor((F.length(whole) - 1) / F.lit(3)), F.lit(len(units) - 1)).cast("int")
    scaled = column(size).cast("double") / F.get(scales, power)
    hundredths = F.floor(scaled * F.lit(100) + F.lit(0.5))
    # A value that rounds up to 1000 is shown as 1 of the next unit, if there is one.
    rolls = (hundredths == 100_000) & (power < len(units) - 1)
    shown = F.when(rolls, F.lit(100)).otherwise(hundredths)
    digits = F.concat(
        F.floor(shown / F.lit(100)).cast("string"), F.lit("."),
        F.lpad(F.pmod(shown, F.lit(100)).cast("string"), 2, "0"),
    )
    unit = F.elt(power + F.when(rolls, 2).otherwise(1), *[F.lit(u) for u in units])
    number = F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))
    return F.when(power == 0, F.concat(whole, F.lit(" B"))).otherwise(
        F.concat(number, F.lit(" "), unit)
    )


@shared
def is_binary(path: Text = "path") -> Column:
    return is_in(lower_ext(path), fixed.BINARY_EXTENSIONS)


@shared
def is_high_priority(path: Text = "path") -> Column:
    return is_in(basename(path), fixed.HIGH_PRIORITY_NAMES)


@shared
def is_entry_point(path: Text = "path") -> Column:
    plain = [g for g in fixed.ENTRY_POINT_GLOBS if "*" not in g]
    wild = "|".join(glob_regex(g) for g in fixed.ENTRY_POINT_GLOBS if "*" in g)
    return is_in(path, plain) | column(path).rlike(wild)


@shared
def in_important_folder(path: Text = "path") -> Column:
    return starts_with_any(path, fixed.IMPORTANT_FOLDERS)


@shared
def is_include_name(path: Text = "path") -> Column:
    """Main configuration, information and entry files: the first tier of the size budget."""
    return is_in(basename(path), sorted(set(fixed.INCLUDE_NAMES)))


@shared
def is_render_skipped(path: Text = "path") -> Column:
    return is_in(lower_ext(path), fixed.RENDER_SKIP_EXTENSIONS + fixed.BINARY_EXTENSIONS)


def file_flags(path: Text = "path", size: Text = "size") -> dict[str, Column]:
    config, entry = is_high_priority(path), is_entry_point(path)
    return {
        "is_binary": is_binary(path),
        "is_large": column(size) > fixed.MAX_FILE_BYTES,
        "is_config": config,
        "is_priority": in_important_folder(path) | config | entry,
        "is_entry": entry,
        "estimated_tokens": token_estimate(size),
    }


@shared
def language_id(path: Text = "path") -> Column:
    return lookup(lower_ext(path), fixed.LANGUAGE_IDS, "")


@shared
def type_group(path: Text = "path") -> Column:
    """First group that lists the extension; configuration also goes by the base name."""
    ext = lower_ext(path)
    chain = F
    for name, extensions in fixed.TYPE_GROUPS.items():
        hit = is_in(ext, extensions)
        if name == "Configuration Files":
            hit = hit | basename(path).rlike(fixed.CONFIGURATION_NAME_REGEX)
        chain = chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(fixed.OTHER_GROUP))


@shared
def is_sensitive_path(path: Text = "path") -> Column:
    regex = "|".join(r.replace("$", r"\z") for r in fixed.SENSITIVE_PATH_REGEXES)
    return column(path).rlike(f"(?i){regex}")
