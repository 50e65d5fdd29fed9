"""Labels of levels and sources, and a stable colour slot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names of numeric levels: syslog severities, and the standard Windows event levels.
LEVELS = {
    "journald": ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"],
    "evtx": ["LogAlways", "Critical", "Error", "Warning", "Informational", "Verbose"],
}


def level_name(level: Column, sourcetype: Column) -> Column:
    """The name of a numeric level, or null."""
    out = F.lit(None).cast("string")
    for kind, names in LEVELS.items():
        known = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (str(k), n)])
        out = F.when(sourcetype == kind, F.try_element_at(known, level)).otherwise(out)
    return out


def level_label(level: Column, sourcetype: Column) -> Column:
    name = level_name(level, sourcetype)
    return F.when(name.isNull(), level).otherwise(F.concat(level, F.lit(" ("), name, F.lit(")")))


def source_label(path: Column, sourcetype: Column) -> Column:
    """The last path component; the whole path for unified-log sources, whose folders share names."""
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.when((sourcetype == "aul") | (last == ""), path).otherwise(last)


def color_slot(value: str, slots: int = 8) -> int:
    """FNV-1a (64 bits) of the UTF-8 text modulo the number of slots."""
    h = 0xCBF29CE484222325
    for b in value.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h % slots
