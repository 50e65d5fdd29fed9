"""Virtual columns read from the JSON ``fields`` by sourcetype; used alike by projections and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed paths: virtual column, then for each sourcetype the JSON paths tried in order. Other sourcetypes have none.
PATHS = {
    "host": {"evtx": ["$.Event.System.Computer"], "journald": ["$._HOSTNAME"]},
    "process": {"journald": ["$.SYSLOG_IDENTIFIER", "$._COMM"], "aul": ["$.process"]},
    "event_code": {"evtx": ["$.Event.System.EventID"]},
    "subsystem": {"evtx": ["$.Event.System.Provider_attributes.Name"], "aul": ["$.subsystem"]},
    "category": {"aul": ["$.category"]},
}


def virtual(name: str, sourcetype: Column | None = None, fields: Column | None = None) -> Column:
    """One virtual column; null where the sourcetype has no such field."""
    sourcetype = F.col("sourcetype") if sourcetype is None else sourcetype
    fields = F.col("fields") if fields is None else fields
    out = None
    for kind, paths in PATHS[name].items():
        value = F.coalesce(*[F.get_json_object(fields, p) for p in paths])
        out = F.when(sourcetype == kind, value) if out is None else out.when(sourcetype == kind, value)
    return out
