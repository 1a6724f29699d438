"""K7 — warehouse target by profile name (case-insensitive)."""

from __future__ import annotations

from collections.abc import Mapping

from wavelake.sinks.jdbc import JdbcSink
from wavelake.sinks.lake import LakeSink
from wavelake.sinks.lineproto import LineProtocolSink

# URL form and default port per warehouse profile.
PROFILE_URLS = {
    "clickhouse": ("jdbc:clickhouse://{host}:{port}/{database}", None),
    "doris": ("jdbc:mysql://{host}:{port}/{database}", 9030),
    "influxdb": ("http://{host}:{port}", 8086),
}


def normalise_profile(profile: str) -> str:
    p = profile.strip().lower()
    if p not in PROFILE_URLS:
        raise ValueError(f"{profile!r} is not one of {sorted(PROFILE_URLS)}")
    return p


def warehouse_url(profile: str, host: str, database: str, port: int | None = None) -> str:
    p = normalise_profile(profile)
    template, default_port = PROFILE_URLS[p]
    port = port or default_port
    if port is None:
        raise ValueError(f"profile {p!r} needs a port")
    return template.format(host=host, port=port, database=database)


def sink_for(profile: str, url: str, database: str,
             properties: Mapping[str, str] | None = None, **kwargs):
    """A sink object with ``create_if_absent(df, table)`` and ``write(df, table)``.

    Besides the warehouse profiles, ``"lake"`` writes month-partitioned
    Parquet tables under ``url`` (a folder URI)."""
    if profile.strip().lower() == "lake":
        return LakeSink(url)
    p = normalise_profile(profile)
    if p == "influxdb":
        return LineProtocolSink(url=url, database=database, properties=dict(properties or {}), **kwargs)
    return JdbcSink(dialect=p, url=url, properties=dict(properties or {}), **kwargs)


def warehouse_sink(profile: str, host: str, database: str, port: int | None = None,
                   properties: Mapping[str, str] | None = None, **kwargs):
    """The sink of a profile's warehouse on ``host``: its URL form, default
    port, driver and credentials in one call."""
    return sink_for(profile, warehouse_url(profile, host, database, port), database,
                    properties, **kwargs)
