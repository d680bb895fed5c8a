"""Columns of the request log."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns, in the order they are tried.
DEVICES = [("bot", "bot|crawler|spider|slurp|headless"), ("tablet", "ipad|tablet"), ("mobile", "mobile|iphone|ipod|android")]
BROWSERS = [("Edge", "edg/|edgios|edga"), ("Firefox", "firefox/|fxios"), ("Chrome", "chrome/|crios")]


def device_type(agent: Column) -> Column:
    agent = F.coalesce(agent, F.lit(""))
    chain = F
    for value, pattern in DEVICES:
        chain = chain.when(agent.rlike(f"(?i){pattern}"), value)
    return chain.otherwise("desktop")


def browser_family(agent: Column) -> Column:
    agent = F.coalesce(agent, F.lit(""))
    chain = F
    for value, pattern in BROWSERS:
        chain = chain.when(agent.rlike(f"(?i){pattern}"), value)
    return chain.when(agent.contains("Safari/") & agent.contains("Version/"), "Safari").otherwise("Other")


def os_family(agent: Column) -> Column:
    agent = F.coalesce(agent, F.lit(""))
    return (
        F.when(agent.rlike("(?i)iphone|ipad|ipod"), "iOS")
        .when(agent.contains("Android"), "Android")
        .when(agent.contains("Windows"), "Windows")
        .when(agent.rlike("Mac OS X|Macintosh"), "macOS")
        .when(agent.contains("Linux"), "Linux")
        .otherwise("Other")
    )


def _canonical(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return str(ipaddress.ip_address(text))
        except ValueError:
            return text[:64]

    return values.map(one, na_action="ignore")


IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!$)|$)){4}$"


def normalise_ip(address: Column, ipv6: bool = True) -> Column:
    """Canonical address, else the first 64 characters, else ``unknown``.

    Only texts with a colon can be IPv6; they alone go through the Arrow kernel."""
    text = F.trim(F.coalesce(address, F.lit("unknown")))
    text = F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown"))
    plain = F.substring(text, 1, 64)
    if not ipv6:
        return plain
    return F.when(text.contains(":"), F.pandas_udf(_canonical, "string")(F.when(text.contains(":"), text))).otherwise(plain)


def referer_host(url: Column) -> Column:
    """Lower-case host of a referer; bad or missing addresses give an empty text."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.substring(host, 1, 255), F.lit(""))


def technical_group(secret: str, address: Column, agent: Column) -> Column:
    """Keyed hash of address and agent: ``T-`` and 12 hex digits."""
    nul = F.lit(bytes([0]))
    parts = F.concat(
        F.lit(secret.encode()), nul, F.encode(address, "UTF-8"), nul, F.encode(agent, "UTF-8")
    )
    return F.concat(F.lit("T-"), F.substring(F.sha2(parts, 256), 1, 12))


def technical_label(c: Column) -> Column:
    return F.when(c.isin("Other", "unknown"), "Drugo").otherwise(c)
