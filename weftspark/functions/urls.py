"""Columns over urls of measured pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_URL = r"^(?i)(https?)://(\[[0-9a-f:.]+\]|[^/?#:@\[\]\\\s]+)(?::([0-9]*))?(?:[/?#].*)?$"
_ADDRESS = r"^(?:\[.*\]|[0-9]+(?:\.[0-9]+){3})$"


def origin(url: Column) -> Column:
    """scheme, host (lower case) and port ('' for the scheme's own) of an http url without credentials; null for any other."""
    scheme, host, port = F.lower(F.regexp_extract(url, _URL, 1)), F.lower(F.regexp_extract(url, _URL, 2)), F.regexp_extract(url, _URL, 3)
    own = F.when(scheme == "http", "80").otherwise("443")
    return F.when(url.rlike(_URL), F.struct(scheme.alias("scheme"), host.alias("host"), F.when(port == own, "").otherwise(port).alias("port")))


def host_alias(host: Column) -> Column:
    """The www form of an apex host or the apex of its www form; null for addresses and hosts that are neither (an apex has two labels, or is localhost)."""
    apex = F.regexp_replace(host, r"^www\.", "")
    fits = ~host.rlike(_ADDRESS) & ~host.startswith("www.www.") & apex.rlike(r"^(?:localhost|[^.]+\.[^.]+)$")
    return F.when(fits, F.when(host == apex, F.concat(F.lit("www."), host)).otherwise(apex))


def canonical_redirects(asked: Column, hops: Column) -> Column:
    """Whether every one of the hops (urls in order) stays on the site that was asked for.

    Each hop may keep the origin; change once to the host's www alias, from the host first asked for; and
    change once from http to https, on both schemes' own ports. Anything else, and a url that is not http, ends it.
    """
    start = F.transform(F.array(origin(asked)), lambda o: F.struct(o.alias("first"), o.alias("now"), F.lit(False).alias("renamed"), F.lit(False).alias("raised"), o.isNotNull().alias("fits")))

    def step(a: Column, hop: Column) -> Column:
        def follow(o: Column) -> Column:
            now = a["now"]
            host, scheme = o["host"] != now["host"], o["scheme"] != now["scheme"]
            host_fits = ~host | (~a["renamed"] & (now["host"] == a["first"]["host"]) & F.coalesce(o["host"] == host_alias(a["first"]["host"]), F.lit(False)))
            up = ~a["raised"] & (now["scheme"] == "http") & (o["scheme"] == "https") & (now["port"] == "") & (o["port"] == "")
            fits = F.coalesce(host_fits & F.when(scheme, up).otherwise(o["port"] == now["port"]), F.lit(False))
            return F.struct(a["first"].alias("first"), o.alias("now"), (a["renamed"] | host).alias("renamed"), (a["raised"] | scheme).alias("raised"), (a["fits"] & o.isNotNull() & fits).alias("fits"))

        return F.get(F.transform(F.array(origin(hop)), follow), F.lit(0))

    return F.aggregate(hops, F.get(start, F.lit(0)), step, lambda a: a["fits"])
