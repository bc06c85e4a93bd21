"""Column functions on text: log lines, names, versions, URLs."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose pages are not direct media.
STREAMING_HOSTS = (
    "youtube.com", "youtu.be", "youtube-nocookie.com", "instagram.com", "instagr.am", "facebook.com", "fb.watch", "tiktok.com", "twitter.com",
    "x.com", "reddit.com", "redd.it", "vimeo.com", "dailymotion.com", "dai.ly", "snapchat.com", "t.me", "telegram.me",
)
# Names of the machine itself.
LOCAL_NAMES = ("localhost", "localhost.localdomain")
MAX_URL = 2048


def safe_log_text(x: Column, limit: int = 500) -> Column:
    """One bounded line: CR, LF and TAB as two characters, other control characters as \\xNN."""
    named = F.replace(F.replace(F.replace(x, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    controls = [i for i in [*range(32), 127] if i not in (9, 10, 13)]
    return F.substring(reduce(lambda c, i: F.replace(c, F.lit(chr(i)), F.lit(f"\\x{i:02x}")), controls, named), 1, limit)


def safe_name(x: Column) -> Column:
    """Letters, digits and `-_.` stay, the rest becomes `_`; 80 characters; never empty."""
    cleaned = F.substring(F.regexp_replace(x.cast("string"), r"[^\p{L}\p{N}\-_.]", "_"), 1, 80)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("ungrouped"))


def model_version(version: Column, trained_on: Column) -> Column:
    """The explicit version, else the first word before a colon if it starts with v, else unversioned."""
    first = F.split_part(F.trim(F.split_part(F.coalesce(trained_on, F.lit("")), F.lit(":"), F.lit(1))), F.lit(" "), F.lit(1))
    return F.coalesce(F.nullif(F.trim(version), F.lit("")), F.when(F.lower(first).startswith("v"), first), F.lit("unversioned"))


def extension(name: Column, most: int = 8) -> Column:
    """The lower-case extension of a name, never the name."""
    return F.substring(F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/\\.](\.[^./\\]*)$", 1)), 1, most)


def ipv4(host: Column) -> Column:
    """A dotted address as a number, else NULL."""
    ok = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    parts = F.transform(F.split(host, r"\."), lambda p: p.try_cast("bigint"))
    value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    return F.when(ok & F.forall(parts, lambda p: p <= 255), value)


def inet_aton(host: Column) -> Column:
    """The number of an IPv4 address as resolvers read it, else NULL: one to four parts, decimal, octal (leading 0) or hex
    (leading 0x), the last of which fills the bytes that are left: `127.1`, `0x7f000001`, `0177.0.0.1`, `2130706433`."""
    def number(p: Column) -> Column:
        """A part below 2^32; more digits than that needs give NULL."""
        digits = F.regexp_replace(p, "^(0x)?0*", "")
        base = F.when(p.startswith("0x"), 16).when(p.startswith("0"), 8).otherwise(10)
        value = F.when(base == 16, F.conv(digits, 16, 10)).when(base == 8, F.conv(digits, 8, 10)).otherwise(digits)
        short = F.length(digits) <= F.when(base == 16, 8).when(base == 8, 11).otherwise(10)
        return F.when(p.rlike("^(0x[0-9a-f]+|0[0-7]*|[1-9][0-9]*)$") & short, F.coalesce(F.nullif(value, F.lit("")), F.lit("0")).try_cast("bigint"))

    def whole(x: Column) -> Column:
        n = F.size(x)
        front, last = F.slice(x, 1, n - 1), F.element_at(x, -1)
        room = F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), n)
        sum_ = F.aggregate(front, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p) * room + last
        return F.when(F.forall(front, lambda p: p <= 255) & (last < room), sum_)

    parts = F.split(host, r"\.")
    return F.when(host.rlike(r"^[0-9][0-9a-fx]*(\.[0-9][0-9a-fx]*){0,3}$"), let(F.transform(parts, number), whole))


# Address ranges that must not be fetched and why, and public ranges inside them; the first match counts.
RANGES = (
    ("127.0.0.0/8", "loopback address"), ("169.254.0.0/16", "link-local address"), ("192.0.0.9/32", "ok"), ("192.0.0.10/32", "ok"),
    ("0.0.0.0/8", "private address"), ("10.0.0.0/8", "private address"), ("172.16.0.0/12", "private address"), ("192.0.0.0/24", "private address"),
    ("192.0.2.0/24", "private address"), ("192.168.0.0/16", "private address"), ("198.18.0.0/15", "private address"), ("198.51.100.0/24", "private address"),
    ("203.0.113.0/24", "private address"), ("240.0.0.0/4", "private address"), ("224.0.0.0/4", "reserved address"),
)
RANGES_6 = (
    ("::1/128", "loopback address"), ("fe80::/10", "link-local address"), ("2001:1::1/128", "ok"), ("2001:1::2/128", "ok"), ("2001:3::/32", "ok"),
    ("2001:4:112::/48", "ok"), ("2001:20::/28", "ok"), ("2001:30::/28", "ok"), ("::/128", "private address"), ("64:ff9b:1::/48", "private address"),
    ("100::/64", "private address"), ("2001::/23", "private address"), ("2001:db8::/32", "private address"), ("3fff::/20", "private address"),
    ("fc00::/7", "private address"), ("ff00::/8", "reserved address"), ("::/8", "reserved address"), ("100::/8", "reserved address"),
    ("200::/7", "reserved address"), ("400::/6", "reserved address"), ("800::/5", "reserved address"), ("1000::/4", "reserved address"),
    ("4000::/3", "reserved address"), ("6000::/3", "reserved address"), ("8000::/3", "reserved address"), ("a000::/3", "reserved address"),
    ("c000::/3", "reserved address"), ("e000::/4", "reserved address"), ("f000::/5", "reserved address"), ("f800::/6", "reserved address"),
    ("fe00::/9", "reserved address"),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value in the expression and computed only once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ipv6_hex(host: Column) -> Column:
    """The 32 hex digits of a bracketed address in any spelling, else NULL."""
    def spell(body: Column) -> Column:
        """A dotted tail as two groups of hex digits."""
        low = lambda x: F.concat(F.regexp_replace(body, r"[0-9]+\.[0-9.]+$", ""), F.substring(x, 1, 4), F.lit(":"), F.substring(x, 5, 4))
        return F.when(~body.contains("."), body).otherwise(let(F.lpad(F.lower(F.hex(ipv4(F.regexp_extract(body, r"([0-9.]+)$", 1)))), 8, "0"), low))

    def whole(spelled: Column) -> Column:
        parts = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(spelled, "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")

        def groups(x: Column) -> Column:
            given = F.size(x["left"]) + F.size(x["right"])
            zeros = F.array_repeat(F.lit("0"), F.when(x["halves"] == 2, F.greatest(8 - given, F.lit(0))).otherwise(0))
            fits = F.when(x["halves"] == 2, given < 8).otherwise((given == 8) & ~spelled.rlike("^:|:$"))
            ok = (spelled != "") & (x["halves"] <= 2) & fits & ~spelled.contains(":::")
            full = lambda g: F.when(ok & F.forall(g, lambda p: p.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda p: F.lpad(p, 4, "0")), ""))
            return let(F.concat(x["left"], zeros, x["right"]), full)

        return let(F.struct(parts(0).alias("left"), parts(1).alias("right"), F.size(F.split(spelled, "::")).alias("halves")), groups)

    return let(F.regexp_extract(host, r"^\[([0-9a-f:.]+)(?:%[^\]]*)?\]$", 1), lambda body: let(spell(body), whole))


def _first_match(value: Column, ranges: tuple, spell: Callable) -> Column:
    """The reason of the first range that holds the value, else `ok`."""
    nets = [(ipaddress.ip_network(net), reason) for net, reason in ranges]
    table = F.array(*[F.struct(F.lit(spell(n.network_address)).alias("lo"), F.lit(spell(n.broadcast_address)).alias("hi"), F.lit(r).alias("reason")) for n, r in nets])
    return F.coalesce(F.get(F.filter(table, lambda x: (value >= x["lo"]) & (value <= x["hi"])), F.lit(0))["reason"], F.lit("ok"))


def address_policy(host: Column) -> Column:
    """`ok` or why a literal address must not be fetched; NULL where the host is a name. An IPv4 address inside IPv6
    (mapped, 6to4) is judged as itself."""
    def judge(six: Column) -> Column:
        inner = F.when(six.startswith("0" * 20 + "ffff"), F.substring(six, 25, 8)).when(six.startswith("2002"), F.substring(six, 5, 8))
        by_four = lambda number: F.when(number.isNotNull(), _first_match(number, RANGES, int)).when(six.isNotNull(), _first_match(six, RANGES_6, lambda a: f"{int(a):032x}"))
        return let(F.coalesce(inet_aton(host), F.conv(inner, 16, 10).cast("bigint")), by_four)

    return let(ipv6_hex(host), judge)


def url_policy(url: Column, allow_http: bool = False) -> Column:
    """`ok`, or why the URL must not be fetched. Names are not resolved: only literal addresses are tested."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)), r"\.$", "")
    streaming = reduce(lambda a, b: a | b, [(host == h) | host.endswith("." + h) for h in STREAMING_HOSTS])
    name = host.isin(*LOCAL_NAMES) | host.endswith(".localhost")

    def by_address(address: Column) -> Column:
        out = F.when((F.coalesce(url, F.lit("")) == "") | (F.length(url) > MAX_URL), "missing or too long").when(~scheme.isin("http", "https"), "unsupported scheme")
        if not allow_http:
            out = out.when(scheme == "http", "insecure scheme")
        out = out.when((host == "") | (host.startswith("[") & address.isNull()), "no host").when(streaming, "streaming platform").when(name, "loopback address")
        return out.when(address.isNotNull(), address).otherwise("ok")

    return let(address_policy(host), by_address)
