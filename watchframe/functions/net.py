"""Address predicates and arithmetic."""

from __future__ import annotations

import ipaddress
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchframe.functions import signatures as sig
from watchframe.functions.text import any_of


def is_private_v4(host: Column) -> Column:
    return F.coalesce(host.rlike(sig.PRIVATE_V4), F.lit(False))


def is_private(host: Column) -> Column:
    """IPv4 private, loopback, link-local and ``0.`` ranges plus the IPv6 ones."""
    return is_private_v4(host) | F.coalesce(host.rlike("(?i)" + sig.PRIVATE_V6), F.lit(False))


def is_internal(ip: Column) -> Column:
    """The narrow skip list of the enrichment step: 10., 192.168., 172.16."""
    return F.coalesce(any_of([ip.startswith(p) for p in sig.INTERNAL_PREFIXES]), F.lit(False))


def remote_host(remote: Column) -> Column:
    """Part before the last colon, null when there is no colon."""
    return F.when(F.contains(remote, F.lit(":")), F.regexp_extract(remote, r"(?s)^(.*):([^:]*)$", 1))


def remote_port(remote: Column) -> Column:
    return F.when(F.contains(remote, F.lit(":")), F.regexp_extract(remote, r"(?s)^(.*):([^:]*)$", 2))


def is_ipv4(c: Column) -> Column:
    """Four decimal octets 0-255 without leading zeros."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.coalesce(c.rlike(rf"^{octet}(\.{octet}){{3}}$"), F.lit(False))


def ip_to_long(ip: Column) -> Column:
    """IPv4 text as a number, null when it is not an address."""
    octets = [F.get(F.split(ip, r"\."), F.lit(i)).try_cast("bigint") for i in range(4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(is_ipv4(ip), number)


def _prefix_length(cidr: Column) -> Column:
    """Length behind the slash, 32 without one, null when it is not a number up to 32."""
    text = F.try_element_at(F.split(cidr, "/"), F.lit(2))
    bits = text.try_cast("int")
    return F.when(text.isNull(), 32).when(bits.between(0, 32), bits)


def ip_in_cidr(ip: Column, cidr: Column) -> Column:
    """Whether an IPv4 address lies in a network; host bits of the network are ignored."""
    base = ip_to_long(F.split(cidr, "/").getItem(0))
    bits = _prefix_length(cidr)
    size = F.pow(F.lit(2), F.lit(32) - bits).cast("bigint")
    return F.coalesce(F.floor(ip_to_long(ip) / size) == F.floor(base / size), F.lit(False))


def is_ipv6(c: Column) -> Column:
    """Up to eight groups of four hex digits, one run of them left out, the last two may be IPv4."""
    head = F.regexp_replace(c, r"%[^%/]+$", "")
    tail = F.regexp_extract(head, r"([^:]*)$", 1)
    plain = F.when(F.contains(tail, F.lit(".")) & is_ipv4(tail),
                   F.concat(F.regexp_extract(head, r"^(.*:)[^:]*$", 1), F.lit("0:0"))).otherwise(head)
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    words = F.regexp_replace(plain, r"^::|::$|::", ":")
    shaped = words.rlike(r"^:?([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?:?$") & ~plain.rlike(r":::|::.*::|^:[^:]|[^:]:$")
    full = F.when(F.contains(plain, F.lit("::")), groups <= 7).otherwise(groups == 8)
    return F.coalesce(F.contains(c, F.lit(":")) & shaped & full, F.lit(False))


def is_ip(c: Column) -> Column:
    return is_ipv4(c) | is_ipv6(c)


def ipv6_words(ip: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address; an IPv4 ending makes the last two."""
    octet = lambda i: F.coalesce(F.try_element_at(F.split(F.regexp_extract(ip, r"([^:]*)$", 1), r"\."), F.lit(i)).try_cast("int"), F.lit(0))
    pair = lambda i: F.hex((octet(i) * 256 + octet(i + 1)).cast("bigint"))
    plain = F.when(F.contains(ip, F.lit(".")), F.concat(F.regexp_extract(ip, r"^(.*:)[^:]*$", 1), pair(1), F.lit(":"), pair(3))).otherwise(ip)
    part = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    left, right = part(F.substring_index(plain, "::", 1)), part(F.when(F.contains(plain, F.lit("::")), F.substring_index(plain, "::", -1)).otherwise(""))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - F.size(left) - F.size(right)))
    return F.transform(F.concat(left, zeros, right), lambda g: F.conv(g, 16, 10).cast("int"))


#: Address ranges that count as private, by the registry of special addresses, and those within that do not.
PRIVATE_NETWORKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
                    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
GLOBAL_HOSTS = ["192.0.0.9", "192.0.0.10"]
PRIVATE_NETWORKS_V6 = ["::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32",
                       "2002::/16", "fc00::/7", "fe80::/10"]
GLOBAL_NETWORKS_V6 = ["2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
GLOBAL_HOSTS_V6 = ["2001:1::1", "2001:1::2"]


def is_scannable_network(cidr: Column) -> Column:
    """At most 256 addresses, and private or loopback, IPv4 or IPv6; networks that begin or end with a global host are not."""
    bits = _prefix_length(cidr)
    base = F.split(cidr, "/").getItem(0)

    def ends_at(lowest: Column, free: Column, host: int) -> Column:
        """Whether the first or last of 2**free addresses around one, by its lowest number, is the host's."""
        size = F.pow(F.lit(2), free).cast("int")
        first = lowest - lowest % size
        return (first == host) | (first + size - 1 == host)

    octets = F.transform(F.split(base, r"\."), lambda o: o.try_cast("int"))
    v4 = is_ipv4(base) & any_of([ip_in_cidr(base, F.lit(n)) for n in PRIVATE_NETWORKS]) & F.coalesce(bits >= 24, F.lit(False))
    for host in GLOBAL_HOSTS:
        net, low = host.rsplit(".", 1)
        v4 = v4 & ~F.coalesce(ip_in_cidr(base, F.lit(f"{net}.0/24")) & ends_at(F.get(octets, F.lit(3)), F.lit(32) - bits, int(low)), F.lit(False))
    text = F.try_element_at(F.split(cidr, "/"), F.lit(2))
    bits6 = F.when(text.isNull(), 128).otherwise(text.try_cast("int"))
    words = ipv6_words(base)

    def inside(net: str) -> Column:
        address, size = net.split("/")
        want, size = ipaddress.ip_address(address).packed, int(size)
        tests = [bits6 >= size]
        for i in range(-(-size // 16)):
            shift = max(0, 16 * (i + 1) - size)
            tests.append(F.shiftright(words[i], shift) == int.from_bytes(want[2 * i:2 * i + 2], "big") >> shift)
        return reduce(and_, tests)

    v6 = any_of([inside(n) for n in PRIVATE_NETWORKS_V6]) & ~any_of([inside(n) for n in GLOBAL_NETWORKS_V6])
    for host in GLOBAL_HOSTS_V6:
        low = int.from_bytes(ipaddress.ip_address(host).packed[-2:], "big")
        v6 = v6 & ~(inside(f"{host}/112") & ends_at(words[7], F.lit(128) - bits6, low))
    return v4 | F.coalesce(F.when(is_ipv6(base) & bits6.between(120, 128), v6), F.lit(False))


def established_public(conns: Column, private=is_private_v4) -> Column:
    """Established connections of an array whose remote host is public."""
    return F.filter(
        conns,
        lambda c: F.coalesce(
            (c["state"] == "ESTABLISHED") & (remote_host(c["remote"]) != "")
            & ~private(remote_host(c["remote"])), F.lit(False)))
