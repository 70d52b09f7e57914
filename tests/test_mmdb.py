"""Databases of address ranges built here, against the ranges that went in."""

import hashlib
import ipaddress
import random
import struct

import pytest

from trailweave.functions.values import ip_key  # noqa: F401
from trailweave.sources import ingest, mmdb


def encoded(v):
    """Bytes of a value, as the layout has it."""
    def head(kind, size):
        ext = b"" if kind < 8 else bytes([kind - 7])
        top = kind << 5 if kind < 8 else 0
        if size < 29:
            return bytes([top | size]) + ext
        if size < 285:
            return bytes([top | 29]) + ext + bytes([size - 29])
        return bytes([top | 30]) + ext + struct.pack(">H", size - 285)

    if isinstance(v, bool):
        return head(mmdb.BOOLEAN, int(v))
    if isinstance(v, str):
        return head(mmdb.STRING, len(v.encode())) + v.encode()
    if isinstance(v, float):
        return head(mmdb.DOUBLE, 8) + struct.pack(">d", v)
    if isinstance(v, int):
        raw = v.to_bytes(8).lstrip(b"\0")
        return head(mmdb.UINT64 if len(raw) > 4 else mmdb.UINT32, len(raw)) + raw
    if isinstance(v, list):
        return head(mmdb.ARRAY, len(v)) + b"".join(map(encoded, v))
    return head(mmdb.MAP, len(v)) + b"".join(encoded(k) + encoded(x) for k, x in v.items())


def built(networks, bits, width, alias=False):
    """A database of (network, value); ``alias`` adds ::ffff:0:0/96 as another name of the IPv4 addresses."""
    nodes, data, places = [[None, None]], b"", {}

    def insert(first, depth, leaf):
        at = 0
        for d in range(depth):
            bit = first >> (bits - d - 1) & 1
            if d == depth - 1:
                nodes[at][bit] = leaf
                return
            if not isinstance(nodes[at][bit], int):
                below = nodes[at][bit]
                nodes.append([below, below])
                nodes[at][bit] = len(nodes) - 1
            at = nodes[at][bit]

    for net, value in sorted(networks, key=lambda p: p[0].prefixlen + (96 if p[0].version == 4 and bits == 128 else 0)):
        key = repr(value)
        if key not in places:
            places[key] = len(data)
            data += encoded(value)
        insert(int(net.network_address), net.prefixlen + (96 if net.version == 4 and bits == 128 else 0), ("value", places[key]))
    if alias:
        four = 0
        for _ in range(96):
            four = nodes[four][0]
        at = 0
        for d in range(96):
            bit = 0xFFFF << 32 >> (127 - d) & 1
            if d == 95:
                nodes[at][bit] = four
            elif not isinstance(nodes[at][bit], int):
                nodes.append([nodes[at][bit], nodes[at][bit]])
                nodes[at][bit] = len(nodes) - 1
            at = nodes[at][bit]
    n, out = len(nodes), b""
    number = lambda r: n if r is None else r if isinstance(r, int) else n + 16 + r[1]
    for left, right in nodes:
        a, b = number(left), number(right)
        if width == 28:
            out += (a & 0xFFFFFF).to_bytes(3) + bytes([(a >> 24) << 4 | b >> 24]) + (b & 0xFFFFFF).to_bytes(3)
        else:
            out += a.to_bytes(width // 8) + b.to_bytes(width // 8)
    about = {"node_count": n, "record_size": width, "ip_version": 6 if bits == 128 else 4, "languages": ["en"], "wide": 1.5, "ok": True, "long": "x" * 300}
    return out + b"\0" * 16 + data + mmdb.MARK + encoded(about)


def networks(rng, bits, n):
    out = {}
    for _ in range(n):
        v4 = bits == 32 or rng.random() < 0.5
        size = rng.randrange(4, 30) if v4 else rng.randrange(4, 100)
        base = rng.getrandbits(32 if v4 else 128)
        if not v4:
            base |= 1 << 125  # 2000::/3 and beyond
        width = 32 if v4 else 128
        net = (ipaddress.IPv4Network if v4 else ipaddress.IPv6Network)((base >> (width - size) << (width - size), size))
        out[net] = {"country": {"iso_code": rng.choice(["AA", "BB", "CC"]), "names": {"en": "é" * rng.randrange(40)}}, "autonomous_system_number": rng.randrange(1 << 33)} if rng.random() < 0.9 else {"other": [1, 2.5, True]}
    return list(out.items())


@pytest.mark.parametrize("bits,width,alias", [(32, 24, False), (128, 28, True), (128, 32, False)])
def test_longest_prefix(spark, tmp_path, bits, width, alias):
    rng = random.Random(width)
    nets = networks(rng, bits, 60)
    data = built(nets, bits, width, alias)
    (tmp_path / "geo.mmdb").write_bytes(data)
    table = mmdb.read_mmdb(spark, str(tmp_path / "geo.mmdb")).cache()
    spans = sorted((r.first, r.last) for r in table.collect())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and {r.source_sha256 for r in table.select("source_sha256").collect()} == {hashlib.sha256(data).hexdigest()}
    asked = [net.network_address + rng.randrange(net.num_addresses) for net, _ in nets for _ in range(3)] + [ipaddress.ip_address(rng.getrandbits(32)) for _ in range(40)]
    rows = spark.createDataFrame([(str(a), None, None, "u") for a in asked], "src_ip string, geo_country string, asn long, geo_source string")
    got = {r.src_ip: (r.geo_country, r.asn) for r in ingest.enrich_geo(rows, table).collect()}
    for a in asked:
        value = max(((net.prefixlen, v) for net, v in nets if net.version == a.version and a in net), key=lambda p: p[0], default=(0, {}))[1]
        assert got[str(a)] == (value.get("country", {}).get("iso_code"), value.get("autonomous_system_number")), a


def test_two_databases(spark, tmp_path):
    rng = random.Random(9)
    sets = [[(n, {k: v[k]}) for n, v in networks(rng, 128, 40) if k in v] for k in ("country", "autonomous_system_number")]
    tables = []
    for i, nets in enumerate(sets):
        (tmp_path / f"{i}.mmdb").write_bytes(built(nets, 128, 24))
        tables.append(mmdb.read_mmdb(spark, str(tmp_path / f"{i}.mmdb")))
    asked = [net.network_address + rng.randrange(net.num_addresses) for nets in sets for net, _ in nets] + [ipaddress.ip_address("9.9.9.9")]
    rows = spark.createDataFrame([(str(a), None, None, "u") for a in asked], "src_ip string, geo_country string, asn long, geo_source string")
    got = {r.src_ip: (r.geo_country, r.asn) for r in ingest.enrich_geo(rows, mmdb.both(*tables)).collect()}
    best = lambda a, nets: max(((n.prefixlen, v) for n, v in nets if n.version == a.version and a in n), key=lambda p: p[0], default=(0, {}))[1]
    assert got == {str(a): (best(a, sets[0]).get("country", {}).get("iso_code"), best(a, sets[1]).get("autonomous_system_number")) for a in asked}


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        mmdb.Database(b"no database")
