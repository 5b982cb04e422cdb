"""Packet-level column expressions: keys, flags, lengths, subnets."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# IP protocol numbers and TCP flag bits.
TCP, UDP = 6, 17
FIN, SYN, RST = 0x01, 0x02, 0x04
DEFAULT_TCP_HEADER, UDP_HEADER = 20, 8


def is_transport(protocol: Column) -> Column:
    """TCP or UDP."""
    return protocol.isin(TCP, UDP)


def has_flag(tcp_flags: Column, bit: int) -> Column:
    return F.coalesce(tcp_flags, F.lit(0)).bitwiseAND(bit) != 0


def endpoint(ip: Column, port: Column) -> Column:
    return F.struct(ip.alias("ip"), port.alias("port"))


def flow_key(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """Direction-free 5-tuple: the smaller of the two orientations."""

    def oriented(s, d, sp, dp):
        return F.struct(s.alias("ip_a"), d.alias("ip_b"), sp.alias("port_a"), dp.alias("port_b"), protocol.alias("proto"))

    return F.least(oriented(src_ip, dst_ip, src_port, dst_port), oriented(dst_ip, src_ip, dst_port, src_port))


def flow_id(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column) -> Column:
    return F.concat_ws("-", src_ip, dst_ip, src_port.cast("string"), dst_port.cast("string"), protocol.cast("string"))


def tcp_header_size(data_offset: Column) -> Column:
    """Header bytes from the 32-bit-word count; the minimum header if it is 0."""
    return F.when(data_offset > 0, data_offset * 4).otherwise(DEFAULT_TCP_HEADER)


def tcp_payload_v4(ip_total_len: Column, ihl: Column, data_offset: Column) -> Column:
    body = ip_total_len - ihl * 4 - tcp_header_size(data_offset)
    return F.when(ip_total_len == 0, 0).otherwise(F.greatest(F.lit(0), body))


def tcp_payload_v6(segment_len: Column, data_offset: Column) -> Column:
    return F.greatest(F.lit(0), segment_len - tcp_header_size(data_offset))


def udp_payload(udp_len: Column) -> Column:
    return F.when(udp_len == 0, 0).otherwise(F.greatest(F.lit(0), udp_len - UDP_HEADER))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a long; NULL for anything else (IPv6 text for instance)."""
    part = F.split(ip, r"\.")
    number = sum((F.get(part, F.lit(i)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)),
                 F.get(part, F.lit(0)).try_cast("long") * (1 << 24))
    return F.when(F.size(part) == 4, number)


def in_subnet(ip: Column, cidr: str) -> Column:
    """Whether an address column lies inside ``a.b.c.d/n`` or an IPv6 prefix."""
    net = ipaddress.ip_network(cidr, strict=False)
    if net.version == 4:
        first, last = int(net.network_address), int(net.broadcast_address)
        return F.coalesce(ipv4_number(ip).between(first, last), F.lit(False))
    base, shift = int(net.network_address) >> (128 - net.prefixlen) if net.prefixlen else 0, 128 - net.prefixlen

    @F.pandas_udf(BooleanType())
    def inside(addresses: pd.Series) -> pd.Series:
        def test(text):
            try:
                value = ipaddress.IPv6Address(text)
            except (ValueError, TypeError):
                return False
            return shift == 128 or int(value) >> shift == base

        unique = {a: test(a) for a in addresses.unique()}
        return addresses.map(unique).astype(bool)

    return F.when(ip.contains(":"), inside(ip)).otherwise(False)


def filter_net(packets: DataFrame, cidr: str | None) -> DataFrame:
    """Packets with either endpoint in the subnet; all of them without one."""
    if not cidr:
        return packets
    return packets.filter(in_subnet(F.col("src_ip"), cidr) | in_subnet(F.col("dst_ip"), cidr))
