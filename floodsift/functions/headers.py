"""Header fields by layer.

Each function takes the zero-padded head of a frame (:func:`binary.padded_head`), the
true frame size and the byte offset of the layer, and returns named columns.
They are plain expressions, so a query that needs one field evaluates one field.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from floodsift.functions.binary import as_column, be, be_int, cut, padded_head

# EtherTypes, IP protocol numbers, and the codes of the next layer.
ETHERTYPE_VLAN = 0x8100
ETHERTYPES = {"IPV4": 0x0800, "IPV6": 0x86DD, "ARP": 0x0806}
ETHERTYPE_CODES = {"UNKNOWN": 0, "IPV4": 1, "IPV6": 2, "ARP": 4}
PROTOCOLS = {"ICMP": 1, "TCP": 6, "UDP": 17}
PROTOCOL_CODES = {"UNKNOWN": 0, "ICMP": 1, "TCP": 2, "UDP": 4}

Fields = dict[str, Column]


def carries(head: Column, at: Column | int, number: int, size: int) -> Column:
    """True where the ``size`` bytes at ``at`` are ``number``; cheaper than reading the field."""
    return cut(head, at, size) == F.unhex(F.lit(f"{number:0{2 * size}X}"))


def ethernet(head: Column, size: Column) -> Fields:
    tagged = carries(head, 12, ETHERTYPE_VLAN, 2)
    offset = F.when(tagged, 18).otherwise(14)
    return {
        "dst_mac": be(head, 0, 6),
        "src_mac": be(head, 6, 6),
        "vlan_v": tagged,
        "vlan": F.when(tagged, be_int(head, 14, 2)).otherwise(0),
        "ethertype": F.when(tagged, be_int(head, 16, 2)).otherwise(be_int(head, 12, 2)),
        "header_len": offset,
        "error": size < offset,
    }


def ipv4(head: Column, size: Column, offset: Column | int) -> Fields:
    offset = as_column(offset)
    first = be_int(head, offset, 1)
    words = first.bitwiseAND(15)
    fragment = be_int(head, offset + 6, 2)
    left = size - offset
    return {
        "version": F.shiftright(first, 4),
        "header_length": words,
        "type_of_service": be_int(head, offset + 1, 1),
        "total_length": be_int(head, offset + 2, 2),
        "identification": be_int(head, offset + 4, 2),
        "flags": F.shiftright(fragment, 13),
        "fragment_offset": fragment.bitwiseAND(0x1FFF),
        "time_to_live": be_int(head, offset + 8, 1),
        "protocol": be_int(head, offset + 9, 1),
        "header_checksum": be_int(head, offset + 10, 2),
        "source_ip": be(head, offset + 12, 4),
        "destination_ip": be(head, offset + 16, 4),
        "header_len": words * 4,
        "error": (left < 20) | (left < words * 4),
    }


def tcp(head: Column, size: Column, offset: Column | int) -> Fields:
    offset = as_column(offset)
    lengths = be_int(head, offset + 12, 1)
    words = F.shiftright(lengths, 4)
    left = size - offset
    return {
        "source_port": be_int(head, offset, 2),
        "destination_port": be_int(head, offset + 2, 2),
        "sequence_number": be(head, offset + 4, 4),
        "acknowledgment_number": be(head, offset + 8, 4),
        "data_offset": words,
        "reserved": lengths.bitwiseAND(15),
        "flags": be_int(head, offset + 13, 1),
        "window_size": be_int(head, offset + 14, 2),
        "checksum": be_int(head, offset + 16, 2),
        "urgent_pointer": be_int(head, offset + 18, 2),
        "header_len": words * 4,
        "error": (left < 20) | (left < words * 4),
    }


def udp(head: Column, size: Column, offset: Column | int) -> Fields:
    offset = as_column(offset)
    return {
        "source_port": be_int(head, offset, 2),
        "destination_port": be_int(head, offset + 2, 2),
        "length": be_int(head, offset + 4, 2),
        "checksum": be_int(head, offset + 6, 2),
        "header_len": F.lit(8),
        "error": (size - offset) < 8,
    }


def _struct(fields: Fields) -> Column:
    return F.struct(*[column.alias(name) for name, column in fields.items()])


def decode_ethernet(frame: Column) -> Column:
    """The Ethernet layer of a frame as a STRUCT."""
    return _struct(ethernet(padded_head(frame), F.length(frame)))


def decode_ipv4(frame: Column, offset: Column | int = 14) -> Column:
    """An IPv4 header at ``offset`` as a STRUCT."""
    return _struct(ipv4(padded_head(frame), F.length(frame), offset))


def decode_tcp(frame: Column, offset: Column | int) -> Column:
    """A TCP header at ``offset`` as a STRUCT."""
    return _struct(tcp(padded_head(frame), F.length(frame), offset))


def decode_udp(frame: Column, offset: Column | int) -> Column:
    """A UDP header at ``offset`` as a STRUCT."""
    return _struct(udp(padded_head(frame), F.length(frame), offset))


def _class_of(value: Column, numbers: dict[str, int]) -> Column:
    names = F.lit("UNKNOWN")
    for name, number in numbers.items():
        names = F.when(value == number, name).otherwise(names)
    return names


def _code_of(name: Column, codes: dict[str, int]) -> Column:
    code = F.lit(0)
    for label, number in codes.items():
        code = F.when(name == label, number).otherwise(code)
    return code


def ethertype_class(ethertype: Column) -> Column:
    return _class_of(ethertype, ETHERTYPES)


def ethertype_code(ethertype: Column) -> Column:
    return _code_of(ethertype_class(ethertype), ETHERTYPE_CODES)


def protocol_class(protocol: Column) -> Column:
    return _class_of(protocol, PROTOCOLS)


def protocol_code(protocol: Column) -> Column:
    return _code_of(protocol_class(protocol), PROTOCOL_CODES)
