"""The same questions as plain SQL over the given tables, stated in the direct way.

Sketches count every packet in every row, windows come from dense series, and
headers are cut from zero-padded hexadecimal text.
"""

from __future__ import annotations

from floodsift.plans import inputs
from floodsift.sources import traffic

PRIME = 65521
WINDOW_US = inputs.SETTINGS.window_us
BIN_US = inputs.BIN_US


def _with(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


def _instant(ts: str = "ts") -> str:
    return f"epoch_us({ts})"


PACKETS = f"packets AS ({inputs.PACKETS.format(events='events')})"
FRAMES = f"frames AS ({inputs.FRAMES.format(packets='packets')})"
FRAME_PARTS = (PACKETS, FRAMES)


# --- headers from hexadecimal text ---------------------------------------------------


def _field(offset: str, size: int, text: str = "h") -> str:
    return f"('0x' || substr({text}, ({offset}) * 2 + 1, {2 * size}))::BIGINT"


ETH = f"""eth0 AS (
  SELECT link_id, packet_id, ts, rpad(frame_hex, greatest(length(frame_hex), 400)::INTEGER, '0') AS h,
         length(frame_hex) // 2 AS size
  FROM frames),
eth1 AS (SELECT *, {_field("12", 2)} = 33024 AS vlan_v FROM eth0),
eth AS (
  SELECT *, {_field("0", 6)} AS dst_mac, {_field("6", 6)} AS src_mac,
    CASE WHEN vlan_v THEN {_field("14", 2)} ELSE 0 END AS vlan,
    CASE WHEN vlan_v THEN {_field("16", 2)} ELSE {_field("12", 2)} END AS ethertype,
    CASE WHEN vlan_v THEN 18 ELSE 14 END AS l3,
    size < CASE WHEN vlan_v THEN 18 ELSE 14 END AS eth_error
  FROM eth1)"""

IP = f"""ip0 AS (
  SELECT *, {_field("l3", 1)} AS first_byte, {_field("l3 + 6", 2)} AS fragment
  FROM eth WHERE NOT eth_error AND ethertype = 2048),
ip AS (
  SELECT *, first_byte >> 4 AS version, first_byte & 15 AS ihl,
    {_field("l3 + 1", 1)} AS type_of_service, {_field("l3 + 2", 2)} AS total_length,
    {_field("l3 + 4", 2)} AS identification, fragment >> 13 AS ip_flags,
    fragment & 8191 AS fragment_offset, {_field("l3 + 8", 1)} AS time_to_live,
    {_field("l3 + 9", 1)} AS protocol, {_field("l3 + 10", 2)} AS header_checksum,
    {_field("l3 + 12", 4)} AS source_ip, {_field("l3 + 16", 4)} AS destination_ip,
    l3 + (first_byte & 15) * 4 AS l4,
    size - l3 < 20 OR size - l3 < (first_byte & 15) * 4 AS ip_error
  FROM ip0)"""

L4 = f"""tcp AS (
  SELECT *, {_field("l4", 2)} AS source_port, {_field("l4 + 2", 2)} AS destination_port,
    {_field("l4 + 4", 4)} AS sequence_number, {_field("l4 + 8", 4)} AS acknowledgment_number,
    {_field("l4 + 12", 1)} >> 4 AS data_offset, {_field("l4 + 12", 1)} & 15 AS reserved,
    {_field("l4 + 13", 1)} AS flags, {_field("l4 + 14", 2)} AS window_size,
    {_field("l4 + 16", 2)} AS checksum, {_field("l4 + 18", 2)} AS urgent_pointer,
    size - l4 < 20 OR size - l4 < ({_field("l4 + 12", 1)} >> 4) * 4 AS error
  FROM ip WHERE NOT ip_error AND protocol = 6),
udp AS (
  SELECT *, {_field("l4", 2)} AS source_port, {_field("l4 + 2", 2)} AS destination_port,
    {_field("l4 + 4", 2)} AS length, {_field("l4 + 6", 2)} AS checksum, size - l4 < 8 AS error
  FROM ip WHERE NOT ip_error AND protocol = 17)"""

# One row per frame: its class, where its payload starts, its features.
CLASSED = """l4 AS (
  SELECT packet_id, source_port, destination_port, error, l4 + data_offset * 4 AS payload FROM tcp
  UNION ALL
  SELECT packet_id, source_port, destination_port, error, l4 + 8 AS payload FROM udp),
classed AS (
  SELECT e.link_id, e.packet_id, e.ts, f.frame_hex, e.size, e.l3, i.l4, i.protocol,
    i.source_ip, i.destination_ip, i.total_length, i.ip_error,
    coalesce(t.source_port, 0) AS source_port, coalesce(t.destination_port, 0) AS destination_port,
    coalesce(t.error, false) AS l4_error, coalesce(t.payload, i.l4, e.l3) AS payload,
    CASE WHEN e.eth_error OR coalesce(i.ip_error, false) OR coalesce(t.error, false) THEN 'malformed'
         WHEN i.packet_id IS NULL THEN 'unknown' ELSE 'judged' END AS packet_class
  FROM eth e JOIN frames f USING (packet_id) LEFT JOIN ip i USING (packet_id)
    LEFT JOIN l4 t USING (packet_id))"""

DECODED = (*FRAME_PARTS, ETH, IP, L4, CLASSED)


# --- windows ---------------------------------------------------------------------------


LINK_MEAN = "SELECT link_id, (sum(volume) // count(*))::BIGINT AS threshold FROM vol GROUP BY link_id"
# Both links over 30 days.
OVERALL_MEAN = f"""SELECT link_id, (SELECT sum(total_length) // {2 * 30 * 24 * inputs.HOUR_US // WINDOW_US}
  FROM packets)::BIGINT AS threshold FROM vol GROUP BY link_id"""
STREAM_THRESHOLD = f"""SELECT link_id, (SELECT count(*) * {inputs.MEAN_LENGTH} // {inputs.MONTH_WINDOWS}
  FROM events)::BIGINT AS threshold FROM vol GROUP BY link_id"""


def _windows(source: str, window_us: int | str = WINDOW_US, threshold: str = LINK_MEAN) -> str:
    """From ``source`` (link_id, packet_id, ts, features) to the state of every window."""
    return f"""pw AS (
  SELECT p.*, ({_instant("p.ts")} - a.first_us) // {window_us} AS w
  FROM {source} p JOIN (SELECT link_id, min({_instant()}) AS first_us FROM {source} GROUP BY link_id) a
    USING (link_id)),
spine AS (
  SELECT link_id, unnest(range(0, last_w + 1)) AS w
  FROM (SELECT link_id, max(w) AS last_w FROM pw GROUP BY link_id)),
vol AS (
  SELECT s.link_id, s.w, coalesce(sum(pw.total_length), 0)::BIGINT AS volume
  FROM spine s LEFT JOIN pw ON pw.link_id = s.link_id AND pw.w = s.w GROUP BY s.link_id, s.w),
flagged AS (
  SELECT link_id, w, volume, volume > m.threshold AS is_over
  FROM vol JOIN ({threshold}) m USING (link_id)),
state AS (
  SELECT *, coalesce(lag(is_over) OVER win, false) AS mode,
    coalesce(sum(CASE WHEN is_over THEN 0 ELSE 1 END)
      OVER (win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS generation
  FROM flagged WINDOW win AS (PARTITION BY link_id ORDER BY w))"""


def _hash(key: str, row: str, width: int) -> str:
    return f"((({row} + 1) * (({key}) % {PRIME})) % {PRIME}) % {width}"


# Every packet under its three packed keys.
KEYED = """keyed AS (
  SELECT pw.link_id, pw.w, pw.packet_id, s.mode, s.generation, k.dim, k.packed
  FROM pw JOIN state s USING (link_id, w),
  LATERAL (VALUES
    (1, source_ip::HUGEINT + destination_ip::HUGEINT * 4294967296),
    (2, destination_port::HUGEINT + destination_ip::HUGEINT * 65536),
    (3, source_ip::HUGEINT + total_length::HUGEINT * 4294967296)) AS k(dim, packed))"""

ROWED = f"""rowed AS (
  SELECT *, ({_hash("packed", "row_no", 16384)})::INTEGER AS bucket,
    (packed % {PRIME})::BIGINT AS residue
  FROM keyed, range(0, 8) AS r(row_no)),
counters AS (
  SELECT link_id, generation, dim, row_no, bucket, count(*) AS cnt
  FROM rowed WHERE NOT mode GROUP BY ALL)"""

JUDGED = """asked AS (
  SELECT q.link_id, q.packet_id, q.dim, min(coalesce(c.cnt, 0)) AS est
  FROM rowed q LEFT JOIN counters c
    ON c.link_id = q.link_id AND c.generation = q.generation - 1 AND c.dim = q.dim
      AND c.row_no = q.row_no AND c.bucket = q.bucket
  WHERE q.mode GROUP BY ALL),
scores AS (
  SELECT link_id, packet_id,
    max(CASE WHEN dim = 1 THEN est END) AS est_sipdip,
    max(CASE WHEN dim = 2 THEN est END) AS est_dportdip,
    max(CASE WHEN dim = 3 THEN est END) AS est_siplen,
    sum(est)::BIGINT AS score
  FROM asked GROUP BY link_id, packet_id)"""


def _verdicts(discard_threshold: int = 0) -> str:
    return f"""verdicts AS (
  SELECT pw.link_id, pw.packet_id, pw.w, st.mode, est_sipdip, est_dportdip, est_siplen, score,
    NOT st.mode OR score > {discard_threshold} AS pass
  FROM pw JOIN state st USING (link_id, w) LEFT JOIN scores USING (link_id, packet_id))"""


def _judge(
    source: str, window_us: int = WINDOW_US, discard_threshold: int = 0, threshold: str = LINK_MEAN
) -> tuple[str, ...]:
    return (_windows(source, window_us, threshold), KEYED, ROWED, JUDGED, _verdicts(discard_threshold))


def _filtered(threshold: str = LINK_MEAN) -> tuple[str, ...]:
    return (
        *DECODED,
        "good AS (SELECT * FROM classed WHERE packet_class = 'judged')",
        *_judge("good", threshold=threshold),
        """kept AS (
  SELECT c.link_id, c.packet_id, c.ts, c.frame_hex
  FROM classed c LEFT JOIN verdicts v USING (link_id, packet_id)
  WHERE c.packet_class = 'unknown' OR v.pass)""",
    )


FILTERED = _filtered()

SUMMARY = """SELECT link_id, mode, count(*) AS packets, sum(pass::INT)::BIGINT AS passed,
  sum((NOT pass)::INT)::BIGINT AS dropped, coalesce(sum(score), 0)::BIGINT AS score_sum
FROM verdicts GROUP BY link_id, mode"""


# --- words and beats -------------------------------------------------------------------

WORDS = """words AS (
  SELECT link_id, packet_id, word_no, words,
    rpad(substr(frame_hex, word_no * 128 + 1, 128), 128, '0') AS data_hex,
    word_no = words - 1 AS end_of_packet,
    (CASE WHEN word_no = words - 1 THEN length(frame_hex) // 2 - word_no * 64 ELSE 0 END)::INTEGER
      AS end_of_packet_len,
    row_number() OVER (PARTITION BY link_id ORDER BY packet_id, word_no) - 1 AS seq
  FROM (SELECT *, unnest(range(0, words)) AS word_no
        FROM (SELECT *, greatest((length(frame_hex) + 127) // 128, 1) AS words FROM frames)))"""

BEATS = """beats AS (
  SELECT link_id, seq, lpad(hex(
      CASE WHEN word_no = 0 THEN 128 ELSE 0 END
      + CASE WHEN end_of_packet THEN 64 + ((64 - end_of_packet_len) & 63) ELSE 0 END), 2, '0')
    || data_hex AS beat_hex
  FROM words)"""

PACKET_NO = """row_number() OVER (PARTITION BY link_id ORDER BY packet_id) - 1"""

REALIGNED = f"""parsed AS (
  SELECT *, {PACKET_NO} AS packet_no, packet_id % 3 = 1 AS error_drop,
    CASE WHEN packet_id % 5 = 0 AND length(frame_hex) > 128 THEN 64 ELSE 0 END
      + 2 * (7 + packet_id % 3) AS consumed
  FROM frames),
rest AS (
  SELECT link_id, packet_no, substr(frame_hex, consumed * 2 + 1) AS h FROM parsed WHERE NOT error_drop)"""


# --- generated traffic -------------------------------------------------------------------


def _traffic(name: str, attack_seconds: tuple[int, ...]) -> str:
    seconds = ", ".join(str(s) for s in attack_seconds)
    base = inputs.FLOWS.format(supplier="supplier")
    fold = "(({0} >> 16) + ({0} & 65535))"
    ends = "(source_ip >> 16) + (source_ip & 65535) + (destination_ip >> 16) + (destination_ip & 65535)"

    def checksum(total: str) -> str:
        return f"(65535 - {fold.format(fold.format(f'({total})'))})"

    payload = "(size // 2) * fill * 257 + (size % 2) * fill * 256"
    common = f"{ends} + protocol + segment + source_port + destination_port + {payload}"
    udp = checksum(f"{common} + segment")

    def hexed(value: str, size: int) -> str:
        return f"lpad(hex(({value})::BIGINT), {2 * size}, '0')"

    return f"""{name}_base AS ({base}),
{name}_flows AS (
  SELECT *, 1 AS sources, 120 AS fill, [0, 1, 2] AS seconds FROM {name}_base
  UNION ALL BY NAME
  SELECT link_id, max(flow_id) + 1 AS flow_id, 17 AS protocol, {traffic.mac_number(traffic.FLOOD_SOURCE_MAC)} AS source_mac,
    destination_mac, {traffic.ip_number(traffic.FLOOD_SOURCE_IP)} AS source_ip, destination_ip, {traffic.FLOOD[2]} AS source_port,
    {traffic.FLOOD[1]} AS destination_port, {traffic.FLOOD[3]} AS size, sum(rate)::BIGINT AS rate, {traffic.FLOOD_SOURCES} AS sources, 88 AS fill,
    [{seconds}] AS seconds
  FROM {name}_base GROUP BY link_id, destination_mac, destination_ip),
{name}_slots AS (
  SELECT *, unnest(range(0, pps)) AS n
  FROM (SELECT *, coalesce(sum(pps) OVER (PARTITION BY link_id ORDER BY second, flow_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
        FROM (SELECT *, unnest(seconds) AS second, rate // 8 // size AS pps FROM {name}_flows))),
{name}_packets AS (
  SELECT link_id, (base + n)::BIGINT AS packet_id,
    second * 1000000 + (n * 1000000) // pps AS ts_us,
    source_mac + CASE WHEN sources > 1 THEN n % 256 ELSE 0 END AS source_mac, destination_mac,
    source_ip + n % sources AS source_ip, destination_ip, source_port, destination_port,
    protocol, size, fill, CASE WHEN protocol = 6 THEN 20 ELSE 8 END + size AS segment
  FROM {name}_slots),
{name} AS (
  SELECT link_id, packet_id, ts_us, make_timestamp(ts_us::BIGINT) AS ts, source_ip, destination_ip,
    destination_port, (segment + 20)::BIGINT AS total_length,
    concat({hexed("destination_mac", 6)}, {hexed("source_mac", 6)}, '08004500',
      {hexed("segment + 20", 2)}, '0001000040', {hexed("protocol", 1)},
      {hexed(checksum(f"17664 + 1 + 16384 + segment + 20 + protocol + {ends}"), 2)},
      {hexed("source_ip", 4)}, {hexed("destination_ip", 4)},
      {hexed("source_port", 2)}, {hexed("destination_port", 2)},
      CASE WHEN protocol = 6
        THEN concat('000000000000000050022000', {hexed(checksum(f"{common} + 20482 + 8192"), 2)}, '0000')
        ELSE concat({hexed("segment", 2)}, {hexed(f"CASE WHEN {udp} = 0 THEN 65535 ELSE {udp} END", 2)})
        END,
      repeat(hex(fill), size)) AS frame_hex
  FROM {name}_packets)"""


# --- replays -------------------------------------------------------------------------------


def _replay(depth: int, width: int) -> str:
    row_hash = _hash("payload", "row_no", width)
    return _with(
        f"ops AS ({inputs.HASH_OPS.format(events='events')})",
        """epochs AS (
  SELECT *, sum((kind = 'clear')::INT) OVER (PARTITION BY sketch_id ORDER BY seq) AS epoch FROM ops)""",
        f"""counted AS (
  SELECT sketch_id, seq, kind, sum((kind = 'insert')::INT)
    OVER (PARTITION BY sketch_id, epoch, row_no, {row_hash} ORDER BY seq) AS cnt
  FROM epochs, range(0, {depth}) AS r(row_no) WHERE kind <> 'clear')""",
        final="""SELECT sketch_id, seq, min(cnt)::BIGINT AS count
FROM counted WHERE kind = 'query' GROUP BY sketch_id, seq""",
    )


ROLLING = _with(
    f"ops AS ({inputs.ROLLING_OPS.format(events='events')})",
    """modes AS (
  SELECT *, sum((kind = 'change_roles')::INT) OVER win AS generation,
    coalesce(last_value(CASE WHEN kind = 'set_mode' THEN payload END IGNORE NULLS) OVER win, 0) AS mode
  FROM ops WINDOW win AS (PARTITION BY sketch_id ORDER BY seq))""",
    f"""hashed AS (
  SELECT *, {_hash("payload", "row_no", 1024)} AS bucket
  FROM modes, range(0, 4) AS r(row_no) WHERE kind = 'input')""",
    """counters AS (
  SELECT sketch_id, generation, row_no, bucket, count(*) AS cnt
  FROM hashed WHERE mode = 0 GROUP BY ALL)""",
    final="""SELECT q.sketch_id, q.seq, min(coalesce(c.cnt, 0))::BIGINT AS count
FROM hashed q LEFT JOIN counters c ON c.sketch_id = q.sketch_id AND c.generation = q.generation - 1
  AND c.row_no = q.row_no AND c.bucket = q.bucket
WHERE q.mode = 1 GROUP BY q.sketch_id, q.seq""",
)


def _ranked(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT link_id, frame_hex, row_number() OVER (PARTITION BY link_id ORDER BY packet_id) AS pos
  FROM {source})"""


def _compare(left: str, right: str) -> tuple[tuple[str, ...], str]:
    parts = (_ranked("lefts", left), _ranked("rights", right))
    final = """SELECT coalesce(l.link_id, r.link_id) AS link_id, count(l.pos) AS left_packets,
  count(r.pos) AS right_packets,
  min(CASE WHEN l.frame_hex IS DISTINCT FROM r.frame_hex THEN coalesce(l.pos, r.pos) END)
    AS first_difference
FROM lefts l FULL JOIN rights r ON l.link_id = r.link_id AND l.pos = r.pos GROUP BY 1"""
    return parts, final


def _comparison(*before: str, left: str, right: str) -> str:
    parts, final = _compare(left, right)
    return _with(*before, *parts, final=final)


PACKET_WINDOWS = (PACKETS, _windows("packets"))
VERDICTS = (PACKETS, *_judge("packets"))

ORACLES: dict[str, str] = {
    "frames_scan": _with(
        *FRAME_PARTS, final=f"SELECT link_id, packet_id, {_instant()} AS ts_us, frame_hex FROM frames"
    ),
    "frames_roundtrip": _with(
        *FRAME_PARTS, final=f"SELECT link_id, packet_id, {_instant()} AS ts_us, frame_hex FROM frames"
    ),
    "captures_scan": _with(
        *FRAME_PARTS, final=f"SELECT link_id, {_instant()} AS ts_us, frame_hex FROM frames"
    ),
    "generate_traffic": _with(
        _traffic("traffic", inputs.FLOOD_SECONDS),
        final="""SELECT link_id, packet_id, ts_us::BIGINT AS ts_us, frame_hex, source_ip, destination_ip,
  destination_port, total_length FROM traffic""",
    ),
    "frames_to_words": _with(
        *FRAME_PARTS,
        WORDS,
        final="SELECT link_id, seq, data_hex, end_of_packet, end_of_packet_len FROM words",
    ),
    "words_to_frames": _with(
        *FRAME_PARTS, final=f"SELECT link_id, {PACKET_NO} AS packet_no, frame_hex FROM frames"
    ),
    "realign_words": _with(
        *FRAME_PARTS,
        REALIGNED,
        final="""SELECT link_id, packet_no, word_no,
  rpad(substr(h, word_no * 128 + 1, 128), 128, '0') AS data_hex, word_no = words - 1 AS end_of_packet,
  (CASE WHEN word_no = words - 1 THEN length(h) // 2 - word_no * 64 ELSE 0 END)::INTEGER
    AS end_of_packet_len
FROM (SELECT *, unnest(range(0, words)) AS word_no
      FROM (SELECT *, greatest((length(h) + 127) // 128, 1) AS words FROM rest))""",
    ),
    "beats_encode": _with(
        *FRAME_PARTS, WORDS, BEATS, final="SELECT link_id, seq, beat_hex FROM beats"
    ),
    "beats_decode": _with(
        *FRAME_PARTS,
        WORDS,
        BEATS,
        final="""SELECT link_id, seq, substr(beat_hex, 3) AS data_hex, flag & 64 <> 0 AS end_of_packet,
  (CASE WHEN flag & 64 <> 0 THEN 64 - (flag & 63) ELSE 0 END)::INTEGER AS end_of_packet_len
FROM (SELECT *, ('0x' || substr(beat_hex, 1, 2))::INTEGER AS flag FROM beats)""",
    ),
    "byte_swap": _with(
        *FRAME_PARTS,
        final="""SELECT link_id, packet_id, array_to_string(list_reverse(list_transform(
  range(0, length(frame_hex) // 2), lambda i: substr(frame_hex, i * 2 + 1, 2))), '') AS swapped_hex
FROM frames""",
    ),
    "complete_frames": _with(
        *FRAME_PARTS,
        final="""SELECT link_id, count(*) AS frames, sum(length(frame_hex) // 2)::BIGINT AS bytes
FROM (SELECT *, max(packet_id) OVER (PARTITION BY link_id) AS last_id FROM frames)
WHERE packet_id < last_id GROUP BY link_id""",
    ),
    "decode_ethernet": _with(
        *FRAME_PARTS,
        ETH,
        final="""SELECT link_id, packet_id, dst_mac, src_mac, vlan_v, vlan::INTEGER AS vlan,
  ethertype::INTEGER AS ethertype, l3::INTEGER AS header_len, eth_error AS error FROM eth""",
    ),
    "decode_ipv4": _with(
        *FRAME_PARTS,
        ETH,
        IP,
        final="""SELECT link_id, packet_id, version::INTEGER AS version, ihl::INTEGER AS header_length,
  type_of_service::INTEGER AS type_of_service, total_length::INTEGER AS total_length,
  identification::INTEGER AS identification, ip_flags::INTEGER AS flags,
  fragment_offset::INTEGER AS fragment_offset, time_to_live::INTEGER AS time_to_live,
  protocol::INTEGER AS protocol, header_checksum::INTEGER AS header_checksum, source_ip,
  destination_ip, (ihl * 4)::INTEGER AS header_len, ip_error AS error FROM ip""",
    ),
    "decode_tcp": _with(
        *FRAME_PARTS,
        ETH,
        IP,
        L4,
        final="""SELECT link_id, packet_id, source_port::INTEGER AS source_port,
  destination_port::INTEGER AS destination_port, sequence_number, acknowledgment_number,
  data_offset::INTEGER AS data_offset, reserved::INTEGER AS reserved, flags::INTEGER AS flags,
  window_size::INTEGER AS window_size, checksum::INTEGER AS checksum,
  urgent_pointer::INTEGER AS urgent_pointer, (data_offset * 4)::INTEGER AS header_len, error FROM tcp""",
    ),
    "decode_udp": _with(
        *FRAME_PARTS,
        ETH,
        IP,
        L4,
        final="""SELECT link_id, packet_id, source_port::INTEGER AS source_port,
  destination_port::INTEGER AS destination_port, length::INTEGER AS length,
  checksum::INTEGER AS checksum, 8::INTEGER AS header_len, error FROM udp""",
    ),
    "class_counts": _with(
        *FRAME_PARTS,
        ETH,
        IP,
        final="""SELECT e.link_id,
  CASE e.ethertype WHEN 2048 THEN 'IPV4' WHEN 34525 THEN 'IPV6' WHEN 2054 THEN 'ARP' ELSE 'UNKNOWN' END
    AS ethertype_class,
  CASE e.ethertype WHEN 2048 THEN 1 WHEN 34525 THEN 2 WHEN 2054 THEN 4 ELSE 0 END AS ethertype_code,
  CASE i.protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP'
    ELSE CASE WHEN i.packet_id IS NOT NULL THEN 'UNKNOWN' END END AS protocol_class,
  CASE i.protocol WHEN 1 THEN 1 WHEN 6 THEN 2 WHEN 17 THEN 4
    ELSE CASE WHEN i.packet_id IS NOT NULL THEN 0 END END AS protocol_code,
  count(*) AS frames
FROM eth e LEFT JOIN (SELECT * FROM ip WHERE NOT ip_error) i USING (packet_id)
WHERE NOT e.eth_error GROUP BY ALL""",
    ),
    "l4_dispatch": _with(
        *DECODED,
        final="""SELECT link_id, packet_id, protocol::INTEGER AS protocol,
  source_port::INTEGER AS source_port, destination_port::INTEGER AS destination_port, l4_error AS error
FROM classed WHERE NOT ip_error""",
    ),
    "feature_vectors": _with(
        *DECODED,
        final="""SELECT link_id, packet_id, source_ip, destination_ip,
  destination_port::INTEGER AS destination_port, total_length
FROM classed WHERE packet_class = 'judged'""",
    ),
    "ip_text_roundtrip": _with(
        PACKETS,
        final="""SELECT packet_id, concat_ws('.', source_ip >> 24, (source_ip >> 16) & 255,
    (source_ip >> 8) & 255, source_ip & 255) AS source_text,
  concat_ws('.', destination_ip >> 24, (destination_ip >> 16) & 255,
    (destination_ip >> 8) & 255, destination_ip & 255) AS destination_text,
  source_ip, destination_ip FROM packets""",
    ),
    "payload_offsets": _with(
        *DECODED,
        final="""SELECT link_id, packet_id, l3::INTEGER AS l3_offset, l4::INTEGER AS l4_offset,
  payload::INTEGER AS payload_offset, (size - payload)::INTEGER AS payload_bytes
FROM classed WHERE packet_class <> 'malformed'""",
    ),
    "malformed_report": _with(
        *FRAME_PARTS,
        ETH,
        IP,
        L4,
        final="""SELECT link_id, layer, count(*) AS frames, sum(bad::INT)::BIGINT AS malformed FROM (
  SELECT link_id, 'ethernet' AS layer, eth_error AS bad FROM eth
  UNION ALL SELECT link_id, 'ipv4', ip_error FROM ip
  UNION ALL SELECT link_id, 'tcp', error FROM tcp
  UNION ALL SELECT link_id, 'udp', error FROM udp) GROUP BY link_id, layer""",
    ),
    "residues": _with(
        PACKETS,
        final=f"""SELECT packet_id, source_ip % {PRIME} AS residue32,
  (destination_ip * 65536 + destination_port) % {PRIME} AS residue48,
  ((source_ip::HUGEINT * 4294967296 + destination_ip) % {PRIME})::BIGINT AS residue64 FROM packets""",
    ),
    "universal_hash": _with(
        PACKETS, final=f"SELECT packet_id, (7 * source_ip + 1234) % {PRIME} AS hash FROM packets"
    ),
    "key_residues": _with(
        PACKETS,
        final=f"""SELECT packet_id,
  ((source_ip::HUGEINT + destination_ip::HUGEINT * 4294967296) % {PRIME})::BIGINT AS sipdip,
  ((destination_port::HUGEINT + destination_ip::HUGEINT * 65536) % {PRIME})::BIGINT AS dportdip,
  ((source_ip::HUGEINT + total_length::HUGEINT * 4294967296) % {PRIME})::BIGINT AS siplen
FROM packets""",
    ),
    "hash_bucket_counts": _with(
        PACKETS,
        final=f"""SELECT ({_hash("source_ip", "0", 512)})::INTEGER AS bucket, count(*) AS cnt
FROM packets GROUP BY 1""",
    ),
    "counter_wrap": _with(
        PACKETS,
        final=f"""SELECT ({_hash("source_ip", "0", 16)})::INTEGER AS bucket, count(*) AS cnt,
  count(*) % 256 AS wrapped FROM packets GROUP BY 1""",
    ),
    "cms_build": _with(
        *PACKET_WINDOWS,
        KEYED,
        ROWED,
        final="""SELECT link_id, generation, dim, row_no::INTEGER AS "row", bucket, cnt FROM counters""",
    ),
    "cms_query": _with(
        *PACKET_WINDOWS,
        KEYED,
        ROWED,
        final="""SELECT q.link_id, q.generation - 1 AS generation, q.dim, q.residue,
  min(coalesce(c.cnt, 0)) AS estimate
FROM rowed q LEFT JOIN counters c ON c.link_id = q.link_id AND c.generation = q.generation - 1
  AND c.dim = q.dim AND c.row_no = q.row_no AND c.bucket = q.bucket
WHERE q.mode GROUP BY q.link_id, q.generation, q.dim, q.residue""",
    ),
    "cms_hash_params": _with(
        PACKETS,
        f"""keyed AS (
  SELECT link_id, k.dim, (k.packed % {PRIME})::BIGINT AS residue
  FROM packets, LATERAL (VALUES
    (1, source_ip::HUGEINT + destination_ip::HUGEINT * 4294967296),
    (2, destination_port::HUGEINT + destination_ip::HUGEINT * 65536),
    (3, source_ip::HUGEINT + total_length::HUGEINT * 4294967296)) AS k(dim, packed))""",
        f"""rowed AS (
  SELECT link_id, dim, residue, row_no, ((a * residue + b) % {PRIME}) % {inputs.PARAMETRISED.width} AS bucket
  FROM keyed, (VALUES {", ".join(f"({row}, {a}::BIGINT, {b}::BIGINT)" for row, (a, b) in enumerate(inputs.PARAMETRISED.rows))})
    AS r(row_no, a, b))""",
        "counters AS (SELECT link_id, dim, row_no, bucket, count(*) AS cnt FROM rowed GROUP BY ALL)",
        final="""SELECT link_id, dim, residue, min(cnt) AS estimate
FROM (SELECT DISTINCT * FROM rowed) JOIN counters USING (link_id, dim, row_no, bucket) GROUP BY link_id, dim, residue""",
    ),
    "heavy_hitters": _with(
        *PACKET_WINDOWS,
        """pairs AS (
  SELECT pw.link_id, pw.w, k.dim, k.key_low, k.key_high, k.packed
  FROM pw, LATERAL (VALUES
    (1, source_ip, destination_ip, source_ip::HUGEINT + destination_ip::HUGEINT * 4294967296),
    (2, destination_port::BIGINT, destination_ip,
      destination_port::HUGEINT + destination_ip::HUGEINT * 65536),
    (3, source_ip, total_length, source_ip::HUGEINT + total_length::HUGEINT * 4294967296))
    AS k(dim, key_low, key_high, packed))""",
        f"""slots AS (
  SELECT *, {_hash("packed", "row_no", 16384)} AS bucket FROM pairs, range(0, 8) AS r(row_no))""",
        """cells AS (
  SELECT link_id, w, dim, row_no, bucket, count(*) AS cnt FROM slots GROUP BY ALL)""",
        """hits AS (
  SELECT s.link_id, s.w, s.dim, s.key_low, s.key_high, min(c.cnt) AS estimate
  FROM slots s JOIN cells c ON c.link_id = s.link_id AND c.w = s.w AND c.dim = s.dim
    AND c.row_no = s.row_no AND c.bucket = s.bucket GROUP BY ALL)""",
        final=f"""SELECT link_id, w, dim, rank::INTEGER AS "rank", key_low, key_high, estimate FROM (
  SELECT *, row_number() OVER (PARTITION BY link_id, w, dim
    ORDER BY estimate DESC, key_low, key_high) AS rank
  FROM hits WHERE estimate > {inputs.HITTERS_ABOVE}) WHERE rank <= {inputs.HITTERS_TOP}""",
    ),
    "hashtab_replay": _replay(1, 512),
    "cms_replay": _replay(4, 512),
    "rolling_cms_replay": ROLLING,
    "bytes_per_bin": _with(
        *DECODED,
        final=f"""SELECT link_id, bin, sum(total_length)::BIGINT AS bytes, bin * {BIN_US} AS start_us FROM (
  SELECT c.*, ({_instant("c.ts")} - first_us) // {BIN_US} AS bin
  FROM classed c JOIN (SELECT link_id, arg_min({_instant()}, packet_id) AS first_us
                       FROM frames GROUP BY link_id) f USING (link_id))
WHERE NOT ip_error GROUP BY link_id, bin""",
    ),
    "window_volume": _with(
        *PACKET_WINDOWS, final='SELECT link_id, w, volume, is_over AS "over" FROM state'
    ),
    "window_modes": _with(
        *PACKET_WINDOWS, final="SELECT link_id, w, mode, generation FROM state"
    ),
    "baseline_window": _with(
        *PACKET_WINDOWS,
        final="""SELECT q.link_id, q.w, q.generation, l.w AS baseline_w
FROM state q LEFT JOIN state l
  ON l.link_id = q.link_id AND l.generation = q.generation - 1 AND NOT l.mode WHERE q.mode""",
    ),
    "tick_volume": _with(
        f"ticks AS ({inputs.TICKS.format(events='events')})",
        final=f"""SELECT s.w, coalesce(v.volume, 0)::BIGINT AS volume,
  coalesce(v.volume, 0) > {inputs.TICK_THRESHOLD} AS "over"
FROM (SELECT unnest(range(0, (max(tick) + 1) // {inputs.TICK_WINDOW})) AS w FROM ticks) s
LEFT JOIN (SELECT tick // {inputs.TICK_WINDOW} AS w, sum(sample) AS volume FROM ticks GROUP BY 1) v
  USING (w)""",
    ),
    "verdicts": _with(*VERDICTS, final="SELECT * FROM verdicts"),
    "query_scores": _with(*VERDICTS, final="SELECT packet_id, score FROM verdicts WHERE mode"),
    "filter_metrics": _with(
        *VERDICTS,
        final="""SELECT link_id, w, mode, sum((NOT mode)::INT)::BIGINT AS inserts,
  sum(mode::INT)::BIGINT AS queries, count(*) AS processed, sum(pass::INT)::BIGINT AS output
FROM verdicts GROUP BY link_id, w, mode""",
    ),
    "verdict_summary": _with(*VERDICTS, final=SUMMARY),
    "verdict_summary_strict": _with(
        PACKETS, *_judge("packets", discard_threshold=2), final=SUMMARY
    ),
    "filtered_packets": _with(
        *FILTERED, final=f"SELECT link_id, packet_id, {_instant()} AS ts_us, frame_hex FROM kept"
    ),
    "scenario_filter": _comparison(
        _traffic("flooded", inputs.FLOOD_SECONDS),
        _traffic("expected", inputs.FLOOD_SECONDS[:1]),
        *_judge("flooded", window_us=1_000_000),
        "passed AS (SELECT f.* FROM flooded f JOIN verdicts v USING (link_id, packet_id) WHERE v.pass)",
        left="passed",
        right="expected",
    ),
    "packet_ordinals": _with(
        PACKETS, final=f"SELECT link_id, packet_id, {PACKET_NO} AS ordinal FROM packets"
    ),
    "retimestamp": _with(
        PACKETS,
        final=f"""SELECT link_id, packet_id, round((idx * 0.05 + 1) * 1000000)::BIGINT AS ts_us
FROM (SELECT *, {PACKET_NO} AS idx FROM packets)""",
    ),
    "compare_captures": _comparison(*FILTERED, left="frames", right="kept"),
    "stream_window_volume": _with(
        PACKETS,
        _windows("packets", threshold=STREAM_THRESHOLD),
        final="""SELECT link_id, w, sum(total_length)::BIGINT AS volume, any_value(is_over) AS "over"
FROM pw JOIN flagged USING (link_id, w) GROUP BY link_id, w""",
    ),
    "stream_idle_windows": _with(
        PACKETS,
        _windows(
            "packets",
            f"(SELECT {inputs.MONTH_US} // greatest(count(*) // 4, 1) FROM events)",
            f"SELECT DISTINCT link_id, {inputs.SHORT_THRESHOLD}::BIGINT AS threshold FROM vol",
        ),
        final="""SELECT link_id, w, mode, generation FROM state
WHERE (link_id, w) NOT IN (SELECT (link_id, w) FROM pw)""",
    ),
    "stream_verdicts": _with(
        PACKETS,
        _windows("packets", threshold=OVERALL_MEAN),
        KEYED,
        ROWED,
        JUDGED,
        _verdicts(),
        final="SELECT * FROM verdicts",
    ),
    "stream_late_packets": _with(
        PACKETS,
        f"""parts AS (
  SELECT link_id, packet_id, {_instant()} AS us, {inputs.stream_part(_instant(), True)} AS part FROM packets)""",
        """anchors AS (
  SELECT link_id, min(us) AS first_us FROM parts p
  WHERE part = (SELECT min(part) FROM parts q WHERE q.link_id = p.link_id) GROUP BY link_id)""",
        f"""closed AS (
  SELECT l.link_id, b.part, floor((max(us) - first_us)::DOUBLE / {WINDOW_US}) - 1 AS line
  FROM (SELECT unnest(range(0, {inputs.STREAM_BATCHES})) AS part) b, parts l JOIN anchors USING (link_id)
  WHERE l.part < b.part GROUP BY l.link_id, b.part, first_us)""",
        final=f"""SELECT link_id, packet_id, w::BIGINT AS w
FROM (SELECT *, floor((us - first_us)::DOUBLE / {WINDOW_US}) AS w FROM parts JOIN anchors USING (link_id))
LEFT JOIN closed USING (link_id, part)
WHERE w <= coalesce(line, -1)""",
    ),
    "stream_frames_filter": _with(
        *_filtered(STREAM_THRESHOLD), final=f"SELECT link_id, packet_id, {_instant()} AS ts_us, frame_hex FROM kept"
    ),
    "expand_decisions": _with(
        PACKETS,
        f"decisions AS ({inputs.DECISIONS.format(events='events')})",
        """spans AS (
  SELECT *, sum(greatest(x, 1)) OVER (PARTITION BY link_id ORDER BY decision_seq) AS stop FROM decisions)""",
        f"numbered AS (SELECT link_id, packet_id, {PACKET_NO} AS ordinal FROM packets)",
        final="""SELECT n.link_id, n.packet_id, n.ordinal, s.x > 0 AS pass
FROM numbered n JOIN (SELECT link_id, x, unnest(range((stop - greatest(x, 1))::BIGINT, stop::BIGINT)) AS ordinal
  FROM spans) s USING (link_id, ordinal)""",
    ),
}
