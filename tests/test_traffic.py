from floodsift.sources.traffic import generate_traffic, scenario_flows


def test_what_packets_of_a_flow_share_is_made_before_they_are(spark):
    made = generate_traffic(scenario_flows(spark))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    packets, chunks = plan.split("Generate", 1)
    assert "repeat(" not in packets and "repeat(" in chunks
    assert packets.count("unhex(") <= 3


def test_sums_of_a_frame_are_right(spark):
    rows = generate_traffic(scenario_flows(spark), rate_scale=10).select("frame", "total_length").collect()
    assert {r.frame[23] for r in rows} == {6, 17}
    for r in rows:
        packet = bytes(r.frame[14:])
        words = [int.from_bytes((packet + b"\0")[k : k + 2], "big") for k in range(0, len(packet), 2)]
        assert len(packet) == r.total_length
        assert sum(words[:10]) % 0xFFFF == 0
        assert (sum(words[6:]) + packet[9] + len(packet) - 20) % 0xFFFF == 0
