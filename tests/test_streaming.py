from morphlake.streaming import limits


def test_window_state():
    state, rules = {}, ((2, 60),)
    assert [limits.hit(state, t, rules) for t in (0, 1, 2, 59.5, 60, 61, 62)] == [None, None, 58, 1, None, None, 58]


def test_replay_and_stream_agree(spark, tmp_path):
    rows = [(i, f"v{i % 3}", 1000.0 + i * 7 % 50 + i) for i in range(60)]
    e = spark.createDataFrame(rows, "event_id long, key string, ts double")
    want = {}
    state = {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[i] = limits.hit(state.setdefault(k, {}), t, ((2, 30), (3, 60)))
    got = {r.event_id: r.wait for r in limits.replay(e, ((2, 30), (3, 60))).collect()}
    assert got == want and any(w for w in want.values())
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = limits.stream(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), ((2, 30), (3, 60))).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    q.stop()
    assert {r.event_id: r.wait for r in spark.table("limits").collect()} == want


def test_events_without_key_or_time_come_back(spark):
    e = spark.createDataFrame([(1, "a", 1.0), (2, None, 1.0), (3, "a", None), (4, "a", 2.0)], "event_id long, key string, ts double")
    got = {r.event_id: (r.key, r.ts, r.wait) for r in limits.replay(e, ((1, 10),)).collect()}
    assert got == {1: ("a", 1.0, None), 2: (None, 1.0, None), 3: ("a", None, None), 4: ("a", 2.0, 9)}
