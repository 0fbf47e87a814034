from rookery.operators import context as C


def test_whole_queries_use_the_default_caps(spark, tmp_path):
    rows = [(k, "p", "\n".join(["word " * 10] * n), 1, n) for k, n in ((1, 100), (2, 399), (3, 500))]
    spark.createDataFrame(rows, "fallback_id bigint, packet_id string, raw_context string, start_line int, end_line int").write.parquet(str(tmp_path / "degraded_fallback.parquet"))
    got = {r["fallback_id"]: (r["returned_lines"], r["reason"]) for r in C.QUERIES["scr_17_literal_slice_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: (100, None), 2: (399, None), 3: (400, "line_cap_exceeded")}
    raw = C.QUERIES["scr_16_raw_fetch_whole"](spark, str(tmp_path)).collect()
    assert [(r["fallback_id"], r["from"], r["to"]) for r in raw] == [(1, 1, 100)]
    for name, new in (("scr_16_raw_fetch", "used <= 7200"), ("scr_17_literal_slice", "want > 400")):
        assert new in C.SQL[f"{name}_whole"] and "% 20" not in C.SQL[f"{name}_whole"]
