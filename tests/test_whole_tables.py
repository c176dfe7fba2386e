"""Queries read all rows, those with 'İ' and nulls too."""

from textrel import queries_ops as q


def test_no_row_is_left_out(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("player", [(1, "Bay, Gulls", "İzmir College"), (2, None, None), (3, "İzmir  Jets", "Bay")], "id bigint, team string, college string")
    put("team", [("İzmir Jets",), (None,), ("Bay Gulls",)], "team_name string")
    put("owner", [(1, "İbrahim Deltegül", None, "Turkish", "2024-01-01"), (2, "İBRAHIM DELTEGÜL", 50, None, "2025-02-01"), (3, "İnci", 40, None, "2025-02-01")], "id bigint, name string, age bigint, nationality string, ingested_at string")
    put("extraction_result", [(1, "c", "owner", [{"name": "İbrahim Deltegül"}]), (2, "c", "owner", [{"name": "Nobody"}])], "result_id bigint, chunk_id string, table_name string, records array<map<string,string>>")
    put("raw_chunks", [("c", "Owner İbrahim Deltegül paid.")], "chunk_id string, content string")
    rows = lambda f: sorted(map(tuple, f(spark, str(tmp_path)).collect()), key=str)
    assert [r[0] for r in rows(q.text_normalized)] == [1, 2, 3]
    assert rows(q.align_apply) == [(1, "Bay Gulls"), (2, None), (3, "İzmir Jets")]
    assert len(rows(q.align_exact)) == 2
    assert {r[1]: r[2] for r in rows(q.upsert_known_only)} == {"İbrahim Deltegül": 50}
    assert {r[1]: r[2] for r in rows(q.upsert_coalesce)} == {"İbrahim Deltegül": 50, "İnci": 40}
    assert [(r[0], r[2]) for r in rows(q.grounded_values)] == [(1, True), (2, False)]
