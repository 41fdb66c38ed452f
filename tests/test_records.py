from concordat.operators import records
from concordat.plans import voting


def test_leaves_of_wrapped_records_and_rows_without_any(spark, tmp_path):
    rows = [(1, '{"a": [1, null]}'), (2, '```json\n{"a": 1}\n```'), (3, 'Here it is: {"a": ""} Done.'), (4, '{"a": 1'), (5, None)]
    frame = spark.createDataFrame(rows, "response_id long, response_json string")
    assert sorted(tuple(r)[:2] for r in records.flattened(frame, "response_id", "response_json").collect()) == [(1, "a[0]"), (1, "a[1]"), (2, "a"), (3, "a")]
    frame.write.parquet(f"{tmp_path}/response.parquet")
    assert sorted(tuple(r) for r in voting.agg_14_field_counts(spark, str(tmp_path)).collect()) == [(1, 2, 1), (2, 1, 1), (3, 1, 0), (4, 0, 0), (5, 0, 0)]
