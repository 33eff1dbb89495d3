from noteflow.operators import notes


def test_twelve_notes_of_a_chunk_stay(spark):
    rows = [(f"n{i:02d}", ("f",), 1, i / 100) for i in range(15)] + [("z", ("f",), 2, None)]
    df = spark.createDataFrame(rows, "note_id string, source_info struct<file_name: string>, chunk_index int, importance_score double")
    assert {r.note_id for r in notes.per_chunk_limit(df).collect()} == {f"n{i:02d}" for i in range(3, 15)} | {"z"}
