"""Files, index tables and stored records."""

from pyspark.sql import functions as F

from scriptorium.sources import files, index, records


def test_directory_scan_and_loading(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("olá\nmundo")
    (tmp_path / "b.csv").write_text('name,note\nAna,"x, y"\nBeto,z\n')
    (tmp_path / "c.csv").write_text("other\n1\n")
    (tmp_path / "d.json").write_text('[{"t": "um"}, {"t": "dois"}]')
    (tmp_path / "e.bin").write_text("resto")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.txt").write_text("não lido")
    found = files.scan_directory(spark, str(tmp_path), ["txt", "csv"])
    assert sorted((r.extension, r.length) for r in found.collect()) == [("csv", 8), ("csv", 28), ("txt", 10)]
    docs = files.load_documents(spark, str(tmp_path)).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1))
    got = sorted((r.file, r.content) for r in docs.collect())
    assert got == [
        ("a.TXT", "olá\nmundo"), ("b.csv", "name: Ana\nnote: x, y"), ("b.csv", "name: Beto\nnote: z"), ("c.csv", "other: 1"),
        ("d.json", '{"t":"dois"}'), ("d.json", '{"t":"um"}'), ("e.bin", "resto"),
    ]
    smallest = files.smallest(found, 100).first()
    assert smallest.path.endswith("c.csv")


def chunk_rows(spark, ids):
    return spark.createDataFrame([(f"c{i}", i, "src", f"text {i}") for i in ids], "chunk_id string, doc_id long, source string, content string")


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "index")
    index.append_chunks(chunk_rows(spark, [1, 2, 2]), path)
    index.append_chunks(chunk_rows(spark, [2, 3]), path)
    index.append_chunks(chunk_rows(spark, [2, 3]), path)
    stored = spark.read.parquet(path)
    assert sorted(r.doc_id for r in stored.collect()) == [1, 2, 3]
    assert index.index_figures(stored).first().total_chunks == 3


def test_reindex_policy(spark, tmp_path):
    path = str(tmp_path / "index")
    for ids, force, wanted in (([1], False, 1), ([1, 2], False, 1), ([1, 2, 3], True, 3)):
        index.reindex(chunk_rows(spark, ids), path, force)
        assert spark.read.parquet(path).count() == wanted


def test_export_and_examples(spark, tmp_path):
    index.export_index(chunk_rows(spark, [1, 2]), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    rows = spark.createDataFrame([(1, "train"), (2, "eval")], "id long, split string")
    index.write_examples(rows, str(tmp_path / "ex"))
    assert spark.read.parquet(str(tmp_path / "ex")).where("split = 'eval'").count() == 1


def test_flat_metadata_cuts_nested_fields(spark):
    df = spark.sql("SELECT 1 AS a, true AS b, array(repeat('x', 200)) AS c, date'2020-01-02' AS d")
    row = index.flat_metadata(df, 100).first()
    assert (row.a, row.b, len(row.c_str), row.d_str) == (1, True, 100, "2020-01-02")
    assert len(index.flat_metadata(df).first().c_str) == 204


def test_feedback_round_trip(spark):
    df = spark.sql("SELECT 1 AS id, map('clarity', 4, 'depth', 2) AS aspects, timestamp'2024-05-06 07:08:09.123456' AS ts")
    back = records.feedback_from_store(records.feedback_to_store(df)).first()
    assert back == df.first()


def test_log_lines(spark):
    df = spark.createDataFrame([('{"level": "ERROR", "message": "m", "duration_ms": 3.5}',)], "value string")
    row = records.parse_log(df).first()
    assert (row.level, row.message, row.timestamp, row.extra) == ("ERROR", "m", None, {"duration_ms": "3.5"})


def test_csv_with_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,name\n1,"x\ny, ""z""",ana\n\n2,,beto\n')
    (tmp_path / "b.csv").write_text("only\n" + "\n".join(map(str, range(50))) + "\n")
    (tmp_path / "c.json").write_text("not json")
    (tmp_path / "d.csv").write_text("")
    docs = files.load_documents(spark, str(tmp_path)).withColumn("file", F.regexp_extract("path", r"([^/]+)$", 1)).collect()
    assert sorted(r.content for r in docs if r.file == "a.csv") == ['id: 1\nnote: x\ny, "z"\nname: ana', "id: 2\nnote: \nname: beto"]
    assert sorted((r.part, r.content) for r in docs if r.file == "b.csv") == [(i + 1, f"only: {i}") for i in range(50)]
    unread = sorted(r.path.rsplit("/", 1)[1] for r in files.unread_documents(spark, str(tmp_path)).collect())
    assert unread == ["c.json"]


def test_given_tables_survive_csv_json_and_text(spark, tmp_path):
    nation = spark.read.parquet("/root/testdata/sf0.001/nation.parquet")
    names = nation.columns
    want = sorted("\n".join(f"{c}: {'' if r[c] is None else r[c]}" for c in names) for r in nation.collect())
    for form in ("csv", "json"):
        folder = str(tmp_path / form)
        (nation.coalesce(1).write.option("header", "true").option("escape", '"').csv(folder) if form == "csv" else nation.coalesce(2).write.json(folder))
    got = files.load_documents(spark, str(tmp_path / "csv"))
    assert sorted(r.content for r in got.collect() if r.path.endswith(".csv")) == want
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null").limit(5)
    texts.coalesce(1).write.text(str(tmp_path / "text"))
    loaded = [r.content for r in files.load_documents(spark, str(tmp_path / "text")).collect() if r.path.endswith(".txt")]
    assert "".join(loaded).rstrip("\n") == "\n".join(r.text for r in texts.collect()).rstrip("\n")
