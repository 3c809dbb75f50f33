import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators.history import recent_artifacts
from plumbline.plans import load
from plumbline.sources import catalog, csv_repair, encoding, readers


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def guess(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(csv_repair.guess_delimiter(F.col("t"))).first()[0]


def test_guess_delimiter(spark):
    assert guess(spark, "a,b\n1,2\n") == ","
    assert guess(spark, "a;b;c\r\n1;2;3\r\n\r\n4,1;5;6") == ";"
    assert guess(spark, "a\tb\n1\t2") == "\t"
    assert guess(spark, "a|b,c\n1|2\n3|4") == "|"
    assert guess(spark, "a,b;c\n1,2;3") == ","
    assert guess(spark, "plain") is None and guess(spark, "") is None
    assert guess(spark, "x\n" * 10 + "a;b\n" * 50) is None


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_repaired_csv_finds_separator_and_pads_ragged_lines(spark, tmp_path, separator):
    text = "\n".join(separator.join(r) for r in [["id", "name", "v"], ["1", "x", "2.5"], ["2", "nan", ""], ["3", "z"]]) + "\n"
    df = csv_repair.read_repaired_csv(spark, write(tmp_path / "a.csv", text))
    assert df.columns == ["id", "name", "v"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "x", "2.5"), ("2", "nan", None), ("3", "z", None)]


def test_header_in_second_row_and_repeated_names(spark, tmp_path):
    path = write(tmp_path / "b.csv", "report,,\ncity,city,n\nRome,Bari,1\nOslo,Bodo,2\n")
    df = csv_repair.read_repaired_csv(spark, path)
    assert df.columns == ["city", "city_1", "n"] and df.count() == 2
    assert csv_repair.header_choice(["Unnamed: 0", "b"], [["1", "2"], ["k", "b"], ["3", "4"]]) == (["k", "b"], 2)
    assert csv_repair.header_choice(["a", "b"], [["x", "y"]]) == (["a", "b"], 0)
    assert csv_repair.dedupe_names(["a", "b", "a", "a"]) == ["a", "b", "a_1", "a_2"]


def test_encodings(spark, tmp_path):
    write(tmp_path / "1.txt", "naïve €".encode())
    write(tmp_path / "2.txt", "naïve € “x”".encode("cp1252"))
    write(tmp_path / "3.txt", b"caf\xc3\xa9 \x81 ok")
    rows = {os.path.basename(r["path"]): (r["content"], r["encoding"]) for r in encoding.read_whole_files(spark, str(tmp_path)).collect()}
    assert rows["1.txt"] == ("naïve €", "utf-8") and rows["2.txt"] == ("naïve € “x”", "cp1252")
    assert rows["3.txt"] == ("café  ok", "utf-8-lossy")
    assert len(encoding.C1_BYTES) == len(encoding.C1_TEXT) == 27
    assert bytes(encoding.C1_BYTES).decode("cp1252") == encoding.C1_TEXT


def test_csv_reader_and_na_spellings(spark, tmp_path):
    path = write(tmp_path / "c.csv", "a;b;c\n1;NA;x\n2;4.5;null\n")
    assert dict(readers.read_csv(spark, path, sep=";").dtypes)["a"] == "int"
    df = readers.read_csv(spark, path, readers.NA_VALUES, sep=";")
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, None, "x"), (2, 4.5, None)]


def test_json_shapes(spark, tmp_path):
    rows = readers.read_json(spark, write(tmp_path / "a.json", '[{"a": 1, "b": "x"}, {"a": 2}]'))
    assert rows.count() == 2 and set(rows.columns) == {"a", "b"}
    one = readers.read_json(spark, write(tmp_path / "b.json", '{"meta": {"k": 1}, "items": [{"v": 1}, {"v": 2}, {"v": 3}]}'))
    assert one.count() == 1
    assert readers.read_json(spark, str(tmp_path / "b.json"), record_path="items").count() == 3
    bad = readers.read_json(spark, write(tmp_path / "c.json", "{not json"))
    assert bad.columns == ["content", "metadata"] and bad.first()["content"] == "{not json"


def test_text_reader(spark, tmp_path):
    path = write(tmp_path / "t.txt", "word " * 450)
    fixed = readers.read_text(spark, path)
    assert fixed.columns == ["content", "metadata", "length"] and fixed.agg(F.sum("length")).first()[0] == 2250
    assert readers.read_text(spark, path, overlap=200).agg(F.max("length")).first()[0] <= 1000
    with pytest.raises(ValueError):
        readers.read_text(spark, write(tmp_path / "blank.txt", " \n "))


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + b"\xff\0\0" * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    write(tmp_path / "a.png", png(4, 2))
    write(tmp_path / "b.png", png(8, 6))
    write(tmp_path / "c.png", b"no image")
    row = readers.image_profile(readers.read_images(spark, str(tmp_path))).first()
    assert (row["num_images"], row["avg_width"], row["avg_height"]) == (3, 6.0, 4.0) and row["avg_file_size_kb"] > 0


def test_dispatch(spark, tmp_path):
    assert readers.dataset_name("/x/Sales 2024.CSV") == "sales 2024"
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "a.docx")
    with pytest.raises(NotImplementedError):
        readers.read_dataset(spark, "a.pdf")


def test_normalized_csv_round_trip(spark, tmp_path):
    path = write(tmp_path / "d.csv", "id|join_date|note\n1|2024-01-02| a \n2|soon|nan\n")
    for fmt in ("parquet", "csv"):
        df = csv_repair.normalize_csv(spark, path, str(tmp_path / fmt), fmt).orderBy("id")
        rows = df.collect()
        assert [r["id"] for r in rows] == [1, 2] and rows[1]["note"] is None and rows[0]["note"] == "a"
        assert rows[0]["join_date"].year == 2024 and rows[1]["join_date"] is None


def test_artifact_listing(spark, tmp_path):
    for i in range(7):
        path = tmp_path / f"sales_2024010{i}_101010.html"
        write(path, "x")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    write(tmp_path / "sales_20240101_101010.png", "x")
    write(tmp_path / "other.html", "x")
    rows = recent_artifacts(readers.list_artifacts(spark, str(tmp_path))).collect()
    assert {r["dataset"] for r in rows} == {"sales"}
    assert sorted(r["path"][-11:-5] and r["path"].split("_")[-2] for r in rows) == [f"2024010{i}" for i in range(2, 7)]


def test_catalog_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    catalog.put(df, "tiny_table")
    assert catalog.get(spark, "tiny_table").count() == 1 and "tiny_table" in catalog.names(spark)
    assert catalog.column_catalogs(spark, ["tiny_table"]).count() == 2
    with pytest.raises(KeyError):
        catalog.get(spark, "missing_table")
    log = catalog.Log(spark, str(tmp_path / "log"))
    for start in (0, 15):
        rows = spark.range(start, start + 15).selectExpr("'d' AS dataset", "id AS session_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts")
        log.append("sessions", rows)
    assert sorted(r["session_id"] for r in log.sessions().collect()) == list(range(10, 30))
    for domain, at in (("old", "2024-01-01"), ("new", "2024-02-01")):
        log.append("datasets", spark.sql(f"SELECT 'd' AS dataset, timestamp'{at}' AS load_time, '{domain}' AS domain"))
    assert [r["domain"] for r in log.datasets().collect()] == ["new"]


def test_load_pipeline(spark, tmp_path):
    path = write(tmp_path / "Sleep.csv", "Person ID,Sleep Duration,Gender\n1,7.5,F\n2,,M\n3,6.5,\n")
    loaded = load.load_dataset(spark, path)
    record = loaded.record.first()
    assert (record["dataset"], record["domain"], record["n_rows"], record["n_cols"]) == ("sleep", "Sleep/Health", 3, 3)
    assert loaded.questions.count() == 8 and loaded.column_profile.count() == 3
    assert sorted(r["Sleep Duration"] for r in loaded.clean.collect()) == [6.5, 7.0, 7.5]
    assert "Unknown" in [r["Gender"] for r in loaded.clean.collect()]
    text = load.load_dataset(spark, write(tmp_path / "notes.txt", "The research study used machine learning. " * 40))
    assert text.record.first()["domain"] == "Academic/Research" and "cleaned_content" in text.clean.columns


def test_json_lines_keep_all_rows_and_return_the_rest(spark, tmp_path):
    lines = write(tmp_path / "l.json", '{"a":1}\n{"a":2}\n\n{"a":3}\n')
    assert sorted(r["a"] for r in readers.read_json(spark, lines).collect()) == [1, 2, 3]
    assert readers.json_rejects(spark, lines).count() == 0
    broken = write(tmp_path / "m.json", '{"a":1}\n{"a":2\n{"a":3}\n')
    good = readers.read_json(spark, broken)
    assert sorted(r["a"] for r in good.collect()) == [1, 3] and good.count() == 2
    rest = readers.json_rejects(spark, broken).collect()
    assert [r["content"] for r in rest] == ['{"a":2'] and rest[0]["metadata"]["source"].endswith("m.json")


def test_surplus_cells_are_returned_not_cut(spark, tmp_path):
    path = write(tmp_path / "s.csv", "a,b\n1,2\n3,4,5\n6,7,\n8\n")
    assert sorted(tuple(r) for r in csv_repair.read_repaired_csv(spark, path).collect()) == [("1", "2"), ("6", "7"), ("8", None)]
    (left,) = csv_repair.surplus_lines(spark, path).collect()
    assert [c for c in left["cells"] if c is not None] == ["3", "4", "5"]


def test_codes_stay_text(spark):
    df = spark.createDataFrame([("12D", "1.5", "1e3"), ("5F", ".5", "-2")], "a string, b string, c string")
    assert dict(csv_repair.typed(df).dtypes) == {"a": "string", "b": "double", "c": "double"}


def test_renamed_columns_are_unique():
    assert csv_repair.dedupe_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert csv_repair.dedupe_names(["a_1", "a", "a", "a"]) == ["a_1", "a", "a_2", "a_3"]
