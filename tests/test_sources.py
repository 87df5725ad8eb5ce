"""Sources and sinks on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.sources import files, sinks


def test_keyed_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('ruta,v,nota\na/1.jpg,1,"x, y"\nb\\2.jpg,,z\na/1.jpg,nan,"two\nlines"\n')
    t = {r.ruta: r for r in files.read_keyed_csv(spark, str(p), "ruta string, v string, nota string, none string", "ruta").collect()}
    assert t["a/1.jpg"].v == "nan" and t["a/1.jpg"].nota == "two\nlines" and t["b\\2.jpg"].v is None and t["b\\2.jpg"].none is None
    assert sorted(r.file for r in files.read_by_basename(spark, str(p), "ruta string, v string", "ruta").collect()) == ["1.jpg", "2.jpg"]
    assert files.read_csv(spark, str(tmp_path / "absent.csv"), "ruta string", optional=True).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_csv(spark, str(tmp_path / "absent.csv"), "ruta string")


def test_queue(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text("orden;id;variedad;clase;caja_real;foto;obj;ancho_cinta\n1;a;n;w;2;f;o.obj;43.8\n2;b;n;w;;f;;wide\n")
    rows = files.read_queue(spark, str(p)).orderBy("orden").collect()
    assert (rows[0].ancho_cinta, rows[0].caja_real, rows[1].ancho_cinta, rows[1].caja_real) == (43.8, 2, None, 0)
    assert files.read_queue(spark, str(p), need_object=True).count() == 1


def test_folders(spark, tmp_path):
    for sub, name in (("Left side", "a.pgm"), ("unknown", "b.pgm")):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / name).write_bytes(b"P5 2 1 255\n\x00\xff")
    fallback = spark.createDataFrame([("b.pgm", "wrap")], "file string, label string")
    got = {r.file: r.label for r in files.folder_labels(spark, str(tmp_path), {"left side": "left"}, "*.pgm", fallback).collect()}
    assert got == {"a.pgm": "left", "b.pgm": "wrap"}
    (tmp_path / "rasgos_1.csv").write_text("archivo,x\nd/a.pgm,1\n")
    assert files.first_table(spark, str(tmp_path)).first().file == "a.pgm"


def test_partitions_round_trip(spark, tmp_path):
    folds = spark.createDataFrame([(k % 3, f"id{k:02d}") for k in range(11)], "fold int, id string")
    doc = sinks.partition_document(folds, "p", 7)
    path = str(tmp_path / "p")
    sinks.write_jsonl(doc, path)
    back = files.read_partitions(spark, path)
    rows = back.collect()
    assert sorted((r.fold, r.id) for r in rows) == sorted((r.fold, r.id) for r in folds.collect())
    assert {r.n_grupos for r in rows} == {11} and len(rows[0].huella_grupos) == 16
    by = {}
    for r in rows:
        by.setdefault(r.fold, []).append(r.id)
    assert all(v == sorted(v) for v in by.values()) and sum(map(len, by.values())) == len({i for v in by.values() for i in v})


def test_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text(json.dumps({"id": "a", "orden": 1, "percibe": {"foto": "f", "avisos": ["w"]}, "decide": {"codigo": 9, "revision": True}, "verdad": {"caja": 2}}) + "\n")
    r = files.read_log(spark, str(p)).first()
    assert (r.orden, r.percibe.avisos, r.decide.codigo, r.verdad.caja, r.costo) == (1, ["w"], 9, 2, None)


def test_pictures(spark, tmp_path):
    a = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    (tmp_path / "a.ppm").write_bytes(b"P6\n# note\n4 4\n255\n" + a.tobytes())
    np.save(tmp_path / "b.npy", a[..., 0])
    (tmp_path / "c.ppm").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got["a.ppm"].rgb == a.tobytes() and (got["b.npy"].h, got["b.npy"].w) == (4, 4) and got["c.ppm"].error
    assert files.shrink(np.full((100, 40, 3), 7, np.uint8), 50).shape == (50, 20, 3)
    m = np.random.default_rng(0).random((5, 7)) > 0.5
    assert (files.unpack_mask(files.pack_mask(m), 5, 7) == m).all()


def test_meshes(spark, tmp_path):
    t = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 0, 1], [1, 0, 1], [0, 1, 1]]], float)
    (tmp_path / "m.stl").write_bytes(files.stl_of(t))
    rows = files.read_meshes(spark, str(tmp_path))
    assert sorted((r.triangle, r.corners) for r in rows.collect()) == [(i, x) for i, x in enumerate(t.tolist())]
    again = sinks.write_meshes(rows, "path").first()
    assert (files.triangles_of(bytes(again.stl)).sum() == t.sum())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "k int, v string")
    sinks.write_csv(df, str(tmp_path / "csv"), ";")
    assert "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv"))).replace("k;v\n", "") == "1;\n2;b\n"
    path = str(tmp_path / "sink")
    assert sinks.append_new(df.limit(1), path, "k") == 1
    assert sinks.append_new(df, path, "k") == 1 and sinks.append_new(df, path, "k") == 0
    assert spark.read.parquet(path).count() == 2
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "log")).count() == 4
    assert "| 2 | b |" in sinks.markdown(df, "T")
    assert {r.name: r.value for r in sinks.figures_in(spark, "kappa 0.705 x", {"kappa": r"kappa ([0-9.]+)", "none": r"none (\d+)"}).collect()} == {"kappa": 0.705, "none": None}


def test_memo(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    key = files.content_key(spark.range(5).withColumn("x", F.col("id") * 2), ["x"], "id")
    assert key == files.content_key(spark.range(5).withColumn("x", F.col("id") * 2).repartition(3), ["x"], "id")
    for _ in range(2):
        assert files.memo(spark, str(tmp_path), key, build).count() == 3
    assert len(made) == 1


def test_documents_reports_and_first_new(spark, tmp_path):
    import json

    path = str(tmp_path / "meta.json")
    for version in (1, 2):
        sinks.write_document(spark, path, {"model": "nodes", "version": version, "curve": [[0.5, 0.9]]})
    assert json.loads(open(path).read()) == {"model": "nodes", "version": 2, "curve": [[0.5, 0.9]]}
    todo, sink = spark.range(10).withColumnRenamed("id", "k"), str(tmp_path / "sink")
    for want in ([0, 1, 2, 3], [4, 5, 6, 7], [8, 9], []):
        step = sinks.first_new(todo, sink, "k", 4, "k")
        assert sorted(r.k for r in step.collect()) == want
        sinks.append_new(step, sink, "k")
    shown = []
    report = sinks.Report(shown.append)
    report.step("Load")
    report.line("3 rows")
    report.save(spark, str(tmp_path / "report"))
    assert shown == report.lines == ["== 1. Load", "3 rows"]
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == shown


def test_a_copy_with_a_broken_part_is_built_again(spark, tmp_path):
    folder, built = str(tmp_path / "memo"), []

    def build():
        built.append(1)
        return spark.range(100).repartition(2)

    assert files.memo(spark, folder, "k", build).count() == 100 and files.memo(spark, folder, "k", build).count() == 100 and len(built) == 1
    part = next((tmp_path / "memo" / "k").glob("*.parquet"))
    raw = bytearray(part.read_bytes())
    raw[4:60] = bytes(56)  # the footer stays whole
    part.write_bytes(raw)
    for crc in (tmp_path / "memo" / "k").glob(".*.crc"):
        crc.unlink()
    assert files.memo(spark, folder, "k", build).count() == 100 and len(built) == 2
