import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestgrain.operators.contracts import GateError
from nestgrain.plans import stage
from nestgrain.sources import binary, sinks, tables


def write_png(path, pixels):
    h, w = pixels.shape

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_csv_types_flags_and_bom(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿case_id,x,flag\nc1,1.5,True\nc2,NaN,yes\nc3,,0\n", encoding="utf-8")
    df = tables.read_text_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["case_id", "x", "flag"]
    assert [r["flag"] for r in tables.with_flag(df, "flag").orderBy("case_id").collect()] == [True, True, False]
    (tmp_path / "b.csv").write_text("case_id,x\nc1,1.5\nc2,NaN\nc3,\n")
    typed = tables.read_csv(spark, str(tmp_path / "b.csv"), "case_id string, x double")
    assert [r["x"] for r in typed.orderBy("case_id").collect()] == [1.5, None, None]
    assert tables.column_names(spark, str(tmp_path / "b.csv")) == ["case_id", "x"]
    with pytest.raises(GateError):
        tables.read_single_row(spark, str(tmp_path / "b.csv"))
    (tmp_path / "m.csv").write_text("sensitivity_db,x\n1,2\n")
    assert tables.read_single_row(spark, str(tmp_path / "m.csv")).count() == 1
    with pytest.raises(GateError):
        tables.read_columns(spark, str(tmp_path / "m.csv"), ["sensitivity_db"], label_blind=True)


def test_listing_and_manifest(spark, tmp_path):
    import hashlib

    for name in ("x_dict.npy", "y_thick.npy", "z.txt"):
        (tmp_path / name).write_bytes(name.encode())
    found = tables.file_manifest(spark, str(tmp_path)).toPandas().set_index("name")
    assert found.loc["z.txt", "sha256"] == hashlib.sha256(b"z.txt").hexdigest()
    assert tables.locate_one(spark, str(tmp_path), "*.npy", exclude="THICK").endswith("x_dict.npy")
    assert tables.locate_one(spark, str(tmp_path), "*.csv", required=False) is None
    with pytest.raises(GateError):
        tables.locate_one(spark, str(tmp_path), "*.npy")
    want = spark.createDataFrame([("z.txt", 5, hashlib.sha256(b"z.txt").hexdigest()), ("gone", 1, "x")], "name string, bytes bigint, sha256 string")
    assert [r["name"] for r in tables.verify_manifest(tables.file_manifest(spark, str(tmp_path)), want).collect()] == ["gone"]
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.bin").write_bytes(folder.encode())
    found = tables.file_manifest(spark, str(tmp_path))
    assert {"one/part.bin", "two/part.bin"} <= {r["name"] for r in found.collect()}
    assert tables.verify_manifest(found, found).count() == 0


def test_notebook_and_scan(spark, tmp_path):
    cells = [{"cell_type": "code", "source": ["%%writefile /content/a.py\n", "x = 1\n", "y = 2\n"]},
             {"cell_type": "code", "source": ["%%writefile /content/../b.py\n", "z\n"]},
             {"cell_type": "markdown", "source": ["%%writefile /content/c.py\n"]}, {"cell_type": "code", "source": ["print()\n"]}]
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": cells}, indent=1))
    rows = tables.notebook_cells(spark, str(tmp_path / "n.ipynb"), prefix="/content/").collect()
    assert [(r["target"], r["body"]) for r in rows] == [("a.py", "x = 1\ny = 2\n")]
    docs = spark.createDataFrame([(1, "mail a@b.co"), (2, "fine")], "id int, t string")
    assert [tuple(r) for r in tables.release_scan(docs, "id", "t", {"email": r"\S+@\S+\.\w+"}).collect()] == [(1, "email")]


def test_first_difference(tmp_path):
    for name, body in (("a", b"abcd"), ("b", b"abXd"), ("c", b"ab")):
        (tmp_path / name).write_bytes(body)
    at = lambda x, y: tables.first_difference(tmp_path / x, tmp_path / y, 2)
    assert (at("a", "b"), at("a", "c"), at("a", "a")) == (2, 2, None)


def test_archive_guard(tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("d/a.txt", "1")
    assert tables.safe_extract(tmp_path / "ok.zip", tmp_path / "out") == ["d/a.txt"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../a.txt", "1")
    with pytest.raises(GateError):
        tables.safe_extract(tmp_path / "bad.zip", tmp_path / "out2")


def test_transform_files(spark, tmp_path):
    (tmp_path / "t.tfm").write_text("#File V1.0\nTransform: Affine\nParameters: 1.1 0.2 -0.1 0.9 5 -3\nFixedParameters: 10 20\n")
    r = tables.read_transforms(spark, str(tmp_path / "*.tfm")).first()
    p = np.array([[1.1, 0.2], [-0.1, 0.9]]) @ (np.array([3.0, 4.0]) - [10, 20]) + [5, -3] + [10, 20]
    assert np.allclose([r["a"] * 3 + r["b"] * 4 + r["tx"], r["c"] * 3 + r["d"] * 4 + r["ty"]], p)


def test_npy_chunks(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(1000, 7)).astype("f4")
    np.save(tmp_path / "m.npy", m)
    got = binary.read_npy_matrix(spark, str(tmp_path), "m.npy", rows_per_chunk=128).orderBy("row_index").toPandas()
    assert np.allclose(np.vstack(got["values"]), m) and got.row_index.tolist() == list(range(1000))
    head = binary.npy_headers(spark, str(tmp_path), "m.npy").first()
    assert list(head["shape"]) == [1000, 7] and not head["scalar_object"]
    np.save(tmp_path / "b.npy", np.array([[0, 3], [3, 9]]))
    assert [tuple(r) for r in binary.read_borders(spark, str(tmp_path), "b.npy").orderBy("grp").collect()] == [(0, 0, 3), (1, 3, 9)]
    np.save(tmp_path / "n.npy", np.array(["a", "bcd"]))
    assert [r["name"] for r in binary.read_names(spark, str(tmp_path), "n.npy").orderBy("idx").collect()] == ["a", "bcd"]
    with pytest.raises(GateError):
        binary.read_borders(spark, str(tmp_path), "m.npy")


def test_object_stream(spark, tmp_path):
    rng = np.random.default_rng(1)
    shape = (256, 512)
    images = [rng.normal(size=shape) for _ in range(2)]
    curves = [np.sort(rng.integers(0, 250, (5, 512)), axis=0).astype(float) for _ in range(2)]
    curves[1][0, 3] = -5
    payload = {"scans": [{"image": i, "curves": [[np.float64(v) for v in row] for row in c]} for i, c in zip(images, curves)]}
    np.save(tmp_path / "d.npy", np.array(payload, dtype=object), allow_pickle=True)
    audit = binary.object_stream_audit(spark, str(tmp_path), "d.npy").toPandas().set_index(["kind", "item"])["n"]
    assert audit[("image_shape", "256x512")] == 2 and audit[("opcode", "STOP")] == 1 and audit[("payload_bytes", "8")] == 2 * 5 * 512
    got = binary.read_curves(spark, str(tmp_path), "d.npy").orderBy("scan", "curve").toPandas()
    assert np.allclose(np.vstack(got["values"]), np.vstack(curves))
    prints = binary.read_image_fingerprints(spark, str(tmp_path), "d.npy", 8).orderBy("scan").toPandas()
    s = images[1][::8, ::8].ravel()
    assert np.allclose(prints.fingerprint[1], (s - s.mean()) / s.std())
    df = binary.read_curves(spark, str(tmp_path), "d.npy")
    checks = binary.curve_checks(df, 256).toPandas().set_index("curve").sort_index()
    assert checks.negative.tolist() == [1, 0, 0, 0, 0] and checks.order_violations.sum() == 0 and checks.non_integer.sum() == 0
    derived = spark.createDataFrame(
        [(s, c, [float(v) for v in (curves[s][c + 1] - curves[s][c] if c < 4 else curves[s][4])]) for s in range(2) for c in range(5)],
        "scan bigint, curve int, values array<double>")
    assert tuple(binary.difference_checks(df, derived, 256).first()) == (0, 0, 0)
    wrong = derived.withColumn("values", F.when((F.col("scan") == 0) & (F.col("curve") == 2), F.transform("values", lambda v: v + 1)).otherwise(F.col("values")))
    assert binary.difference_checks(df, wrong, 256).first()["value_mismatches"] == 512
    np.save(tmp_path / "plain.npy", np.zeros(3))
    with pytest.raises(Exception, match="scalar object"):
        binary.read_curves(spark, str(tmp_path), "plain.npy").collect()


def test_scalar_decoding():
    payloads = [np.float64(12.5).tobytes(), np.int64(-5).tobytes(), np.int64(300).tobytes(), np.float64("nan").tobytes(), np.float64(0).tobytes()]
    got = binary.scalar_values(payloads)
    assert got[:3].tolist() == [12.5, -5.0, 300.0] and np.isnan(got[3]) and got[4] == 0 and len(binary.scalar_values([])) == 0


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "broken.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="broken.png"):
        binary.read_images(spark, str(tmp_path)).collect()
    for name, text in (("type.csv", "x,y\n1,2\n2,oops\n"), ("short.csv", "x,y\n1,2\n3\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):
            tables.read_csv(spark, str(tmp_path / name), "x int, y int").collect()
    (tmp_path / "quoted.csv").write_text('x,y\n"a ""b"" c",1\n"two\nlines",2\n')
    assert [r["x"] for r in tables.read_text_csv(spark, str(tmp_path / "quoted.csv"), line_breaks=True).collect()] == ['a "b" c', "two\nlines"]


def test_images(spark, tmp_path):
    pixels = np.arange(48).reshape(6, 8) * 5
    write_png(tmp_path / "p.png", pixels)
    row = binary.read_images(spark, str(tmp_path)).first()
    assert (row["height"], row["width"]) == (6, 8) and row["pixels"] == pixels.ravel().astype(float).tolist()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.123456, "b"), (1, 1.0, "a")], "k int, v double, s string")
    path = str(tmp_path / "out")
    sinks.write_csv(df.orderBy("k"), path, ["s", "v"], digits=4, single_file=True)
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == "s,v\na,1.0000\nb,0.1235\n"
    with pytest.raises(Exception):
        sinks.write_csv(df, path)
    vectors = df.withColumn("vec", F.array("v"))
    sinks.write_vectors(vectors, str(tmp_path / "vec"), "vec")
    assert dict(spark.read.parquet(str(tmp_path / "vec")).dtypes)["vec"] == "array<float>"
    assert sinks.markdown_table(df.select("k").orderBy("k")) == "| k |\n| --- |\n| 1 |\n| 2 |\n"
    with pytest.raises(GateError):
        sinks.markdown_table(df, limit=1)


def test_resume(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, v int")
    assert sinks.process_missing_cases(df.where("case_id = 'a'"), path, "case_id", lambda d: d) == 1
    assert sinks.process_missing_cases(df, path, "case_id", lambda d: d.withColumn("v", F.col("v") * 10)) == 1
    assert sinks.process_missing_cases(df, path, "case_id", lambda d: d) == 0
    assert {tuple(r) for r in spark.read.parquet(path).select("case_id", "v").collect()} == {("a", 1), ("b", 20)}


def test_publish(tmp_path):
    target = tmp_path / "t"
    sinks.publish(target, lambda p: (p / "f").write_text("1"))
    with pytest.raises(FileExistsError):
        sinks.publish(target, lambda p: None)
    with pytest.raises(ValueError):
        sinks.publish(target, lambda p: int("x"), replace=True)
    assert (target / "f").read_text() == "1"
    sinks.publish(target, lambda p: (p / "f").write_text("2"), replace=True)
    assert (target / "f").read_text() == "2"


def test_stage_policy(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(10)

    mark = stage.fingerprint({"a": 1}, {"in": "x"})
    assert mark != stage.fingerprint({"a": 2}, {"in": "x"})
    store = stage.StageStore(spark, tmp_path / "s")
    assert store.run("one", mark, build).count() == 10 and store.run("one", mark, build).count() == 10 and len(calls) == 1
    assert stage.StageStore(spark, tmp_path / "s", "rebuild").run("one", mark, build).count() == 10 and len(calls) == 2
    with pytest.raises(GateError):
        stage.StageStore(spark, tmp_path / "s", "reuse").run("one", "other", build)
    with pytest.raises(GateError):
        store.run("bad", mark, build, lambda df: {"never": False})
    assert store.restore("bad", mark) is None
    folder = next(p for p in (tmp_path / "s").iterdir() if p.is_dir() and p.name.startswith("one"))
    spark.range(3).write.mode("append").parquet(str(folder))
    assert store.restore("one", mark) is None  # tampered output is not reused
    assert json.loads(store.finish().read_text())["stages"][0]["action"] == "built"
    with pytest.raises(ValueError):
        stage.StageStore(spark, tmp_path, "never")


def test_stage_contents_and_uris(spark, tmp_path):
    root = (tmp_path / "far").as_uri()
    store = stage.StageStore(spark, root)
    rows = spark.createDataFrame([(1, {"a": 1}, [1.5]), (2, None, None)], "k int, m map<string,int>, v array<double>")
    assert store.run("one", "f" * 20, lambda: rows).count() == 2
    assert store.restore("one", "f" * 20).count() == 2
    data = next(p for p in (tmp_path / "far").glob("one-*/*.parquet"))
    data.write_bytes(b"\0" * data.stat().st_size)  # same name and size, other contents
    (data.parent / f".{data.name}.crc").unlink()
    with pytest.warns(UserWarning):
        assert store.restore("one", "f" * 20) is None
    (tmp_path / "far" / ".one.json.crc").unlink()
    (tmp_path / "far" / "one.json").write_text("{")
    assert store.restore("one", "f" * 20) is None
    assert store.finish() == f"{root}/run_manifest.json" and (tmp_path / "far" / "run_manifest.json").is_file()


def test_content_digest_sees_values_not_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    assert stage.content_digest(a) == stage.content_digest(a.orderBy("k", ascending=False))
    assert stage.content_digest(a) != stage.content_digest(a.withColumn("k", F.col("k") + 1))
    assert stage.content_digest(a) != stage.content_digest(a.union(a))


def test_manifest_of_odd_folders_and_forbidden_files(spark, tmp_path):
    import hashlib

    folder = tmp_path / "o'k \" %20" / "in"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"one")
    (folder / "b'c.TXT").write_bytes(b"2")
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in tables.file_manifest(spark, str(tmp_path / "o'k \" %20")).collect()}
    assert got == {"in/a.txt": (3, hashlib.sha256(b"one").hexdigest()), "in/b'c.TXT": (1, hashlib.sha256(b"2").hexdigest())}
    files = spark.createDataFrame([("x/a.PT",), ("x.pt/readme",), (".pt",), ("y/panel.png",), ("z/a.tar.pt",), ("plain",)], "f string")
    found = {tuple(r) for r in tables.forbidden_files(files, "f", [".pt"], ["panel.png"]).collect()}
    assert found == {("x/a.PT", "suffix"), ("y/panel.png", "name"), ("z/a.tar.pt", "suffix")}


def test_a_stage_reads_its_source_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def looked_at(value):
        seen.add(1)
        return value

    store = stage.StageStore(spark, tmp_path / "store")
    rows = spark.createDataFrame([(k, {"a": k}) for k in range(50)] + [(None, None)], "v long, m map<string,int>").repartition(4)
    build = lambda: rows.withColumn("v", looked_at("v"))
    built = store.run("one", "mark", build)
    assert seen.value == 51 and built.count() == 51
    again = stage.StageStore(spark, tmp_path / "store").run("one", "mark", build)
    assert seen.value == 51 and again.count() == 51
    assert stage.content_digest(again) == stage.content_digest(rows)


def test_a_long_file_is_hashed_range_by_range(spark, tmp_path, monkeypatch):
    """no task reads more than a range of a file, also behind a mount, and the hash is that of the whole file."""
    import hashlib

    from nestgrain.sources import digests

    monkeypatch.setattr(digests, "RANGE_BYTES", 1000)
    taken = spark.sparkContext.accumulator(0)
    real, starts = digests.hash_ranges, []

    def counted(start, length):
        starts.append((start, length))
        run = real(start, length)

        def seen(batches):
            for batch in run(batches):
                taken.add(sum(start < r["bytes"] for r in batch.to_pylist()))
                yield batch

        return seen

    monkeypatch.setattr(digests, "hash_ranges", counted)
    texts = {"long %20'.bin": bytes(range(256)) * 18, "even.bin": b"ab" * 1000, "one.bin": b"x", "sub/b.bin": b"y" * 1001}
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    want = {name: (len(text), hashlib.sha256(text).hexdigest()) for name, text in texts.items()}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.manifest.link./in", f"file://{tmp_path}")
    for root in (str(tmp_path), "viewfs://manifest/in"):
        starts.clear()
        taken.value = 0
        assert {r["name"]: (r["bytes"], r["sha256"]) for r in tables.file_manifest(spark, root).collect()} == want
        assert starts == [(1000 * k, 1000) for k in range(5)] and taken.value == 5 + 2 + 1 + 2
    monkeypatch.setattr(digests, "can_hash_ranges", lambda root: False)
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in tables.file_manifest(spark, "viewfs://manifest/in").collect()} == want
