"""Real folders: scanning, probing, sidecars, tables in text, and file actions."""

import json
import random
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import pixels as K
from tagloom.operators import documents as D
from tagloom.operators import ranking as R
from tagloom.sources import files, sinks, tables


@pytest.fixture()
def folder(tmp_path):
    img = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    (tmp_path / "b.png").write_bytes(K.encode_png(img))
    (tmp_path / "a.BMP").write_bytes(K.encode_bmp(img))
    (tmp_path / "g.png").write_bytes(K.encode_png(img[:, :, :1]))
    (tmp_path / "t.png").write_bytes(K.encode_png(np.dstack([img, np.full((4, 6), 9, np.uint8)])))
    (tmp_path / "broken.jpg").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text(" ,")
    (tmp_path / "a b%20.txt").write_text("q")
    (tmp_path / "b.txt").write_text(" x , y,, x\n")
    (tmp_path / "a.json").write_text(json.dumps({"fixed": {"quality": "best"}, "ai_output": {"tags": "p, q", "nl": None}}))
    (tmp_path / "b.json").write_text(json.dumps({"tags": ["m", 5, "n"], "character": "c", "count": 3}))
    (tmp_path / "g.json").write_text("[1]")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.png").write_bytes(K.encode_png(img))
    return str(tmp_path), img


def test_scan_is_one_level_deep_and_reads_no_content(spark, folder):
    path, _ = folder
    df = files.scan_assets(spark, path)
    assert {r.name for r in df.collect()} == {"a.BMP", "b.png", "g.png", "t.png", "broken.jpg"}
    assert {r.ext for r in df.collect()} == {"bmp", "png", "jpg"}
    scan = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert scan and all("content" not in line.split("ReadSchema")[1] for line in scan)
    assert files.scan_assets(spark, path, recursive=True).count() == 6


def test_probe_and_decode(spark, folder):
    path, img = folder
    sizes = {r.path.split("/")[-1]: (r.width, r.height, r.error) for r in files.probe_dimensions(files.read_contents(spark, path)).collect()}
    assert sizes["b.png"] == sizes["a.BMP"] == (6, 4, None)
    assert sizes["broken.jpg"] == (0, 0, "unreadable header")
    rows = {r.name: r for r in files.decode_images(spark, f"{path}/*.[pBj][nMp][gP]").collect()}
    assert (K.to_array(bytes(rows["b.png"].data), 4, 6, 3) == img).all()
    assert (K.to_array(bytes(rows["a.BMP"].data), 4, 6, 3) == img).all()
    assert rows["g.png"].channels == 1 and rows["t.png"].channels == 4
    assert rows["broken.jpg"].error == "cannot decode"


def test_sidecars(spark, folder):
    path, _ = folder
    assets = files.scan_assets(spark, path)
    texts = files.read_texts(spark, path, "*.txt")
    tags = {r.name: r.tags for r in files.load_tags(assets, texts).collect()}
    assert tags["b.png"] == ["x", "y", "x"] and tags["a.BMP"] == []
    captions = {r.name: r.caption for r in files.load_captions(assets, texts).collect()}
    assert captions["b.png"] == " x , y,, x\n" and captions["g.png"] == ""
    states = {r.name: r.status for r in files.load_tag_files(texts).collect()}
    assert states == {"b.txt": "ready", "notes.txt": "skipped", "a b%20.txt": "ready"}
    assert {r.stem.split("/")[-1] for r in texts.collect()} == {"b", "notes", "a b%20"}


def test_documents(spark, folder):
    path, _ = folder
    docs = files.load_tag_docs(files.scan_assets(spark, path), files.read_texts(spark, path, "*.json")).cache()
    rows = {r.name: r for r in docs.collect()}
    assert rows["a.BMP"].format == "full" and rows["a.BMP"].doc.ai_output.tags == ["p", "q"]
    assert rows["b.png"].format == "simplified" and rows["b.png"].doc.ai_output.tags == ["m", "n"]
    assert rows["b.png"].doc.character.name == "c" and rows["b.png"].doc.ai_output["count"] is None
    assert rows["g.png"].format == "unknown" and rows["g.png"].has_json
    assert rows["t.png"].has_json is False
    assert D.dataset_format(docs).first()[0] == "full"


@pytest.mark.parametrize("text,fmt", [
    ('{"fixed": {"quality": 5}}', "unknown"), ('{"ai_output": {"tags": ["a", 1]}}', "unknown"), ('{"ai_output": []}', "unknown"),
    ('{"from_path": {}}', "full"), ('{"ai_output": {"tags": []}}', "full"), ("{}", "simplified"), ("5", "unknown"), ("{", "unknown"),
])
def test_document_formats(spark, text, fmt):
    df = spark.createDataFrame([(text,)], "content string")
    assert D.parse_tag_docs(df).first()["format"] == fmt


def test_flat_and_back_is_stable(spark):
    text = json.dumps({"quality": "q", "character": "c", "appearance": ["a", "b"], "tags": ["t"], "nl": "n"})
    df = D.flat_to_doc(spark.createDataFrame([(text,)], "content string"))
    out = df.select(D.flat_json(D.doc_to_flat(F.col("doc"))).alias("content"))
    again = D.flat_to_doc(out).select(D.flat_json(D.doc_to_flat(F.col("doc")))).first()[0]
    assert json.loads(out.first()[0]) == json.loads(again) == json.loads(text)


def test_artist_gets_one_at_and_ratings_lead(spark):
    words = [("hair", "appearance"), ("hat", "appearance"), ("sky", "environment"), ("solo", "count"), ("hair", "other")]
    tax = D.Taxonomy.load(spark.createDataFrame(words, "keyword string, grp string"))
    picked = [("solo", "general"), ("Long Hair", "general"), ("what", "meta"), ("blue skyline", "general"), ("r1", "rating"), ("q", "quality"),
              ("r2", "rating"), ("@me", "artist"), ("you", "artist"), ("m", "model")]
    df = spark.createDataFrame([(picked,)], "selected array<struct<name:string,category:string>>")
    doc = json.loads(D.build_tag_doc(df, tax).first()["json"])
    assert doc == {
        "fixed": {"quality": "r2, r1, q", "artist": "@me, you"},
        "ai_output": {"count": "solo", "appearance": ["Long Hair"], "tags": ["what", "blue skyline", "m"]},
    }
    flat = json.loads(D.build_flat_doc(df, tax).first()["json"])
    assert list(flat) == ["quality", "count", "artist", "appearance", "tags"]


def test_a_large_taxonomy_is_no_literal_and_equals_a_plain_search(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    words = {(word(rng.randint(3, 9)), rng.choice(["appearance", "environment", "count"])) for _ in range(400)}
    tags = [word(rng.randint(1, 14)).title() for _ in range(300)] + ["", None, "Abcd"]
    more = spark.range(100_000).select(F.concat(F.lit("zz"), F.lpad(F.conv("id", 10, 26), 6, "0")).alias("keyword"), F.lit("environment").alias("grp"))
    table = spark.createDataFrame(list(words), "keyword string, grp string").unionByName(more)
    out = D.classify_tags(spark.createDataFrame([(t,) for t in tags], "tag string"), D.Taxonomy.load(table))
    got = {r["tag"]: r["grp"] for r in out.collect()}

    def plain(tag):
        low = (tag or "").lower()
        for test in (lambda k: k == low, lambda k: len(k) >= 4 and k in low):
            for grp in ("appearance", "environment"):
                if tag is not None and any(g == grp and test(k) for k, g in words):
                    return grp
        return "tags"

    assert got == {t: plain(t) for t in tags} and len(set(got.values())) == 3
    assert "zz000" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_dictionary_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('a,1,10,"x,y"\nb,z,,\n,3,4,q\na,2,7\n  \n"c d",4,5,""\n')
    rows = {r.name: r for r in tables.load_tag_dict(tables.read_lines(spark, str(tmp_path / "d.csv"))).collect()}
    assert set(rows) == {"a", "b", "c d"}
    assert (rows["a"].category, rows["a"].post_count, rows["a"].aliases) == (2, 7, "")
    assert (rows["b"].category, rows["b"].post_count) == (0, 0)


def test_vocabularies(spark, tmp_path):
    (tmp_path / "v.csv").write_text("id,name,category\n9,safe,9\n8,hat,0\n7,odd,42\n")
    rows = tables.load_label_vocab(tables.read_lines(spark, str(tmp_path / "v.csv"))).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [(0, "safe", "rating"), (1, "hat", "general"), (2, "odd", "general")]
    text = json.dumps({"1": {"tag": "b", "category": "Meta"}, "0": {"tag": "a"}})
    rows = tables.load_label_vocab_json(spark.createDataFrame([(text,)], "content string")).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [(0, "a", "general"), (1, "b", "meta")]


def test_translations_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "x"', "ja"), ("c", "d", "ko"), ("z", "y", "zh-CN")]
    cache = spark.createDataFrame(rows, "tag string, translated string, lang string")
    tables.write_translations(cache, str(tmp_path / "out"), files=1)
    part = next(str(p) for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    text = open(part, encoding="utf-8").read()
    assert text == '﻿tag,translated,lang\n"a,b","say ""x""",ja\nc,d,ko\nz,y,zh-CN\n'
    lines = tables.read_lines(spark, part)
    assert tables.check_header(lines).first()[0] is True
    judged = tables.import_translations(lines)
    assert sorted((r.tag, r.translated, r.lang) for r in judged.where("reason is null").collect()) == sorted(rows)


def test_bad_translation_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Tag, Translated,LANG\nx\nx,,ja\nx,y,fr\n\nx,y,ko\n")
    lines = tables.read_lines(spark, str(tmp_path / "t.csv"))
    assert tables.check_header(lines).first()[0] is True
    counts = {r.outcome: r.n for r in tables.import_summary(tables.import_translations(lines)).collect()}
    assert counts == {"too few columns": 1, "empty field": 1, "unknown language": 1, "imported": 1}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "dict")
    one = spark.createDataFrame([("a", 1)], "name string, post_count long")
    tables.replace_dict(one, root, "001")
    tables.replace_dict(tables.current_snapshot(spark, root).withColumn("name", F.lit("b")), root, "002")
    assert tables.current_snapshot(spark, root).first().name == "b"
    with pytest.raises(Exception):
        tables.replace_dict(one, root, "002")


def test_rename_swaps_names(spark, tmp_path):
    for name in ("1.png", "2.png", "0.png"):
        (tmp_path / name).write_text(name)
    plan = R.rename_plan(files.scan_assets(spark, str(tmp_path)), "", 1, 1)
    done = sinks.apply_renames(plan, "t1")
    assert done.where("ok").count() == 3
    assert {p.name: p.read_text() for p in tmp_path.iterdir() if not p.name.startswith(".")} == {"1.png": "0.png", "2.png": "1.png", "3.png": "2.png"}


def test_actions_can_be_repeated(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / "a").write_text("A")
    rows = [("copy", f"{base}/a", f"{base}/x/b"), ("delete", f"{base}/gone", None), ("copy", f"{base}/none", f"{base}/c")]
    manifest = spark.createDataFrame(rows, "action string, src string, dst string")
    for _ in range(2):
        out = {(r.action, r.src.split("/")[-1]): r for r in sinks.apply_manifest(manifest).collect()}
        assert out["copy", "a"].ok and out["delete", "gone"].ok and "FileNotFoundError" in out["copy", "none"].error
    move = spark.createDataFrame([("move", f"{base}/a", f"{base}/m")], "action string, src string, dst string")
    assert all(sinks.apply_manifest(move).first().ok for _ in range(2))
    assert sorted(os.listdir(base)) == ["m", "x"] and os.listdir(f"{base}/x") == ["b"]


def test_export_numbers_go_on_behind_taken_names(spark):
    rows = [("/1/a.png", "a.png"), ("/2/a.png", "a.png"), ("/3/a.png", "a.png"), ("/1/a_2.png", "a_2.png")]
    df = spark.createDataFrame(rows, "path string, name string").withColumns({"bw": F.lit(64), "bh": F.lit(64)})
    from tagloom.operators.buckets import bucket_summary

    out = {r.src: r.dst.split("/")[-1] for r in sinks.export_buckets(df, bucket_summary(df), "/o").collect()}
    assert out == {"/1/a.png": "a.png", "/2/a.png": "a_3.png", "/3/a.png": "a_4.png", "/1/a_2.png": "a_2.png"}


def test_actions_on_one_row_group_are_dealt_to_many_tasks_and_folders(spark, tmp_path, monkeypatch):
    from tagloom.plans.file_queries import apply_manifest
    from tagloom.plans.views import Views

    rows = [(i, None if i == 7 else f"text {i}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    run, tasks, folders = sinks.apply_manifest, [], set()

    def watched(manifest):
        tasks.append(manifest.rdd.getNumPartitions())
        folders.update(os.path.dirname(r.dst) for r in manifest.select("dst").collect())
        return run(manifest)

    monkeypatch.setattr(sinks, "apply_manifest", watched)
    got = {r.action: (r.success_count, r.fail_count) for r in apply_manifest(Views(spark, str(tmp_path))).collect()}
    assert min(tasks) >= 8 and len(folders) == 256
    assert {k: sum(v) for k, v in got.items()} == {"write": 400, "move": 200, "copy": 400}
    assert got["copy"][1] >= 200


def test_a_move_makes_its_folder_once_needed(tmp_path):
    (tmp_path / "a").write_text("A")
    for _ in range(2):
        sinks._act("move", f"{tmp_path}/a", f"{tmp_path}/x/y/b", None)
    assert (tmp_path / "x/y/b").read_text() == "A"
    with pytest.raises(FileNotFoundError):
        sinks._act("move", f"{tmp_path}/a", f"{tmp_path}/z/c", None)
