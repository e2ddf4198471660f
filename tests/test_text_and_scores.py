"""Replies, requests, translations, score selection, features and detections."""

import json

import pytest
from pyspark.sql import functions as F

from tagloom.functions.geometry import letterbox
from tagloom.operators import clusters as C
from tagloom.operators import detections as X
from tagloom.operators import enrichment as E
from tagloom.operators import maintenance as M
from tagloom.operators import scoring as S
from tagloom.operators import statistics as ST


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("reply,tags", [
    ("a, b", ["a", "b"]), ("here:\nab, cd\r\nxy, zw\r\n", ["xy", "zw"]), ("long line with no comma\na,b", ["a", "b"]),
    ("no\ncommas", ["no\ncommas"]), (" , ", None), ("é,é\nabc,d", ["abc", "d"]), ("é,é\nab,d", ["é", "é"]),
])
def test_tag_replies(spark, reply, tags):
    assert one(spark, reply, E.parse_tag_reply) == tags


@pytest.mark.parametrize("reply,want", [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('```\n[1]```', "[1]"),
    ('```json\n{"a": 1}', '{"nl":"```json\\n{\\"a\\": 1}"}'), ("some words", '{"nl":"some words"}'), ("```", '{"nl":"```"}'),
])
def test_document_replies(spark, reply, want):
    assert one(spark, reply, lambda c: E.parse_doc_reply(c, flat=True)) == want


def test_requests_leave_out_limits(spark):
    full = json.loads(one(spark, "hi", lambda c: E.build_request(c, "m", 0.3, 5, 1.0, F.lit("sys"))))
    assert full["max_tokens"] == 5 and full["top_p"] == 1.0 and [m["role"] for m in full["messages"]] == ["system", "user"]
    assert set(json.loads(one(spark, "hi", lambda c: E.build_request(c, "m", 0.3)))) == {"model", "messages", "temperature"}


def test_pick_reply(spark):
    df = spark.createDataFrame([(" a ", "b"), ("  ", " b"), (None, None)], "c string, r string")
    assert [r[0] for r in df.select(E.pick_reply(F.col("c"), F.col("r"))).collect()] == ["a", "b", None]


def test_calls_keep_errors_with_their_row(spark):
    df = spark.createDataFrame([("1",), ("x",)], "request string")
    out = {r.request: (r.reply, r.error) for r in E.enrich_rows(df, lambda t: str(int(t) + 1)).collect()}
    assert out["1"] == ("2", None) and out["x"][0] is None and out["x"][1].startswith("ValueError")


def test_zipped_translations(spark):
    df = spark.createDataFrame([(["a_b", "c", "d"], ["A b", " z "])], "tags array<string>, lines array<string>")
    assert [tuple(r) for r in E.zip_translations(df).collect()] == [("a_b", ""), ("c", "z"), ("d", "")]
    assert [tuple(r) for r in E.zip_translations(df, bulk=True).collect()] == [("a_b", "A b"), ("c", "z")]


def test_translate_missing_keeps_failed_batches_out(spark):
    d = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7)], "name string, post_count long")
    cache = spark.createDataFrame([("b", "B", "ja", 1)], "tag string, translated string, lang string, seq long")

    def call(text):
        if text == "c":
            raise RuntimeError("no")
        return text.upper()

    new, failed = E.translate_missing(d, cache, "ja", call, size=1)
    assert {(r.tag, r.translated) for r in new.collect()} == {("a", "A"), ("b", "B")}
    assert [r.tags for r in failed.collect()] == [["c"]]


def test_last_write_wins(spark):
    rows = [("a", "1", "ja", 1), ("a", "2", "ja", 5), ("a", "3", "ko", 2)]
    df = spark.createDataFrame(rows, "tag string, translated string, lang string, seq long")
    out = {(r.tag, r.lang): r.translated for r in M.upsert_translations(df, df.where("seq < 3")).collect()}
    assert out == {("a", "ja"): "2", ("a", "ko"): "3"}
    assert M.delete_translations(df).count() == 0


def test_selection_order_ties_and_exclusion(spark):
    vocab = [(0, "safe", "rating"), (1, "bad", "rating"), (2, "long_hair", "general"), (3, "hat", "general"), (4, "who", "character"), (5, "x", "meta")]
    v = spark.createDataFrame(vocab, "idx int, name string, category string")
    s = spark.createDataFrame([(1, [0.7, 0.7, 0.4, 0.9, 0.8, 0.9, 1.0]), (2, [0.1, 0.2, 0.0, 0.0, 0.9, 0.0, 1.0])], "asset_id long, scores array<double>")
    every = S.CATEGORY_ORDER
    out = {r.asset_id: r.text for r in S.select_tags(s, v, enabled=every).collect()}
    assert out == {1: "safe, hat, long hair, x", 2: "bad, who"}
    out = {r.asset_id: r.text for r in S.select_tags(s, v, enabled=every, exclude=["safe", "long hair"], extra=["zz"]).collect()}
    assert out == {1: "hat, x, zz", 2: "bad, who, zz"}
    out = {r.asset_id: r.text for r in S.select_tags(s, v, enabled=["general"], general=0.99, replace_underscore=False).collect()}
    assert out == {1: "", 2: ""}


def test_step_budget(spark):
    df = spark.createDataFrame([("a", 10, 3), ("b", 7, 1)], "name string, image_count long, repeats int")
    plan = ST.training_steps_budget(df, 2, 2, 25)
    assert plan.first().asDict() == {
        "samples": 37, "steps_per_epoch": 10, "full_epochs": 2, "remaining": 5, "epochs": 3, "suggested_steps": 30, "is_cut": True, "lost_steps": 5,
    }
    rows = ST.epoch_timeline(plan, 25).orderBy("epoch").collect()
    assert [(r.start_step, r.end_step, r.truncated) for r in rows] == [(0, 10, False), (10, 20, False), (20, 25, True)]
    empty = ST.training_steps_budget(df.limit(0), 2, 2, 25).first()
    assert empty.steps_per_epoch == 0 and empty.epochs == 0 and ST.concept_balance(df.limit(0)).collect() == []


def test_features(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0]), ([0.0, 0.0], None)], "a array<double>, color array<double>")
    rows = df.select(C.l2_normalize(F.col("a")).alias("n"), C.fuse_features({"a": 2.0, "color": 0.5}).alias("f"), C.fuse_features({"a": 0.0}).alias("z")).collect()
    assert rows[0].n == pytest.approx([0.6, 0.8]) and rows[0].f == pytest.approx([1.2, 1.6, 0.5])
    assert rows[1].n == [0.0, 0.0] and rows[1].f == [0.0, 0.0] and rows[0].z is None


def greedy(boxes):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        def iou(k):
            w = max(0, min(b[3], k[3]) - max(b[1], k[1]))
            h = max(0, min(b[4], k[4]) - max(b[2], k[2]))
            u = (b[3] - b[1]) * (b[4] - b[2]) + (k[3] - k[1]) * (k[4] - k[2]) - w * h
            return w * h / max(u, 1e-6)
        if all(iou(k) <= 0.5 for k in kept):
            kept.append(b)
    return [b[0] for b in kept]


def test_suppression(spark):
    import random

    rng = random.Random(3)
    sets = []
    for _ in range(30):
        boxes = []
        for i in range(rng.randint(0, 15)):
            x, y = rng.uniform(0, 60), rng.uniform(0, 60)
            boxes.append((i, x, y, x + rng.uniform(20, 60), y + rng.uniform(20, 60), rng.choice([0.5, 0.6, rng.random()])))
        sets.append((boxes,))
    df = spark.createDataFrame(sets, f"boxes {X.BOXES}")
    got = [[b.row for b in r[0]] for r in df.select(X.nms(F.col("boxes"))).collect()]
    assert got == [greedy(b) for (b,) in sets]


def test_both_detector_layouts(spark):
    df = spark.createDataFrame([(640, 320)], "width int, height int").withColumn("fit", letterbox(F.col("width"), F.col("height"), 640))
    five = df.withColumn("raw", F.array(*[F.lit(x) for x in (320.0, 320.0, 100.0, 50.0, 0.9, 320.0, 160.0, 100.0, 50.0, 0.9, 1.0, 1.0, 1.0, 1.0, 0.1)]))
    box, low = X.decode_detections(five, 0.3, columns=5).first().boxes
    assert (low.y1, low.y2) == (0.0, 25.0)
    assert (box.x1, box.y1, box.x2, box.y2, box.conf) == (270.0, 135.0, 370.0, 185.0, 0.9)
    six = df.withColumn("raw", F.array(*[F.lit(x) for x in (320.0, 320.0, 100.0, 50.0, 0.5, 0.5)]))
    assert X.decode_detections(six, 0.3).first().boxes == []
    assert X.decode_detections(six, 0.2).first().boxes[0].conf == 0.25
    assert X.decode_detections(df.withColumn("raw", F.array().cast("array<double>")), 0.3).first().boxes == []


def test_regions(spark):
    df = spark.createDataFrame([([(0, 10.0, 10.0, 50.0, 30.0, 0.9)], 60, 60)], f"boxes {X.BOXES}, width int, height int")
    r = X.region_plan(df, "full").first()
    assert (r.region.x1, r.region.y1, r.region.x2, r.region.y2, r.suffix) == (6, 0, 53, 43, "_full")
    two = df.withColumn("boxes", F.concat("boxes", "boxes"))
    assert sorted(r.suffix for r in X.region_plan(two, "eyes").collect()) == ["_0_eyes", "_1_eyes"]


def test_region_tags_of_blank_and_missing_originals(spark):
    rows = spark.createDataFrame([(None,), (" \t\n",), (" a, b ",)], "t string")
    t = F.col("t")
    got = rows.select(X.region_tags("full", t, True), X.region_tags("head", t, True, "head view"), X.region_tags("full", t, False),
                      X.region_tags("halfbody", t, False, "upper body")).collect()
    assert [tuple(r) for r in got] == [
        (None, None, None, "upper body"), ("", "head view, ", None, "upper body"), ("a, b", "head view, a, b", None, "upper body"),
    ]
