"""Documents, scores, buckets, geometry, detections and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import fingerprints as P
from tagloom.functions import geometry as G
from tagloom.functions import tags as T
from tagloom.operators import buckets as bk
from tagloom.operators import detections as dt
from tagloom.operators import documents as dc
from tagloom.operators import duplicates as dp
from tagloom.operators import imaging as im
from tagloom.operators import scoring as sc
from tagloom.plans.registry import query
from tagloom.plans.views import Views


def shown(tags, name="tags"):
    return T.join_tags(tags, "|").alias(name)


# -- documents --------------------------------------------------------------------


_GROUP = """CASE
      WHEN list_contains((SELECT list(keyword) FROM fx_taxonomy WHERE grp = 'appearance'), lower({t})) THEN 'appearance'
      WHEN list_contains((SELECT list(keyword) FROM fx_taxonomy WHERE grp = 'environment'), lower({t})) THEN 'environment'
      WHEN EXISTS (SELECT 1 FROM fx_taxonomy WHERE grp = 'appearance' AND length(keyword) >= 4 AND contains(lower({t}), keyword)) THEN 'appearance'
      WHEN EXISTS (SELECT 1 FROM fx_taxonomy WHERE grp = 'environment' AND length(keyword) >= 4 AND contains(lower({t}), keyword)) THEN 'environment'
      ELSE 'tags' END"""


@query("classify_tag", f"""
    WITH t AS (SELECT DISTINCT tag FROM (SELECT tag FROM fx_tag_rows UNION ALL SELECT p_type FROM fx_tag_rows
               UNION ALL SELECT tag FROM fx_words))
    SELECT tag, {_GROUP.format(t='tag')} AS grp FROM t""")
def classify_tag(v: Views):
    rows = v.tag_rows()
    tags = rows.select("tag").unionByName(rows.select(F.col("p_type").alias("tag"))).unionByName(v.words().select("tag"))
    return dc.classify_tags(tags, dc.Taxonomy.load(v.taxonomy()))


# selected tags of one asset, in the order of a tag list, as SQL
_SELECTED = """
    picked AS (
      SELECT asset_id, arg_max(idx, prob) AS idx, arg_max(name, prob) AS name, category, max(prob) AS prob
      FROM fx_long WHERE category IN ('rating', 'quality') GROUP BY asset_id, category
      UNION ALL
      SELECT asset_id, idx, name, category, prob FROM fx_long
      WHERE (category IN ('general', 'meta', 'model') AND prob >= 0.6) OR (category IN ('character', 'copyright', 'artist') AND prob >= 0.8)),
    ordered AS (
      SELECT asset_id, replace(name, '_', ' ') AS name, category, row_number() OVER (PARTITION BY asset_id ORDER BY
        list_position(['rating', 'quality', 'general', 'character', 'copyright', 'artist', 'meta', 'model'], category), prob DESC, idx) AS k
      FROM picked)"""

_SLOTS = f"""
    grouped AS (SELECT n, {_GROUP.format(t='n')} AS g FROM (SELECT DISTINCT name AS n FROM ordered)),
    slots AS (
      SELECT asset_id, name, k, CASE WHEN category IN ('character', 'copyright', 'rating', 'quality', 'artist') THEN category
        WHEN category = 'model' THEN 'tags'
        WHEN lower(name) IN (SELECT keyword FROM fx_taxonomy WHERE grp = 'count') THEN 'count' ELSE g END AS slot
      FROM ordered JOIN grouped ON name = n),
    fields AS (
      SELECT asset_id,
        string_agg(name, ', ' ORDER BY CASE slot WHEN 'rating' THEN -k ELSE k END) FILTER (slot IN ('rating', 'quality')) AS quality,
        string_agg(name, ', ' ORDER BY k) FILTER (slot = 'copyright') AS series,
        '@' || string_agg(name, ', ' ORDER BY k) FILTER (slot = 'artist') AS artist,
        string_agg(name, ', ' ORDER BY k) FILTER (slot = 'character') AS ch,
        string_agg(name, ', ' ORDER BY k) FILTER (slot = 'count') AS cnt,
        list(name ORDER BY k) FILTER (slot = 'appearance') AS appearance,
        list(name ORDER BY k) FILTER (slot = 'tags') AS tags,
        list(name ORDER BY k) FILTER (slot = 'environment') AS environment
      FROM slots GROUP BY asset_id)"""


def selected(v: Views):
    out = sc.select_tags(v.probs(), v.vocab(), general=0.6, character=0.8, enabled=sc.CATEGORY_ORDER)
    return out.where(F.size("selected") > 0)


@query("build_tag_doc", f"""
    WITH {_SELECTED}, {_SLOTS}
    SELECT asset_id, json_merge_patch('{{}}', to_json({{
      'fixed': CASE WHEN coalesce(quality, series, artist) IS NOT NULL THEN {{'quality': quality, 'series': series, 'artist': artist}} END,
      'character': CASE WHEN ch IS NOT NULL THEN {{'name': ch}} END,
      'ai_output': CASE WHEN cnt IS NOT NULL OR appearance IS NOT NULL OR tags IS NOT NULL OR environment IS NOT NULL
        THEN {{'count': cnt, 'appearance': appearance, 'tags': tags, 'environment': environment}} END}}))::VARCHAR AS json FROM fields""")
def build_tag_doc(v: Views):
    return dc.build_tag_doc(selected(v), dc.Taxonomy.load(v.taxonomy())).select("asset_id", "json")


@query("build_flat_doc", f"""
    WITH {_SELECTED}, {_SLOTS}
    SELECT asset_id, json_merge_patch('{{}}', to_json({{'quality': quality, 'count': cnt, 'character': ch, 'series': series,
      'artist': artist, 'appearance': appearance, 'tags': tags, 'environment': environment}}))::VARCHAR AS json FROM fields""")
def build_flat_doc(v: Views):
    return dc.build_flat_doc(selected(v), dc.Taxonomy.load(v.taxonomy())).select("asset_id", "json")


@query("doc_to_flat", """
    SELECT asset_id, lang AS quality, NULL::VARCHAR AS series, '@' || source AS artist, nullif(array_to_string(q, ', '), '') AS character,
      array_to_string(list_concat(a, list_transform(list_filter(list_zip(e, range(1, len(e) + 1)),
        lambda z: NOT list_contains(a, z[1]) AND list_position(e, z[1]) = z[2]), lambda z: z[1])), '|') AS appearance,
      array_to_string(t, '|') AS tags, array_to_string(e, '|') AS environment
    FROM fx_parts""")
def doc_to_flat(v: Views):
    f = v.docs().select("asset_id", dc.doc_to_flat(F.col("doc")).alias("f"))
    return f.select(
        "asset_id", "f.quality", "f.series", "f.artist", "f.character", shown(F.col("f.appearance"), "appearance"),
        shown(F.col("f.tags")), shown(F.col("f.environment"), "environment"),
    )


def _flat_text(v: Views):
    """Flat JSON in which the tag list is a comma text and one list holds a number."""
    return v.parts().select(
        "asset_id", "q",
        F.to_json(F.struct(
            F.col("lang").alias("quality"), F.col("source").alias("artist"), F.array_join("q", ",").alias("tags"),
            F.col("e").alias("environment"), F.struct(F.lit(1).alias("x")).alias("appearance"), F.lit(5).alias("count"),
        )).alias("content"),
    )


@query("flat_to_doc", """
    SELECT asset_id, lang AS quality, source AS artist, '' AS appearance, NULL::VARCHAR AS count,
      array_to_string(list_filter(list_transform(string_split(array_to_string(q, ','), ','),
        lambda w: trim(w, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda w: w <> ''), '|') AS tags,
      array_to_string(e, '|') AS environment FROM fx_parts""")
def flat_to_doc(v: Views):
    d = dc.flat_to_doc(_flat_text(v)).select("asset_id", F.col("doc").alias("d"))
    ai = "d.ai_output."
    return d.select(
        "asset_id", "d.fixed.quality", "d.fixed.artist", shown(F.col(ai + "appearance"), "appearance"), ai + "count",
        shown(F.col(ai + "tags")), shown(F.col(ai + "environment"), "environment"),
    )


@query("edit_doc_field", """
    SELECT asset_id,
      array_to_string(CASE WHEN list_contains(t, 'new tag') THEN t ELSE list_concat(t, ['new tag']) END, '|') AS tags,
      array_to_string(list_filter(e, lambda w: w <> 'and'), '|') AS environment,
      CASE WHEN len(a) > 2 THEN array_to_string(list_concat(list_concat(a[3:3], a[1:2]), a[4:]), '|') ELSE array_to_string(a, '|') END AS appearance,
      lang || ', masterpiece' AS quality, 'solo, 1girl' AS count
    FROM fx_parts""")
def edit_doc_field(v: Views):
    d = dc.edit_list(F.col("doc"), "ai_output.tags", "add", "new tag")
    d = dc.edit_list(d, "ai_output.environment", "remove", "and")
    d = dc.edit_list(d, "from_path.appearance", "move", 2, 0)
    d = dc.edit_text(d, "fixed.quality", "add", "masterpiece")
    d = dc.edit_text(d, "ai_output.count", "move", 1, 0)
    rows = v.docs().select("asset_id", d.alias("d"))
    return rows.select(
        "asset_id", shown(F.col("d.ai_output.tags")), shown(F.col("d.ai_output.environment"), "environment"),
        shown(F.col("d.from_path.appearance"), "appearance"), "d.fixed.quality", "d.ai_output.count",
    )


@query("doc_tags", """
    SELECT tag, count(*) AS n FROM (
      SELECT unnest(list_concat(list_concat(list_concat(list_concat(a, e), list_concat(a, t)), e),
        list_concat([lang, '@' || source, '1girl', 'solo'],
          list_filter(list_transform(string_split(array_to_string(q, ', '), ','), lambda w: trim(w, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda w: w <> '')))) AS tag
      FROM fx_parts) GROUP BY tag""")
def doc_tags(v: Views):
    return v.docs().select(F.explode_outer(dc.doc_tags(F.col("doc"))).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))


# -- scores -----------------------------------------------------------------------


@query("score_assets", """
    SELECT asset_id, i AS idx, (px[i * 4 + 1] + px[i * 4 + 2] + px[i * 4 + 3] + px[i * 4 + 4]) / 4.0::DOUBLE AS score FROM fx_gray, range(16) r(i)""")
def score_assets(v: Views):
    """Mean brightness of 16 blocks stands in for a model."""

    def make():
        import numpy as np

        def run(batch):
            return [np.frombuffer(d, dtype=np.uint8).reshape(16, -1).mean(axis=1).tolist() for d in batch["data"]]

        return run

    out = sc.score_assets(v.gray(), make)
    rows = out.select("asset_id", F.posexplode_outer("scores").alias("idx", "score"))
    return rows.select("asset_id", F.col("idx").cast("long").alias("idx"), F.col("score").cast("double").alias("score"))


@query("sigmoid_scores", """
    SELECT asset_id, i AS idx, round(1 / (1 + exp(-greatest(-30.0, least(30.0, scores[i + 1])))), 6) AS prob
    FROM fx_scores, range(64) r(i)""")
def sigmoid_scores(v: Views):
    rows = v.probs().select("asset_id", F.posexplode_outer("scores").alias("idx", "p"))
    return rows.select("asset_id", F.col("idx").cast("long").alias("idx"), F.round("p", 6).alias("prob"))


@query("long_scores", """
    SELECT asset_id, idx, name, category, round(prob, 6) AS prob FROM fx_long WHERE category IN ('general', 'artist', 'rating')""")
def long_scores(v: Views):
    out = sc.long_scores(v.probs(), v.vocab(), ["general", "artist", "rating"])
    return out.withColumn("prob", F.round("prob", 6))


@query("pick_argmax", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, category ORDER BY prob DESC, idx) AS k
               FROM fx_long WHERE category IN ('rating', 'quality'))
    SELECT asset_id, idx, name, category FROM r
    WHERE k = 1 AND replace(name, '_', ' ') NOT IN (SELECT replace(min(name), '_', ' ') FROM fx_vocab WHERE category = 'rating')""")
def pick_argmax(v: Views):
    banned = v.vocab().where("category = 'rating'").agg(F.min("name")).first()[0]
    rows = sc.labelled_scores(v.probs(), v.vocab())
    best = sc.pick_argmax(F.col("labels"), exclude=[banned.replace("_", " ")])
    return sc.label_rows(rows, best).select("asset_id", "idx", "name", "category")


@query("pick_threshold", """
    SELECT asset_id, idx, name, category, round(prob, 6) AS prob FROM fx_long
    WHERE (category IN ('general', 'meta', 'model') AND prob >= 0.55) OR (category IN ('character', 'copyright', 'artist') AND prob >= 0.85)""")
def pick_threshold(v: Views):
    rows = sc.labelled_scores(v.probs(), v.vocab())
    out = sc.label_rows(rows, sc.pick_threshold(F.col("labels"), general=0.55, character=0.85))
    return out.withColumn("prob", F.round("prob", 6))


@query("order_selected", f"""
    WITH {_SELECTED} SELECT asset_id, string_agg(category || ':' || name, '|' ORDER BY k) AS tags FROM ordered GROUP BY asset_id""")
def order_selected(v: Views):
    rows = sc.labelled_scores(v.probs(), v.vocab())
    both = F.concat(sc.pick_argmax(F.col("labels")), sc.pick_threshold(F.col("labels"), 0.6, 0.8))
    out = rows.select("asset_id", sc.order_selected(both).alias("selected")).where("size(selected) > 0")
    return out.select("asset_id", shown(F.transform("selected", lambda s: F.concat_ws(":", s["category"], s["name"]))))


@query("exclude_append", """
    WITH k AS (SELECT asset_id, name, prob, idx FROM fx_long WHERE category = 'general' AND prob >= 0.6
               AND replace(name, '_', ' ') <> (SELECT replace(min(name), '_', ' ') FROM fx_vocab WHERE category = 'general'))
    SELECT s.asset_id, concat_ws('|', 'best quality', 'safe', string_agg(replace(k.name, '_', ' '), '|' ORDER BY k.prob DESC, k.idx)) AS tags
    FROM fx_scores s LEFT JOIN k ON s.asset_id = k.asset_id GROUP BY s.asset_id""")
def exclude_append(v: Views):
    banned = v.vocab().where("category = 'general'").agg(F.min("name")).first()[0]
    out = sc.select_tags(
        v.probs(), v.vocab(), general=0.6, enabled=["general"], exclude=[banned], extra=["best quality", "safe"], position="prepend"
    )
    return out.select("asset_id", shown(F.transform("selected", lambda s: s["name"])))


@query("tags_to_text", f"""
    WITH {_SELECTED} SELECT asset_id, string_agg(name, ', ' ORDER BY k) AS text FROM ordered GROUP BY asset_id""")
def tags_to_text(v: Views):
    return selected(v).select("asset_id", "text")


# -- buckets ----------------------------------------------------------------------

_SETTINGS = """
    SELECT DISTINCT 512 + 64 * (p_size % 9) AS res_w, 512 + 64 * (p_partkey % 7) AS res_h, 256 AS min_size,
      greatest(512 + 64 * (p_size % 9), 512 + 64 * (p_partkey % 7)) AS max_size, CASE p_size % 2 WHEN 0 THEN 32 ELSE 64 END AS step FROM part"""

_GRID = """
    SELECT floor(sqrt({area}.0) / {step})::BIGINT * {step} AS bw, floor(sqrt({area}.0) / {step})::BIGINT * {step} AS bh
    UNION SELECT w, h FROM (SELECT w, least({top}, ({area} // w) // {step} * {step}) AS h FROM range({low}, {top} + 1, {step}) r(w)) WHERE h >= {low}
    UNION SELECT h, w FROM (SELECT w, least({top}, ({area} // w) // {step} * {step}) AS h FROM range({low}, {top} + 1, {step}) r(w)) WHERE h >= {low}"""

_ROUND = "greatest(floor({x} + 0.5)::BIGINT - floor({x} + 0.5)::BIGINT % {s}, {s})"


def _two(area: float, step: int, floor: int) -> str:
    """Width-first and height-first roundings of every distinct size."""
    r = lambda x: f"greatest({_ROUND.format(x=x, s=step)}, {floor})"
    return f"""
      SELECT *, w1::DOUBLE / h1 AS r1, w2::DOUBLE / h2 AS r2 FROM (
        SELECT *, {r('(w1 / a)')} AS h1, {r('(h2 * a)')} AS w2 FROM (
          SELECT *, {r('tw')} AS w1, {r('(' + str(area) + ' / tw)')} AS h2 FROM (
            SELECT DISTINCT width, height, width::DOUBLE / height AS a, sqrt({area} * (width::DOUBLE / height)) AS tw FROM fx_assets)))"""


_NEAR = _two(1048576.0, 64, 256)
_ASSIGN = """
    cand AS (SELECT width, height, arg_min({{'w': bw, 'h': bh}}, (CASE WHEN bw = width AND bh = height THEN -1 ELSE abs(bw::DOUBLE / bh - width::DOUBLE / height) END, bw, bh)) AS b
             FROM (SELECT DISTINCT width, height FROM fx_assets), ({buckets}) GROUP BY width, height)"""


@query("bucket_grid", f"""
    WITH s AS ({_SETTINGS}),
    w AS (SELECT *, unnest(range(min_size, max_size + 1, step)) AS w FROM s),
    t AS (SELECT *, least(max_size, ((res_w * res_h) // w) // step * step) AS h FROM w)
    SELECT res_w, res_h, step, floor(sqrt((res_w * res_h)::DOUBLE) / step)::BIGINT * step AS bw, floor(sqrt((res_w * res_h)::DOUBLE) / step)::BIGINT * step AS bh FROM s
    UNION SELECT res_w, res_h, step, w, h FROM t WHERE h >= min_size
    UNION SELECT res_w, res_h, step, h, w FROM t WHERE h >= min_size""")
def bucket_grid(v: Views):
    s = v.table("part").selectExpr(
        "cast(512 + 64 * (p_size % 9) AS bigint) AS res_w", "512 + 64 * (p_partkey % 7) AS res_h", "256L AS min_size",
        "greatest(512 + 64 * (p_size % 9), 512 + 64 * (p_partkey % 7)) AS max_size", "CASE p_size % 2 WHEN 0 THEN 32L ELSE 64L END AS step",
    ).distinct()
    return bk.bucket_grid(s).select("res_w", "res_h", "step", "bw", "bh")


@query("bucket_nearest", f"""
    WITH n AS ({_NEAR}) SELECT DISTINCT CASE WHEN abs(r1 - a) <= abs(r2 - a) THEN w1 ELSE w2 END AS bw,
      CASE WHEN abs(r1 - a) <= abs(r2 - a) THEN h1 ELSE h2 END AS bh FROM n""")
def bucket_nearest(v: Views):
    return bk.bucket_nearest(v.assets(), 1048576.0, 64, 256)


@query("round_to_steps", f"""
    SELECT asset_id, {_ROUND.format(x='(width * 0.37)', s=64)} AS w, {_ROUND.format(x='(height / 3.0)', s=8)} AS h FROM fx_assets""")
def round_to_steps(v: Views):
    return v.assets().select(
        "asset_id", G.round_to_steps(F.col("width") * F.lit(0.37), 64).alias("w"), G.round_to_steps(F.col("height") / 3.0, 8).alias("h")
    )


_NOUP = f"""
    SELECT width, height, greatest(rw - rw % 64, 64) AS bw, greatest(rh - rh % 64, 64) AS bh FROM (
      SELECT width, height, CASE WHEN width * height <= 589824 THEN width WHEN abs(r1 - a) < abs(r2 - a) THEN w1 ELSE floor(h2 * a + 0.5)::BIGINT END AS rw,
        CASE WHEN width * height <= 589824 THEN height WHEN abs(r1 - a) < abs(r2 - a) THEN floor(w1 / a + 0.5)::BIGINT ELSE h2 END AS rh
      FROM ({_two(589824.0, 64, 0)}))"""


@query("bucket_no_upscale", f"SELECT asset_id, bw, bh FROM fx_assets JOIN ({_NOUP}) USING (width, height)")
def bucket_no_upscale(v: Views):
    b = G.no_upscale_bucket(F.col("width"), F.col("height"), 589824.0, 64)
    return v.assets().select("asset_id", b.alias("b")).select("asset_id", "b.bw", "b.bh")


_GRID_1024 = _GRID.format(area=1024 * 1024, step=64, low=256, top=1024)


@query("assign_bucket", f"""
    WITH {_ASSIGN.format(buckets=_GRID_1024)} SELECT asset_id, b.w AS bw, b.h AS bh FROM fx_assets JOIN cand USING (width, height)""")
def assign_bucket(v: Views):
    grid = bk.bucket_grid(v.assets().select(
        F.lit(1024).alias("res_w"), F.lit(1024).alias("res_h"), F.lit(256).alias("min_size"), F.lit(1024).alias("max_size"), F.lit(64).alias("step")
    ).distinct())
    return bk.assign_bucket(v.assets(), grid).select("asset_id", "bw", "bh")


_SUMMARY = """
    SELECT mode, row_number() OVER (PARTITION BY mode ORDER BY bw, bh) - 1 AS bucket, bw, bh, n AS image_count, n * 3 AS total_count,
      floor(bw::DOUBLE / bh * 100.0 + 0.5) / 100.0 AS aspect FROM ({rows})"""


@query("bucket_summary", f"""
    WITH {_ASSIGN.format(buckets=_GRID_1024)} {_SUMMARY.format(rows='''
      SELECT 'grid' AS mode, b.w AS bw, b.h AS bh, count(*) AS n FROM fx_assets JOIN cand USING (width, height) GROUP BY ALL''')}""")
def bucket_summary(v: Views):
    assigned, _ = bk.analyze_buckets(v.assets(), 1024, 1024)
    return bk.bucket_summary(assigned, 3).withColumn("mode", F.lit("grid"))


@query("analyze_buckets", f"""
    WITH near AS ({_NEAR}),
    picked AS (SELECT DISTINCT CASE WHEN abs(r1 - a) <= abs(r2 - a) THEN w1 ELSE w2 END AS bw, CASE WHEN abs(r1 - a) <= abs(r2 - a) THEN h1 ELSE h2 END AS bh FROM near),
    {_ASSIGN.format(buckets='SELECT * FROM picked')}
    {_SUMMARY.format(rows=f'''
      SELECT 'nearest' AS mode, b.w AS bw, b.h AS bh, count(*) AS n FROM fx_assets JOIN cand USING (width, height) GROUP BY ALL
      UNION ALL SELECT 'no_upscale', bw, bh, count(*) FROM fx_assets JOIN ({_NOUP}) USING (width, height) GROUP BY ALL''')}""")
def analyze_buckets(v: Views):
    near, _ = bk.analyze_buckets(v.assets(), 1024, 1024, mode="nearest_only")
    plain, _ = bk.analyze_buckets(v.assets(), 768, 768, no_upscale=True)
    return bk.bucket_summary(near, 3).withColumn("mode", F.lit("nearest")).unionByName(
        bk.bucket_summary(plain, 3).withColumn("mode", F.lit("no_upscale"))
    )


# -- geometry ---------------------------------------------------------------------


@query("crop_plan", """
    WITH m AS (SELECT asset_id, width, height, c.mode FROM fx_assets, (VALUES ('center'), ('aspect'), ('edges')) c(mode)),
    s AS (SELECT *, width::DOUBLE / height AS r,
      CASE mode WHEN 'center' THEN least(800, width) WHEN 'edges' THEN CASE WHEN 320 >= height OR 450 >= width THEN width ELSE width - 450 END
        ELSE CASE WHEN abs(width::DOUBLE / height - 1.5) < 0.01 OR width::DOUBLE / height <= 1.5 THEN width ELSE least(floor(height * 1.5)::BIGINT, width) END END AS w,
      CASE mode WHEN 'center' THEN least(600, height) WHEN 'edges' THEN CASE WHEN 320 >= height OR 450 >= width THEN height ELSE height - 320 END
        ELSE CASE WHEN abs(width::DOUBLE / height - 1.5) < 0.01 OR width::DOUBLE / height > 1.5 THEN height ELSE least(floor(width / 1.5)::BIGINT, height) END END AS h
      FROM m)
    SELECT asset_id, mode, w, h,
      CASE mode WHEN 'edges' THEN CASE WHEN 320 >= height OR 450 >= width THEN 0 ELSE 150 END ELSE (width - w) // 2 END AS x,
      CASE mode WHEN 'edges' THEN CASE WHEN 320 >= height OR 450 >= width THEN 0 ELSE 300 END ELSE (height - h) // 2 END AS y,
      CASE mode WHEN 'edges' THEN CASE WHEN 320 >= height OR 450 >= width THEN 'error' ELSE 'crop' END
        WHEN 'center' THEN CASE WHEN w = width AND h = height THEN 'skip' ELSE 'crop' END
        ELSE CASE WHEN abs(r - 1.5) < 0.01 THEN 'skip' ELSE 'crop' END END AS status
    FROM s""")
def crop_plan(v: Views):
    w, h = F.col("width"), F.col("height")
    plans = {"center": G.crop_center(w, h, 800, 600), "aspect": G.crop_aspect(w, h, 1.5), "edges": G.crop_edges(w, h, 300, 20, 150, 300)}
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), p.alias("p")) for m, p in plans.items()])
    return v.assets().select("asset_id", F.inline_outer(modes)).select("asset_id", "mode", "p.*")


_SIDE = "greatest(floor({v} * sqrt(({tw}.0 * {th}.0)::DOUBLE / (w::DOUBLE * h::DOUBLE)) / 64 + 0.5) * 64, 64)::BIGINT"
_UPPED = f"""SELECT asset_id, mode, mode <> 'downscale' AND (w < 768 OR h < 768) AS up,
      CASE WHEN mode <> 'downscale' AND (w < 768 OR h < 768) THEN {_SIDE.format(v='w', tw=768, th=768)} ELSE w END AS w,
      CASE WHEN mode <> 'downscale' AND (w < 768 OR h < 768) THEN {_SIDE.format(v='h', tw=768, th=768)} ELSE h END AS h
    FROM (SELECT asset_id, c.mode, width AS w, height AS h FROM fx_assets, (VALUES ('upscale'), ('downscale'), ('both')) c(mode))"""


@query("scale_plan", f"""
    WITH u AS ({_UPPED}), d AS (SELECT *, CASE mode WHEN 'both' THEN 1280 ELSE 768 END AS tw, CASE mode WHEN 'both' THEN 1024 ELSE 768 END AS th FROM u),
    e AS (SELECT *, mode <> 'upscale' AND (w > tw OR h > th) AS down, sqrt((tw::DOUBLE * th::DOUBLE) / (w::DOUBLE * h::DOUBLE)) AS s FROM d)
    SELECT asset_id, mode, CASE WHEN down THEN greatest(floor(w * s / 64 + 0.5) * 64, 64)::BIGINT ELSE w END AS w,
      CASE WHEN down THEN greatest(floor(h * s / 64 + 0.5) * 64, 64)::BIGINT ELSE h END AS h, CASE WHEN up OR down THEN 'resize' ELSE 'skip' END AS status FROM e""")
def scale_plan(v: Views):
    w, h = F.col("width"), F.col("height")
    plans = {m: G.scale_size(w, h, m, (768, 768), (1280, 1024)) for m in ("upscale", "downscale", "both")}
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), p.alias("p")) for m, p in plans.items()])
    return v.assets().select("asset_id", F.inline_outer(modes)).select("asset_id", "mode", "p.*")


@query("letterbox_plan", """
    WITH s AS (SELECT asset_id, width, height, least(640.0::DOUBLE / width, 640.0::DOUBLE / height) AS scale FROM fx_assets),
    t AS (SELECT *, floor(width * scale)::BIGINT AS w, floor(height * scale)::BIGINT AS h, greatest(width, height) AS side FROM s)
    SELECT asset_id, round(scale, 6) AS scale, w, h, (640 - w) // 2 AS pad_x, (640 - h) // 2 AS pad_y, side,
      (side - width) // 2 AS pad_left, (side - height) // 2 AS pad_top FROM t""")
def letterbox_plan(v: Views):
    w, h = F.col("width"), F.col("height")
    rows = v.assets().select("asset_id", G.letterbox(w, h, 640).alias("p"), G.pad_square(w, h).alias("q"))
    return rows.select("asset_id", "p.*", "q.*").withColumn("scale", F.round("scale", 6))


@query("fit_max_side", """
    SELECT asset_id, CASE WHEN width > 1024 OR height > 1024 THEN greatest(floor(width * s + 0.5)::BIGINT, 1) ELSE width END AS w,
      CASE WHEN width > 1024 OR height > 1024 THEN greatest(floor(height * s + 0.5)::BIGINT, 1) ELSE height END AS h
    FROM (SELECT *, least(1024.0::DOUBLE / width, 1024.0::DOUBLE / height) AS s FROM fx_assets)""")
def fit_max_side(v: Views):
    p = G.fit_max_side(F.col("width"), F.col("height"), 1024)
    return v.assets().select("asset_id", p.alias("p")).select("asset_id", "p.*")


@query("tile_plan", """
    WITH t AS (SELECT asset_id, width, height, tx * 512 AS ox, ty * 512 AS oy, tx, ty FROM fx_assets,
               range(5) a(tx), range(5) b(ty) WHERE tx * 512 < width AND ty * 512 < height)
    SELECT asset_id, tx AS tile_x, ty AS tile_y, greatest(ox - 10, 0) AS in_x0, least(ox + 522, width) AS in_x1,
      greatest(oy - 10, 0) AS in_y0, least(oy + 522, height) AS in_y1,
      (ox - greatest(ox - 10, 0)) * 4 AS crop_x0, (ox - greatest(ox - 10, 0) + least(512, width - ox)) * 4 AS crop_x1,
      (oy - greatest(oy - 10, 0)) * 4 AS crop_y0, (oy - greatest(oy - 10, 0) + least(512, height - oy)) * 4 AS crop_y1,
      ox * 4 AS out_x0, least(ox * 4 + 2048, width * 4) AS out_x1, oy * 4 AS out_y0, least(oy * 4 + 2048, height * 4) AS out_y1 FROM t""")
def tile_plan(v: Views):
    t = G.tiles(F.col("width"), F.col("height"), 512, 10, 4)
    return v.assets().select("asset_id", F.explode_outer(t).alias("t")).select("asset_id", "t.*")


@query("convert_format_plan", """
    SELECT name, regexp_replace(name, '\\.[^.]*$', '') || '.jpg' AS renamed, true AS force_rgb FROM fx_assets WHERE ext NOT IN ('jpg', 'jpeg')""")
def convert_format_plan(v: Views):
    return im.convert_format_plan(v.assets(), "jpg").select("name", "renamed", "force_rgb")


# -- detections ---------------------------------------------------------------------


@query("decode_detections", """
    SELECT asset_id, kind, row, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(conf, 6) AS conf FROM fx_kept""")
def decode_detections(v: Views):
    rows = dt.decode_detections(v.detections(), 0.6).select("asset_id", "kind", F.inline_outer("boxes")).where("row is not null")
    return rows.select(
        "asset_id", "kind", F.col("row").cast("long").alias("row"), *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "conf")]
    )


_NMS = """
    RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY conf DESC, row) AS k FROM fx_kept),
    iou AS (SELECT a.asset_id, a.k AS ka, b.k AS kb,
        greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
        (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS area
      FROM ranked a JOIN ranked b ON a.asset_id = b.asset_id AND a.k < b.k),
    hit AS (SELECT asset_id, kb, list(ka) AS blockers FROM iou WHERE inter / greatest(area - inter, 1e-6) > 0.5 GROUP BY asset_id, kb),
    step AS (
      SELECT asset_id, 1::BIGINT AS k, [1::BIGINT] AS kept FROM ranked WHERE k = 1
      UNION ALL
      SELECT s.asset_id, r.k, CASE WHEN h.blockers IS NOT NULL AND list_has_any(h.blockers, s.kept) THEN s.kept ELSE list_append(s.kept, r.k) END
      FROM step s JOIN ranked r ON r.asset_id = s.asset_id AND r.k = s.k + 1 LEFT JOIN hit h ON h.asset_id = r.asset_id AND h.kb = r.k),
    final AS (SELECT asset_id, arg_max(kept, k) AS kept FROM step GROUP BY asset_id),
    best AS (SELECT r.*, row_number() OVER (PARTITION BY r.asset_id ORDER BY r.k) - 1 AS box_index, count(*) OVER (PARTITION BY r.asset_id) AS boxes
             FROM ranked r JOIN final f ON f.asset_id = r.asset_id AND list_contains(f.kept, r.k))"""


def best_boxes(v: Views):
    return dt.decode_detections(v.detections(), 0.6).withColumn("boxes", dt.nms(F.col("boxes")))


@query("nms", f"WITH {_NMS} SELECT asset_id, kind, row, round(conf, 6) AS conf FROM best")
def nms(v: Views):
    rows = best_boxes(v).select("asset_id", "kind", F.inline_outer("boxes")).where("row is not null")
    return rows.select("asset_id", "kind", F.col("row").cast("long").alias("row"), F.round("conf", 6).alias("conf"))


@query("region_plan", f"""
    WITH {_NMS},
    g AS (SELECT *, CASE kind WHEN 'head' THEN 1.5 WHEN 'eyes' THEN 2.4 ELSE 1.0 END::DOUBLE AS grow,
      CASE kind WHEN 'full' THEN 0.08 WHEN 'halfbody' THEN 0.06 ELSE 0.02 END::DOUBLE AS pad FROM best),
    h AS (SELECT *, greatest(x2 - x1, y2 - y1) * grow AS size, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM g)
    SELECT asset_id, CASE WHEN boxes > 1 THEN '_' || box_index ELSE '' END || '_' || kind AS suffix,
      greatest(0, trunc(cx - (size / 2 + size * pad)))::BIGINT AS x1, greatest(0, trunc(cy - (size / 2 + size * pad)))::BIGINT AS y1,
      least(width, trunc(cx + (size / 2 + size * pad)))::BIGINT AS x2, least(height, trunc(cy + (size / 2 + size * pad)))::BIGINT AS y2 FROM h""")
def region_plan(v: Views):
    kept = best_boxes(v)
    out = None
    for kind in ("full", "halfbody", "head", "eyes"):
        part = dt.region_plan(kept.where(F.col("kind") == kind), kind).select("asset_id", "suffix", "region.*")
        out = part if out is None else out.unionByName(part)
    return out


@query("region_tags", """
    SELECT asset_id, trim(caption, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS full_kept, 'head view, ' || trim(caption, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS head_kept,
      NULL::VARCHAR AS full_alone, 'upper body' AS half_alone FROM fx_captions""")
def region_tags(v: Views):
    c = F.col("caption")
    return v.captions().select(
        "asset_id", dt.region_tags("full", c, True).alias("full_kept"), dt.region_tags("head", c, True, "head view").alias("head_kept"),
        dt.region_tags("full", c, False).alias("full_alone"), dt.region_tags("halfbody", c, False, "upper body").alias("half_alone"),
    )


# -- duplicates ---------------------------------------------------------------------

_SIM = "list_sum(list_transform(list_zip(a.hist, b.hist), lambda z: sqrt(z[1] * z[2])))"
_PAIRS = f"""
    near AS (SELECT a.name AS a, b.name AS b, bit_count(xor(a.dhash, b.dhash)) AS d, bit_count(xor(a.phash, b.phash)) AS p, {_SIM} AS color
             FROM {{src}} a JOIN {{src}} b ON a.name < b.name AND bit_count(xor(a.dhash, b.dhash)) <= 10 AND bit_count(xor(a.phash, b.phash)) <= 10),
    pairs AS (SELECT * FROM near WHERE color >= 0.85)"""
_GROUPS = f"""
    RECURSIVE nums AS (SELECT *, row_number() OVER (ORDER BY name) AS k FROM fx_fingerprints),
    {_PAIRS.format(src='nums')},
    blockers AS (SELECT nb.k AS k, list(na.k) AS before FROM pairs JOIN nums na ON na.name = a JOIN nums nb ON nb.name = b GROUP BY nb.k),
    depends AS (SELECT nums.k, b.before FROM nums JOIN blockers b ON b.k = nums.k),
    firsts AS (SELECT list(k) AS heads FROM nums WHERE k NOT IN (SELECT k FROM blockers)),
    walk AS (
      SELECT (SELECT list(k ORDER BY k) FROM depends) AS todo, (SELECT heads FROM firsts) AS heads, 1::BIGINT AS i
      UNION ALL
      SELECT todo, CASE WHEN list_has_any((SELECT before FROM depends WHERE k = todo[i]), heads) THEN heads ELSE list_append(heads, todo[i]) END, i + 1
      FROM walk WHERE i <= len(todo)),
    leaders AS (SELECT unnest(heads) AS k FROM (SELECT arg_max(heads, i) AS heads FROM walk)),
    member AS (SELECT nb.k, min(na.k) AS head FROM pairs JOIN nums na ON na.name = a JOIN nums nb ON nb.name = b
               WHERE na.k IN (SELECT k FROM leaders) AND nb.k NOT IN (SELECT k FROM leaders) GROUP BY nb.k),
    followers AS (SELECT h.name AS leader, n.name, m.d AS dhash_dist, m.p AS phash_dist, m.color
                  FROM member JOIN nums n ON n.k = member.k JOIN nums h ON h.k = member.head JOIN pairs m ON m.a = h.name AND m.b = n.name)"""


def members(v: Views):
    return dp.duplicate_members(v.fingerprints())


@query("hamming", """
    SELECT name, bit_count(xor(dhash, phash))::INTEGER AS dist FROM fx_fingerprints""")
def hamming(v: Views):
    return v.fingerprints().select("name", P.hamming(F.col("dhash"), F.col("phash")).alias("dist"))


@query("color_similarity", """
    SELECT asset_id, round(list_sum(list_transform(hist, lambda x: sqrt(x * x))), 6) AS self,
      round(list_sum(list_transform(list_zip(hist, list_reverse(hist)), lambda z: sqrt(z[1] * z[2]))) / 3, 6) AS mirrored FROM fx_hash""")
def color_similarity(v: Views):
    h = F.col("hist")
    return v.hashes().select(
        "asset_id", F.round(P.color_similarity(h, h), 6).alias("self"), F.round(P.color_similarity(h, F.reverse(h), True), 6).alias("mirrored")
    )


@query("is_duplicate", f"""
    WITH o AS (SELECT * FROM fx_fingerprints WHERE name LIKE 'img\\_0\\_%' ESCAPE '\\'), c AS (SELECT * FROM fx_fingerprints WHERE name LIKE 'img\\_3\\_%' ESCAPE '\\'),
    j AS (SELECT a.name, bit_count(xor(a.dhash, b.dhash)) AS d, bit_count(xor(a.phash, b.phash)) AS p, {_SIM} AS color
          FROM o a JOIN c b ON a.name[7:] = b.name[7:])
    SELECT name, d <= 6 AND p <= 6 AND color >= 0.85 AS duplicate,
      CASE WHEN d <= 6 AND p <= 6 AND color >= 0.85 THEN printf('dHash:%d pHash:%d color:%.2f', d, p, color) ELSE '' END AS method FROM j""")
def is_duplicate(v: Views):
    rows = v.fingerprints().select("name", F.substring("name", 7, 99).alias("key"), F.struct("dhash", "phash", "hist").alias("f"))
    left = rows.where(F.col("name").startswith("img_0_")).select("name", "key", F.col("f").alias("a"))
    right = rows.where(F.col("name").startswith("img_3_")).select("key", F.col("f").alias("b"))
    return dp.is_duplicate(left.join(right, "key"), 6, 6).select("name", "duplicate", "method")


@query("similar_pairs", f"""
    WITH {_PAIRS.format(src='fx_fingerprints')}
    SELECT a AS name_a, b AS name_b, d::INTEGER AS dhash_dist, p::INTEGER AS phash_dist, round(color, 6) AS color FROM pairs""")
def similar_pairs(v: Views):
    return dp.every_similar_pair(v.fingerprints()).withColumn("color", F.round("color", 6))


@query("duplicate_groups", f"""
    WITH {_GROUPS}
    SELECT leader, count(*) + 1 AS size, round(max(color), 6) AS similarity,
      arg_min(printf('dHash:%d pHash:%d color:%.2f', dhash_dist, phash_dist, color), (-round(color, 9), name)) AS method
    FROM followers GROUP BY leader""")
def duplicate_groups(v: Views):
    rows = members(v).withColumn("color", F.round("color", 9))
    return dp.duplicate_groups(rows).withColumn("similarity", F.round("similarity", 6))


@query("keep_first", f"WITH {_GROUPS} SELECT leader, name FROM followers")
def keep_first(v: Views):
    return dp.keep_first(members(v))


@query("prune_groups", f"""
    WITH {_GROUPS},
    everyone AS (SELECT leader, name FROM followers UNION SELECT leader, leader FROM followers),
    remaining AS (SELECT * FROM everyone WHERE name NOT LIKE 'img\\_2\\_%' ESCAPE '\\' AND name NOT LIKE 'img\\_3\\_%' ESCAPE '\\')
    SELECT leader, name, size FROM remaining JOIN (SELECT leader, count(*) AS size FROM remaining GROUP BY leader HAVING count(*) > 1) USING (leader)""")
def prune_groups(v: Views):
    found = members(v)
    gone = found.where(F.col("name").startswith("img_2_") | F.col("name").startswith("img_3_"))
    return dp.prune_groups(found, gone).select("leader", "name", "size")


@query("dedup_summary", f"""
    WITH {_GROUPS}
    SELECT (SELECT count(*) FROM fx_fingerprints) AS images, count(DISTINCT leader) AS groups, count(*) AS redundant FROM followers""")
def dedup_summary(v: Views):
    return dp.dedup_summary(v.fingerprints(), members(v))
