"""Operator inputs derived from the given tables, in Spark and, for checks, in SQL.

Captions come from ``documents``: a row holds one whole text, its words are the
tags, so no group has to be collected to make one.  Assets come from ``orders``,
long tag rows from ``lineitem`` and ``part``, vectors from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import materialize

EXTS = ("jpg", "jpeg", "png", "webp", "bmp", "txt", "npz", "gif")
CATEGORIES = ("general", "character", "rating", "quality", "copyright", "artist", "meta", "model")
LANGS = ("zh-CN", "ja", "ko")
KINDS = {"A": "full", "N": "head", "R": "eyes"}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.kept: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def balanced(self, name: str) -> DataFrame:
        """A table of heavy rows, dealt out evenly."""
        return self.table(name).repartition(self.spark.sparkContext.defaultParallelism)

    # orders -------------------------------------------------------------------

    def assets(self) -> DataFrame:
        exts = ", ".join(f"'{e}'" for e in EXTS)
        return self.table("orders").selectExpr(
            "o_orderkey AS asset_id",
            f"format_string('img_%08d', o_orderkey) || '.' || array({exts})[cast(o_orderkey % 8 AS int)] AS name",
            f"array({exts})[cast(o_orderkey % 8 AS int)] AS ext",
            "256 + (o_orderkey * 37) % 1793 AS width",
            "256 + (o_orderkey * 101) % 1793 AS height",
            "10000 + (o_orderkey * 7919) % 5000000 AS size_bytes",
        ).withColumn("path", F.concat(F.lit("/data/"), F.col("name")))

    # lineitem and part ----------------------------------------------------------

    def tag_rows(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.lower("p_name").alias("tag"), "p_type")
        rows = self.table("lineitem").select("l_orderkey", "l_partkey")
        return rows.join(part, rows.l_partkey == part.p_partkey).select(
            F.col("l_orderkey").alias("asset_id"), "tag", "p_type"
        )

    def vocab(self) -> DataFrame:
        from pyspark.sql import Window

        names = self.table("part").select(F.lower("p_name").alias("n")).distinct()
        # one row per different label reaches this window
        idx = F.row_number().over(Window.orderBy("n")) - 1
        cats = F.array(*[F.lit(c) for c in CATEGORIES])
        return names.select(idx.alias("idx"), F.replace("n", F.lit(" "), F.lit("_")).alias("name")).withColumn(
            "category", F.get(cats, F.col("idx") % 8)
        )

    # documents ------------------------------------------------------------------

    def captions(self) -> DataFrame:
        words = F.split(F.translate("text", " \n\t", ",,,"), ",")
        return self.balanced("documents").select(
            F.col("doc_id").alias("asset_id"),
            F.format_string("Img_%08d.png", "doc_id").alias("name"),
            F.col("text").alias("caption"),
            F.filter(words, lambda w: w != "").alias("tags"),
            "lang", "source",
        )

    def words(self) -> DataFrame:
        """Cut at a blank each, the empty ones dropped after the explode: no list is filtered by an interpreted function."""
        return self._cut(self.balanced("documents"))

    def _cut(self, docs: DataFrame) -> DataFrame:
        cut = F.split(F.translate("text", " \n\t", ",,,"), ",")
        return docs.select(F.col("doc_id").alias("asset_id"), F.explode_outer(cut).alias("tag")).where("tag <> ''")

    def keep_dictionary(self, counted: DataFrame | None = None) -> None:
        """Count the words once and store the dictionary, for queries that use it several times."""
        words = self.words() if counted is None else counted
        self.kept = materialize(self._entries(words, F.count("*") if counted is None else F.sum("n")))

    def counted_words(self) -> DataFrame:
        """``(asset_id, tag, n)``: documents, not their words, are shuffled by their id."""
        parts = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        docs = self.table("documents").select("doc_id", "text").repartition(parts, "doc_id")
        return self._cut(docs).groupBy("asset_id", "tag").agg(F.count("*").alias("n"))

    def dictionary(self) -> DataFrame:
        if self.kept is not None:
            return self.kept
        return self._entries(self.words(), F.count("*"))

    def _entries(self, words: DataFrame, count: Column) -> DataFrame:
        stats = words.groupBy("tag").agg(count.alias("post_count"))
        return stats.select(
            F.col("tag").alias("name"), (F.ascii("tag") % 5).alias("category"), "post_count",
            F.reverse("tag").alias("aliases"),
        )

    def translations(self) -> DataFrame:
        """Two thirds of tag and language pairs; every fourth again with a later seq."""
        lang = F.explode(F.array(*[F.lit(x) for x in LANGS]))
        rows = self.dictionary().select(F.col("name").alias("tag"), "post_count", lang.alias("lang"))
        n = F.length("tag") + F.col("post_count") + F.length("lang")
        rows = rows.withColumn("n", n).where("n % 3 <> 0")
        seqs = F.explode_outer(F.when(F.col("n") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        rows = rows.select("tag", "lang", seqs.alias("seq")).withColumn("seq", F.col("seq").cast("long"))
        return rows.withColumn("translated", F.concat("lang", F.lit(":"), F.col("tag"), F.lit(":"), F.col("seq").cast("string")))

    def cache(self) -> DataFrame:
        """One translation per tag and language."""
        return self.translations().where("seq = 1")

    def parts(self) -> DataFrame:
        """Words sorted by length into the fields of a document."""
        def pick(r: int):
            return F.filter("tags", lambda w: F.length(w) % 4 == r)

        return self.captions().select(
            "asset_id", "name", "lang", "source",
            pick(0).alias("q"), pick(1).alias("a"), pick(2).alias("t"), pick(3).alias("e"),
        )

    def docs(self) -> DataFrame:
        doc = F.struct(
            F.struct(F.col("lang").alias("quality"), F.lit(None).cast("string").alias("series"),
                     F.concat(F.lit("@"), F.col("source")).alias("artist")).alias("fixed"),
            F.struct(F.array_join("q", ", ").alias("name"), F.lit("").alias("variant")).alias("character"),
            F.struct(F.col("a").alias("appearance")).alias("from_path"),
            F.struct(F.lit("1girl, solo").alias("count"), F.concat("e", "a").alias("appearance"), F.col("t").alias("tags"),
                     F.col("e").alias("environment"), F.lit(None).cast("string").alias("nl")).alias("ai_output"),
        )
        return self.parts().select("asset_id", "name", doc.alias("doc"))

    def taxonomy(self) -> DataFrame:
        """Keywords from part types and names: groups by their first letter."""
        part = self.table("part")
        word = part.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("keyword")).distinct()
        code = F.ascii("keyword") % 3
        return word.select("keyword", F.when(code == 0, "appearance").when(code == 1, "environment").otherwise("count").alias("grp"))

    # embeddings -----------------------------------------------------------------

    def scores(self) -> DataFrame:
        return self.balanced("embeddings").select(
            F.col("vec_id").alias("asset_id"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("scores")
        )

    def probs(self) -> DataFrame:
        from tagloom.operators.scoring import sigmoid_scores

        return sigmoid_scores(self.scores())

    def features(self) -> DataFrame:
        return self.balanced("embeddings").select(
            F.col("vec_id").alias("asset_id"), F.format_string("vec_%08d.png", "vec_id").alias("name"),
            F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label",
        )

    def hashes(self) -> DataFrame:
        """Bit i of ``dhash``: value i is positive; of ``phash``: value i exceeds the next."""
        e = F.col("vec")

        def packed(bit):
            bits = F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), bit)
            return F.aggregate(bits, F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))

        one, zero = F.expr("1L"), F.expr("0L")
        dh = packed(lambda i: F.when(F.get(e, i) > 0, one).otherwise(zero))
        ph = packed(lambda i: F.when(F.get(e, i) > F.get(e, (i + 1) % 64), one).otherwise(zero))
        raw = F.transform(F.slice(e, 1, 48), F.abs)

        def block(i):
            part = F.slice(raw, i * 16 + 1, 16)
            total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
            return F.transform(part, lambda x: x / total)

        hist = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), block))
        return self.features().select("asset_id", dh.alias("dhash"), ph.alias("phash"), hist.alias("hist"))

    def fingerprints(self) -> DataFrame:
        """Every hash with three copies that flip 0 to 9 bits of each, by id and copy."""
        k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
        rows = self.hashes().select("asset_id", "dhash", "phash", "hist", k)
        flips = F.when(F.col("k") == 0, 0).otherwise((F.col("asset_id") + F.col("k") * 3) % 10).cast("int")

        def flipped(h: str, stride: int):
            spots = F.when(flips > 0, F.transform(F.sequence(F.lit(1), flips), lambda j: ((F.col("asset_id") + j * stride) % 62).cast("int")))
            return F.aggregate(
                F.coalesce(F.array_distinct(spots), F.array().cast("array<int>")), F.col(h),
                lambda acc, s: acc.bitwiseXOR(F.call_function("shiftleft", F.expr("1L"), s)),
            )

        return rows.select(
            F.format_string("img_%d_%08d.png", F.col("k"), F.col("asset_id")).alias("name"),
            flipped("dhash", 7).alias("dhash"), flipped("phash", 11).alias("phash"), "hist",
        )

    def gray(self) -> DataFrame:
        """Embeddings as 8 x 8 gray images."""
        return self._pixels("floor((x + 1) * 127)", 8, 8, 1)

    def rgba(self) -> DataFrame:
        """Embeddings as 4 x 4 images with alpha; most alphas are full."""
        return self._pixels("least(255, floor((x + 1) * 300))", 4, 4, 4)

    def _pixels(self, value: str, height: int, width: int, channels: int) -> DataFrame:
        rows = self.features().selectExpr(
            "asset_id", "name", f"transform(vec, x -> cast({value} AS int)) AS px",
            f"{height} AS height", f"{width} AS width", f"{channels} AS channels",
        )
        data = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
        return rows.withColumn("data", data)

    def pictures(self) -> DataFrame:
        """Whole documents as RGB images, 24 pixels wide, the last line padded."""
        width = 24
        body = F.encode("text", "UTF-8")
        height = F.ceil(F.octet_length("text") / (width * 3)).cast("int")
        return self.balanced("documents").select(
            F.col("doc_id").alias("asset_id"), F.format_string("/data/doc_%08d.png", "doc_id").alias("name"),
            F.rpad(body, height * (width * 3), F.lit(b" ")).alias("data"), height.alias("height"),
            F.lit(width).alias("width"), F.lit(3).alias("channels"),
        )

    def detections(self) -> DataFrame:
        """Embeddings as ten raw detector rows of six numbers on a 640 canvas."""
        from tagloom.functions.geometry import letterbox

        a = self.balanced("embeddings").selectExpr(
            "vec_id AS asset_id",
            "array('full', 'head', 'eyes', 'halfbody')[cast(vec_id % 4 AS int)] AS kind",
            "400 + (vec_id * 37) % 900 AS width", "400 + (vec_id * 101) % 900 AS height",
            "transform(embedding, (x, i) -> CASE i % 6 WHEN 0 THEN 320 + cast(x AS double) * 300 "
            "WHEN 1 THEN 320 + cast(x AS double) * 300 WHEN 2 THEN 40 + abs(cast(x AS double)) * 600 "
            "WHEN 3 THEN 40 + abs(cast(x AS double)) * 600 ELSE least(1.0D, 0.55D + abs(cast(x AS double)) * 2) END) AS raw",
        )
        return a.withColumn("fit", letterbox(F.col("width"), F.col("height"), 640))

    # labels, conversations, events -----------------------------------------------

    def concepts(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "source")
        rows = self.table("labels").join(docs, "doc_id")
        return rows.groupBy("source", "quality", "toxic").agg(F.count("*").alias("image_count")).select(
            F.col("source").alias("name"), "image_count", (1 + F.col("quality") * 2 + F.col("toxic")).alias("repeats")
        )

    def replies(self) -> DataFrame:
        return self.table("conversations").where("role = 'assistant'").selectExpr(
            "conv_id * 1000 + turn AS asset_id", "text AS content",
            "'Why: ' || text AS reasoning",
        )

    def progress(self) -> DataFrame:
        return self.table("events").selectExpr(
            "ts", "user_id AS job", "event_id AS current", "cast(value * 100 AS bigint) AS total",
            "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'processing' ELSE 'success' END AS status",
        )


_EXT_LIST = "[" + ", ".join(f"'{e}'" for e in EXTS) + "]"
_PACK = "(SELECT CAST(CASE WHEN s >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END AS BIGINT) FROM (SELECT coalesce(sum(CASE WHEN {test} THEN 1::HUGEINT << i ELSE 0::HUGEINT END), 0) AS s FROM range(64) r(i)))"

# fixed values: the same inputs as SQL for the other engine
SQL_VIEWS: dict[str, str] = {
    "fx_assets": f"""
        SELECT o_orderkey AS asset_id,
               'img_' || printf('%08d', o_orderkey) || '.' || {_EXT_LIST}[o_orderkey % 8 + 1] AS name,
               {_EXT_LIST}[o_orderkey % 8 + 1] AS ext,
               256 + (o_orderkey * 37) % 1793 AS width, 256 + (o_orderkey * 101) % 1793 AS height,
               10000 + (o_orderkey * 7919) % 5000000 AS size_bytes,
               '/data/img_' || printf('%08d', o_orderkey) || '.' || {_EXT_LIST}[o_orderkey % 8 + 1] AS path
        FROM orders""",
    "fx_tag_rows": "SELECT l_orderkey AS asset_id, lower(p_name) AS tag, p_type FROM lineitem JOIN part ON l_partkey = p_partkey",
    "fx_vocab": f"""
        SELECT idx, replace(n, ' ', '_') AS name, [{', '.join(f"'{c}'" for c in CATEGORIES)}][idx % 8 + 1] AS category
        FROM (SELECT n, CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS idx
              FROM (SELECT DISTINCT lower(p_name) AS n FROM part))""",
    "fx_captions": """
        SELECT doc_id AS asset_id, 'Img_' || printf('%08d', doc_id) || '.png' AS name, text AS caption,
               list_filter(string_split(translate(text, chr(32) || chr(10) || chr(9), ',,,'), ','), lambda w: w <> '') AS tags,
               lang, source
        FROM documents""",
    "fx_words": "SELECT asset_id, unnest(tags) AS tag FROM fx_captions",
    "fx_dict": """
        SELECT tag AS name, CAST(ascii(tag) % 5 AS INTEGER) AS category, count(*) AS post_count, reverse(tag) AS aliases
        FROM fx_words GROUP BY tag""",
    "fx_translations": """
        SELECT tag, lang, seq, lang || ':' || tag || ':' || seq AS translated
        FROM (SELECT tag, lang, unnest(CASE WHEN n % 4 = 0 THEN [1, 2] ELSE [1] END)::BIGINT AS seq
              FROM (SELECT name AS tag, lang, length(name) + post_count + length(lang) AS n
                    FROM fx_dict, (VALUES ('zh-CN'), ('ja'), ('ko')) l(lang))
              WHERE n % 3 <> 0)""",
    "fx_cache": "SELECT * FROM fx_translations WHERE seq = 1",
    "fx_parts": """
        SELECT asset_id, name, lang, source,
               list_filter(tags, lambda w: length(w) % 4 = 0) AS q, list_filter(tags, lambda w: length(w) % 4 = 1) AS a,
               list_filter(tags, lambda w: length(w) % 4 = 2) AS t, list_filter(tags, lambda w: length(w) % 4 = 3) AS e
        FROM fx_captions""",
    "fx_taxonomy": """
        SELECT keyword, CASE ascii(keyword) % 3 WHEN 0 THEN 'appearance' WHEN 1 THEN 'environment' ELSE 'count' END AS grp
        FROM (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS keyword FROM part)""",
    "fx_scores": "SELECT vec_id AS asset_id, list_transform(embedding, lambda x: x::DOUBLE * 10) AS scores FROM embeddings",
    "fx_long": """
        SELECT asset_id, v.idx, v.name, v.category, 1 / (1 + exp(-greatest(-30.0, least(30.0, s.scores[v.idx + 1])))) AS prob
        FROM fx_scores s JOIN fx_vocab v ON v.idx < len(s.scores)""",
    "fx_features": """
        SELECT vec_id AS asset_id, 'vec_' || printf('%08d', vec_id) || '.png' AS name,
               list_transform(embedding, lambda x: x::DOUBLE) AS vec, label
        FROM embeddings""",
    "fx_hash": f"""
        SELECT asset_id, {_PACK.format(test='vec[i + 1] > 0')} AS dhash,
               {_PACK.format(test='vec[i + 1] > vec[(i + 1) % 64 + 1]')} AS phash,
               list_concat(list_concat(
                 list_transform(vec[1:16], lambda x: abs(x) / list_sum(list_transform(vec[1:16], lambda y: abs(y)))),
                 list_transform(vec[17:32], lambda x: abs(x) / list_sum(list_transform(vec[17:32], lambda y: abs(y))))),
                 list_transform(vec[33:48], lambda x: abs(x) / list_sum(list_transform(vec[33:48], lambda y: abs(y))))) AS hist
        FROM fx_features""",
    "fx_fingerprints": """
        SELECT 'img_' || k || '_' || printf('%08d', asset_id) || '.png' AS name,
               xor(dhash, coalesce((SELECT bit_xor(1::BIGINT << ((asset_id + j * 7) % 62)::INTEGER)
                   FROM (SELECT DISTINCT (asset_id + j * 7) % 62, min(j) AS j FROM range(1, f + 1) r(j) GROUP BY 1)), 0)) AS dhash,
               xor(phash, coalesce((SELECT bit_xor(1::BIGINT << ((asset_id + j * 11) % 62)::INTEGER)
                   FROM (SELECT DISTINCT (asset_id + j * 11) % 62, min(j) AS j FROM range(1, f + 1) r(j) GROUP BY 1)), 0)) AS phash,
               hist
        FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE (asset_id + k * 3) % 10 END AS f FROM fx_hash, range(4) c(k))""",
    "fx_gray": "SELECT asset_id, name, list_transform(vec, lambda x: CAST(floor((x + 1) * 127) AS INTEGER)) AS px FROM fx_features",
    "fx_rgba": "SELECT asset_id, name, list_transform(vec, lambda x: CAST(least(255, floor((x + 1) * 300)) AS INTEGER)) AS px FROM fx_features",
    "fx_detections": """
        SELECT vec_id AS asset_id, ['full', 'head', 'eyes', 'halfbody'][vec_id % 4 + 1] AS kind,
               400 + (vec_id * 37) % 900 AS width, 400 + (vec_id * 101) % 900 AS height,
               list_transform(embedding, lambda x, j: CASE (j - 1) % 6
                   WHEN 0 THEN 320 + x::DOUBLE * 300 WHEN 1 THEN 320 + x::DOUBLE * 300
                   WHEN 2 THEN 40 + abs(x::DOUBLE) * 600 WHEN 3 THEN 40 + abs(x::DOUBLE) * 600
                   ELSE least(1.0, 0.55 + abs(x::DOUBLE) * 2) END) AS raw
        FROM embeddings""",
    "fx_boxes": """
        SELECT asset_id, kind, width, height, i AS row,
               greatest(0, least((cx - w / 2 - px) / sc, width)) AS x1, greatest(0, least((cy - h / 2 - py) / sc, height)) AS y1,
               greatest(0, least((cx + w / 2 - px) / sc, width)) AS x2, greatest(0, least((cy + h / 2 - py) / sc, height)) AS y2,
               obj * cls AS conf, obj
        FROM (SELECT asset_id, kind, width, height, i, raw[i * 6 + 1] AS cx, raw[i * 6 + 2] AS cy, raw[i * 6 + 3] AS w,
                     raw[i * 6 + 4] AS h, raw[i * 6 + 5] AS obj, raw[i * 6 + 6] AS cls,
                     least(640.0 / width, 640.0 / height) AS sc,
                     floor((640 - floor(width * least(640.0 / width, 640.0 / height))) / 2) AS px,
                     floor((640 - floor(height * least(640.0 / width, 640.0 / height))) / 2) AS py
              FROM fx_detections, range(10) r(i))""",
    "fx_kept": """
        SELECT * FROM fx_boxes WHERE obj >= 0.6 AND conf >= 0.6 AND x2 - x1 > 5 AND y2 - y1 > 5""",
    "fx_concepts": """
        SELECT source AS name, count(*) AS image_count, 1 + quality * 2 + toxic AS repeats
        FROM labels JOIN documents USING (doc_id) GROUP BY source, quality, toxic""",
    "fx_replies": """
        SELECT conv_id * 1000 + turn AS asset_id, text AS content, 'Why: ' || text AS reasoning
        FROM conversations WHERE role = 'assistant'""",
    "fx_progress": """
        SELECT ts, user_id AS job, event_id AS current, CAST(floor(value * 100) AS BIGINT) AS total,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'processing' ELSE 'success' END AS status
        FROM events""",
}
