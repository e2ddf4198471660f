"""Structured tag documents: reading both layouts, editing, converting, building.

A document column is a struct of the full layout (:data:`DOC`); the flat layout
(:data:`FLAT`) carries the same content under top-level keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import tags as T
from tagloom.operators.skew import join_heavy
from tagloom.session import materialize

DOC = (
    "struct<fixed:struct<quality:string,series:string,artist:string>,"
    "character:struct<name:string,variant:string>,"
    "from_path:struct<appearance:array<string>>,"
    "ai_output:struct<count:string,appearance:array<string>,tags:array<string>,"
    "environment:array<string>,nl:string>>"
)
FLAT = (
    "struct<quality:string,series:string,artist:string,character:string,count:string,"
    "appearance:array<string>,tags:array<string>,environment:array<string>,nl:string>"
)
TEXT_PATHS = (
    "fixed.quality", "fixed.series", "fixed.artist", "character.name", "character.variant",
    "ai_output.count", "ai_output.nl",
)
LIST_PATHS = ("from_path.appearance", "ai_output.appearance", "ai_output.tags", "ai_output.environment")
PARTS = ("fixed", "character", "from_path", "ai_output")
FLAT_TEXTS = ("quality", "series", "artist", "character", "count", "nl")
FLAT_LISTS = ("appearance", "tags", "environment")
NO_TAGS = "array<string>"


def _empty() -> Column:
    return F.array().cast(NO_TAGS)


def _member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _kinds(v: Column, paths: Sequence[str]) -> Column:
    """Type names of members, null where one is absent; computed once per row."""
    return F.struct(*[F.schema_of_variant(_member(v, p)).alias(p.replace(".", "_")) for p in paths])


def _kind(path: str) -> Column:
    return F.col("_k")[path.replace(".", "_")]


def _text(v: Column, path: str) -> Column:
    return F.when(_kind(path) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))


def _list(v: Column, path: str) -> Column:
    """A list member: an array's strings, or a comma text split up; else empty."""
    kind = _kind(path)
    mixed = F.filter(F.try_variant_get(v, f"$.{path}", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return (
        F.when(kind == "ARRAY<STRING>", F.try_variant_get(v, f"$.{path}", "array<string>"))
        .when(kind == "STRING", T.split_tags(F.try_variant_get(v, f"$.{path}", "string")))
        .when(kind.startswith("ARRAY"), F.transform(mixed, lambda x: F.variant_get(x, "$", "string")))
        .otherwise(_empty())
    )


def _fits(path: str, *kinds: str) -> Column:
    return F.coalesce(_kind(path).isin(*kinds), F.lit(True))


def _doc(fixed: Sequence[Column], character: Sequence[Column], from_path: Column, ai: Sequence[Column]) -> Column:
    names = ("count", "appearance", "tags", "environment", "nl")
    return F.struct(
        F.struct(*[c.alias(n) for n, c in zip(("quality", "series", "artist"), fixed)]).alias("fixed"),
        F.struct(*[c.alias(n) for n, c in zip(("name", "variant"), character)]).alias("character"),
        F.struct(from_path.alias("appearance")).alias("from_path"),
        F.struct(*[c.alias(n) for n, c in zip(names, ai)]).alias("ai_output"),
    )


def empty_doc() -> Column:
    none = F.lit(None).cast("string")
    return _doc([none] * 3, [F.lit("")] * 2, _empty(), [none, _empty(), _empty(), _empty(), none])


def detect_format(content: Column) -> Column:
    """``full``, ``simplified`` or ``unknown`` from the top-level keys."""
    keys = F.json_object_keys(content)
    marks = T.literal_list(["ai_output", "fixed", "from_path"])
    valid = F.try_parse_json(content).isNotNull() & keys.isNotNull()
    return F.when(~valid, "unknown").when(F.arrays_overlap(keys, marks), "full").otherwise("simplified")


def parse_full(v: Column) -> Column:
    """A full document from a variant; null if a member has the wrong type."""
    ok = F.lit(True)
    for path in TEXT_PATHS:
        ok = ok & _fits(path, "STRING", "VOID")
    for path in LIST_PATHS:
        ok = ok & _fits(path, "STRING", "ARRAY<STRING>", "ARRAY<VOID>")
    for part in PARTS:
        ok = ok & F.coalesce(_kind(part).startswith("OBJECT"), F.lit(True))
    doc = _doc(
        [_text(v, f"fixed.{k}") for k in ("quality", "series", "artist")],
        [F.coalesce(_text(v, f"character.{k}"), F.lit("")) for k in ("name", "variant")],
        _list(v, "from_path.appearance"),
        [_text(v, "ai_output.count")]
        + [_list(v, f"ai_output.{k}") for k in ("appearance", "tags", "environment")]
        + [_text(v, "ai_output.nl")],
    )
    return F.when(ok, doc)


def parse_flat(v: Column) -> Column:
    """A full document from a variant in the flat layout; wrong types are ignored."""
    return _doc(
        [_text(v, k) for k in ("quality", "series", "artist")],
        [F.coalesce(_text(v, "character"), F.lit("")), F.lit("")],
        _empty(),
        [_text(v, "count")] + [_list(v, k) for k in ("appearance", "tags", "environment")] + [_text(v, "nl")],
    )


def parse_tag_docs(rows: DataFrame, content: str = "content") -> DataFrame:
    """Add ``format``, ``doc`` and ``has_json`` to rows of JSON text (null = no file)."""
    v = F.col("_v")
    full = F.col("format") == "full"
    parsed = F.when(full, parse_full(v)).when(F.col("format") == "simplified", parse_flat(v))
    members = dict.fromkeys((*TEXT_PATHS, *LIST_PATHS, *PARTS, *FLAT_TEXTS, *FLAT_LISTS))
    return (
        rows.withColumn("has_json", F.col(content).isNotNull())
        .withColumn("format", F.coalesce(detect_format(F.col(content)), F.lit("unknown")))
        .withColumn("_v", F.try_parse_json(F.col(content)))
        .withColumn("_k", _kinds(v, tuple(members)))
        .withColumn("doc", parsed)
        .withColumn("format", F.when(F.col("doc").isNull(), "unknown").otherwise(F.col("format")))
        .withColumn("doc", F.coalesce("doc", empty_doc()))
        .drop("_v", "_k")
    )


def dataset_format(docs: DataFrame) -> DataFrame:
    """The first known format in file-name order."""
    known = F.when(F.col("format") != "unknown", F.col("name"))
    return docs.agg(F.coalesce(F.min_by("format", known), F.lit("unknown")).alias("detected_format"))


# -- conversion and output ----------------------------------------------------


def doc_to_flat(doc: Column) -> Column:
    """Flat layout; both appearance lists are merged and the variant is lost."""
    ai = doc["ai_output"]
    return F.struct(
        doc["fixed"]["quality"].alias("quality"),
        doc["fixed"]["series"].alias("series"),
        doc["fixed"]["artist"].alias("artist"),
        F.nullif(doc["character"]["name"], F.lit("")).alias("character"),
        ai["count"].alias("count"),
        T.ordered_union(doc["from_path"]["appearance"], ai["appearance"]).alias("appearance"),
        ai["tags"].alias("tags"),
        ai["environment"].alias("environment"),
        ai["nl"].alias("nl"),
    )


def flat_to_doc(rows: DataFrame, content: str = "content") -> DataFrame:
    """Add ``doc``, the full layout of flat JSON text; lists may be arrays or comma texts."""
    v = F.col("_v")
    parsed = rows.withColumn("_v", F.try_parse_json(F.col(content))).withColumn("_k", _kinds(v, FLAT_TEXTS + FLAT_LISTS))
    return parsed.withColumn("doc", parse_flat(v)).drop("_v", "_k")


def _or_null(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def flat_json(flat: Column) -> Column:
    """JSON text of a flat document without absent fields and empty lists."""
    lists = {n: _or_null(flat[n]) for n in ("appearance", "tags", "environment")}
    names = ("quality", "series", "artist", "character", "count", "appearance", "tags", "environment", "nl")
    return F.to_json(F.struct(*[lists.get(n, flat[n]).alias(n) for n in names]))


def doc_json(doc: Column, drop_empty_parts: bool = False) -> Column:
    """JSON text of a full document; its four parts stay even when empty."""
    ai = doc["ai_output"]
    fixed = F.struct(*[doc["fixed"][n].alias(n) for n in ("quality", "series", "artist")])
    character = F.struct(*[F.nullif(doc["character"][n], F.lit("")).alias(n) for n in ("name", "variant")])
    from_path = F.struct(_or_null(doc["from_path"]["appearance"]).alias("appearance"))
    output = F.struct(
        ai["count"].alias("count"),
        *[_or_null(ai[n]).alias(n) for n in ("appearance", "tags", "environment")],
        ai["nl"].alias("nl"),
    )
    parts = {"fixed": fixed, "character": character, "from_path": from_path, "ai_output": output}
    if drop_empty_parts:
        parts = {n: F.when(F.to_json(p) != "{}", p) for n, p in parts.items()}
    return F.to_json(F.struct(*[p.alias(n) for n, p in parts.items()]))


# -- editing --------------------------------------------------------------------


def _with_field(doc: Column, path: str, value: Column) -> Column:
    part, field = path.split(".")
    return doc.withField(part, doc[part].withField(field, value))


def edit_list(doc: Column, path: str, action: str, *args) -> Column:
    """``add`` (if absent), ``remove`` or ``move`` inside one list of the document."""
    part, field = path.split(".")
    items = doc[part][field]
    if action == "add":
        new = T.union_tags(items, F.array(F.lit(args[0])))
    elif action == "remove":
        new = T.remove_tags(items, F.array(F.lit(args[0])))
    elif action == "move":
        new = T.move_tag(items, F.lit(args[0]), F.lit(args[1]))
    else:
        raise ValueError(f"unknown action {action!r}")
    return _with_field(doc, path, new)


def edit_text(doc: Column, path: str, action: str, *args) -> Column:
    """The same on a field that holds a comma text; an emptied field becomes null."""
    part, field = path.split(".")
    parts = T.split_tags(F.coalesce(doc[part][field], F.lit("")))
    if action == "add":
        new = T.union_tags(parts, F.array(F.lit(args[0])))
    elif action == "remove":
        new = T.remove_tags(parts, F.array(F.lit(args[0])))
    elif action == "move":
        new = T.move_tag(parts, F.lit(args[0]), F.lit(args[1]))
    else:
        raise ValueError(f"unknown action {action!r}")
    return _with_field(doc, path, F.nullif(T.join_tags(new), F.lit("")))


def doc_tags(doc: Column) -> Column:
    """Every tag of a document: the four lists, then the six comma texts."""
    lists = [doc[p][f] for p, f in (path.split(".") for path in LIST_PATHS)]
    texts = [doc[p][f] for p, f in (path.split(".") for path in TEXT_PATHS if path != "ai_output.nl")]
    return F.concat(*lists, *[T.split_tags(F.coalesce(t, F.lit(""))) for t in texts])


# -- building from selected tags --------------------------------------------------


#: Letters of the piece that a contained keyword is looked up by; shorter keywords count only when equal.
PIECE = 4
GROUPS = ("appearance", "environment", "count")


@dataclass(frozen=True)
class Taxonomy:
    """Keyword lists that sort general tags into groups; an input table ``(keyword, grp)`` of the user's, of any size."""

    table: DataFrame

    @classmethod
    def load(cls, table: DataFrame) -> Taxonomy:
        return cls(table.select("keyword", "grp").where(F.col("grp").isin(*GROUPS)).distinct())

    def ranked(self, tags: DataFrame) -> DataFrame:
        """``(tag, grp, counted)`` of every different tag of a ``(tag)`` relation.

        Equal keywords first, then contained ones of PIECE letters and more, each time appearance before
        environment; ``counted`` marks keywords of the group count.  A contained keyword is met by its rarest piece: tags list
        all their pieces, so the join is on an equal key, and only what meets is tested in full.
        """
        named = materialize(tags.select("tag").distinct().select("tag", F.lower("tag").alias("low")))
        order = F.when(F.col("grp") == "appearance", 0).otherwise(1)
        whole = self.table.groupBy(F.col("keyword").alias("low")).agg(
            F.min(F.when(F.col("grp") != "count", order)).alias("rank"), F.bool_or(F.col("grp") == "count").alias("counted")
        )
        equal = join_heavy(named, whole, "low").select("tag", "low", "rank", F.coalesce("counted", F.lit(False)).alias("counted"))

        sought = self.table.where((F.col("grp") != "count") & (F.length("keyword") >= PIECE)).groupBy("keyword").agg(F.min(order + 2).alias("inside"))
        spread = sought.select("keyword", "inside", F.explode_outer(_pieces(F.col("keyword"))).alias("piece"))
        held = spread.groupBy("piece").agg(F.count("*").alias("n"))
        keyed = spread.join(held, "piece").groupBy("keyword", "inside").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
        pieces = named.where(F.length("low") >= PIECE).select("tag", "low", F.explode_outer(_pieces(F.col("low"))).alias("piece"))
        met = join_heavy(pieces, keyed, "piece", "inner").where(F.contains("low", "keyword"))
        inside = met.groupBy("tag").agg(F.min("inside").alias("inside"))
        rank = F.coalesce("rank", "inside")
        grp = F.when(rank.isin(0, 2), "appearance").when(rank.isin(1, 3), "environment").otherwise("tags")
        return equal.join(inside, "tag", "left").select("tag", grp.alias("grp"), "counted")


def _pieces(text: Column) -> Column:
    """The different pieces of PIECE letters of a text that has as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (PIECE - 1)), lambda i: F.substr(text, i, F.lit(PIECE))))


def classify_tags(tags: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """Group of every distinct tag of a ``(tag)`` relation."""
    return taxonomy.ranked(tags).select("tag", "grp")


def with_slots(selected: DataFrame, taxonomy: Taxonomy, tags: str) -> DataFrame:
    """``selected`` with ``slotted``: its tags in order, each with the part of a document it goes to.

    Only different names are classified.  Rows are numbered and keep their columns; a list
    is taken apart and put together again, one aggregation per row.
    """
    rows = materialize(selected.withColumn("_row", F.monotonically_increasing_id()))
    items = rows.select("_row", F.posexplode(tags).alias("_at", "_tag")).select("_row", "_at", "_tag.name", "_tag.category")
    grouped = materialize(taxonomy.ranked(items.select(F.col("name").alias("tag"))).withColumnRenamed("tag", "name"))
    category = F.col("category")
    direct = category.isin("character", "copyright", "rating", "quality", "artist")
    slot = F.when(direct, category).when(category == "model", "tags").when(F.col("counted"), "count").otherwise(F.col("grp"))
    lists = join_heavy(items, grouped, "name").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("_at", "name", slot.alias("slot")))).alias("slotted")
    )
    empty = F.array().cast("array<struct<_at:int,name:string,slot:string>>")
    return rows.join(lists, "_row", "left").withColumn("slotted", F.coalesce("slotted", empty)).drop("_row")


def build_doc(slotted: Column) -> Column:
    """Full document from an ordered ``array<struct<name, slot>>``.

    Ratings come before qualities (the last one first), the artist text gets a
    single ``@``, counts are set apart.
    """
    def pick(slot: str) -> Column:
        return F.transform(F.filter(slotted, lambda s: s["slot"] == slot), lambda s: s["name"])

    def text(items: Column) -> Column:
        return F.nullif(T.join_tags(items), F.lit(""))

    artist = text(pick("artist"))
    artist = F.when(artist.startswith("@"), artist).otherwise(F.concat(F.lit("@"), artist))
    return _doc(
        [text(F.concat(F.reverse(pick("rating")), pick("quality"))), text(pick("copyright")), artist],
        [F.coalesce(text(pick("character")), F.lit("")), F.lit("")],
        _empty(),
        [text(pick("count")), pick("appearance"), pick("tags"), pick("environment"), F.lit(None).cast("string")],
    )


def build_tag_doc(selected: DataFrame, taxonomy: Taxonomy, tags: str = "selected") -> DataFrame:
    """Add ``doc`` and its JSON text, empty parts left out."""
    out = with_slots(selected, taxonomy, tags).withColumn("doc", build_doc(F.col("slotted"))).drop("slotted")
    return out.withColumn("json", doc_json(F.col("doc"), drop_empty_parts=True))


def build_flat_doc(selected: DataFrame, taxonomy: Taxonomy, tags: str = "selected") -> DataFrame:
    """Add ``flat`` and its JSON text, in the flat layout's own key order."""
    out = with_slots(selected, taxonomy, tags).withColumn("flat", doc_to_flat(build_doc(F.col("slotted")))).drop("slotted")
    flat = F.col("flat")
    names = ("quality", "count", "character", "series", "artist", "appearance", "tags", "environment")
    lists = ("appearance", "tags", "environment")
    body = F.struct(*[(_or_null(flat[n]) if n in lists else flat[n]).alias(n) for n in names])
    return out.withColumn("json", F.to_json(body))
