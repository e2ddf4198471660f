"""Data work around a remote text service; the call itself is the user's."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tagloom.functions import tags as T
from tagloom.operators.maintenance import untranslated_tags, upsert_translations
from tagloom.operators.ranking import chunk_rows
from tagloom.session import materialize

FENCE = "```"
SHOWN_DIFFERENCES = 5


def render_prompt(prompt: Column | str, tags: Column) -> Column:
    """Put the tag list in place of ``{tags}``, or under the prompt."""
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    listed = T.join_tags(tags)
    inline = F.replace(prompt, F.lit("{tags}"), listed)
    return F.when(prompt.contains("{tags}"), inline).otherwise(F.concat(prompt, F.lit("\n\nTags: "), listed))


def build_request(
    user: Column, model: str, temperature: float, max_tokens: int = 0, top_p: float = 0.0, system: Column | None = None
) -> Column:
    """Chat request as JSON; limits outside their range are left out."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = ([message("system", system)] if system is not None else []) + [message("user", user)]
    fields = [F.lit(model).alias("model"), F.array(*messages).alias("messages")]
    if max_tokens > 0:
        fields.append(F.lit(max_tokens).alias("max_tokens"))
    fields.append(F.lit(temperature).alias("temperature"))
    if 0.0 < top_p <= 1.0:
        fields.append(F.lit(top_p).alias("top_p"))
    return F.to_json(F.struct(*fields))


def enrich_rows(
    rows: DataFrame,
    call: Callable[[str], str],
    request: str = "request",
    concurrency: int | None = None,
    interval: float = 0.0,
) -> DataFrame:
    """Call a user function for every request; add ``reply`` and ``error``.

    ``concurrency`` is the number of partitions, ``interval`` the pause in
    seconds between calls of one partition.  An error stays with its row.
    """
    spread = rows.repartition(concurrency) if concurrency else rows
    schema = StructType([*spread.schema.fields, StructField("reply", StringType()), StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            replies, errors = [], []
            for text in batch[request]:
                if interval and not first:
                    time.sleep(interval)
                first = False
                try:
                    replies.append(call(text))
                    errors.append(None)
                except Exception as problem:
                    replies.append(None)
                    errors.append(f"{type(problem).__name__}: {problem}")
            yield batch.assign(reply=replies, error=errors)

    return spread.mapInPandas(run, schema)


def pick_reply(content: Column, reasoning: Column) -> Column:
    """The answer, else the reasoning text, else null; trimmed."""

    def filled(text: Column) -> Column:
        return F.nullif(T.strip(F.coalesce(text, F.lit(""))), F.lit(""))

    return F.coalesce(filled(content), filled(reasoning))


def pick_reply_json(response: Column) -> Column:
    base = "$.choices[0].message"
    return pick_reply(F.get_json_object(response, f"{base}.content"), F.get_json_object(response, f"{base}.reasoning_content"))


def reply_line(reply: Column) -> Column:
    """Of several lines the longest (in bytes) with a comma, the last of equals."""
    lines = F.transform(F.split(reply, "\n"), lambda s: F.regexp_replace(s, "\r$", ""))
    with_comma = F.filter(lines, lambda s: s.contains(","))
    longest = F.aggregate(
        with_comma,
        F.lit(None).cast("string"),
        lambda best, s: F.when(best.isNull() | (F.octet_length(s) >= F.octet_length(best)), s).otherwise(best),
    )
    return F.when(reply.contains("\n"), F.coalesce(longest, reply)).otherwise(reply)


def parse_tag_reply(reply: Column) -> Column:
    """Tags of a reply; null when there are none."""
    tags = T.split_tags(reply_line(reply))
    return F.when(F.size(tags) > 0, tags)


def verify_tag_order(df: DataFrame, original: str, revised: str) -> DataFrame:
    """What a rewrite changed; the differences shown are the first five by name."""
    old, new = F.col(original), F.col(revised)
    missing, added = T.missing_tags(old, new), T.added_tags(old, new)

    def note(label: str, items: Column) -> Column:
        shown = F.array_join(F.slice(items, 1, SHOWN_DIFFERENCES), ", ")
        more = F.when(F.size(items) > SHOWN_DIFFERENCES, F.concat(F.lit(" of "), F.size(items).cast("string"))).otherwise("")
        return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), shown, more))

    count = F.when(
        F.size(old) != F.size(new),
        F.concat(F.lit("count: "), F.size(old).cast("string"), F.lit(" to "), F.size(new).cast("string")),
    )
    warnings = F.array_compact(F.array(count, note("missing", missing), note("added", added)))
    return df.withColumns({
        "changed": ~old.eqNullSafe(new),
        "original_count": F.size(old),
        "sorted_count": F.size(new),
        "missing": missing,
        "added": added,
        "warnings": warnings,
    })


def unfence(text: Column) -> Column:
    """Take a surrounding code fence off; one that is not closed stays."""
    trimmed = T.strip(text)
    out = trimmed
    for opening in (FENCE, FENCE + "json"):
        room = F.length(trimmed) >= len(opening) + len(FENCE)
        inner = F.substr(trimmed, F.lit(len(opening) + 1), F.length(trimmed) - len(opening) - len(FENCE))
        closed = trimmed.startswith(opening) & trimmed.endswith(FENCE) & room
        out = F.when(closed, T.strip(inner)).when(trimmed.startswith(opening), trimmed).otherwise(out)
    return out


def parse_doc_reply(text: Column, flat: bool = False) -> Column:
    """Valid JSON as it is, anything else wrapped as the description field."""
    clean = unfence(text)
    wrapped = F.struct(text.alias("nl"))
    wrapped = wrapped if flat else F.struct(wrapped.alias("ai_output"))
    return F.when(F.try_parse_json(clean).isNotNull(), clean).otherwise(F.to_json(wrapped))


# -- translation ----------------------------------------------------------------


def prepare_translation(text: Column, mode: str = "tags") -> Column:
    return F.replace(text, F.lit("_"), F.lit(" ")) if mode == "tags" else text


def zip_translations(batches: DataFrame, bulk: bool = False) -> DataFrame:
    """``(tag, translated)`` from rows of ``tags`` and reply ``lines`` by position.

    A missing line, or one equal to its source, gives an empty translation; the
    ``bulk`` variant keeps equal ones and drops the empty.
    """
    rows = batches.select(F.posexplode_outer("tags").alias("i", "tag"), "lines").where("tag is not null")
    line = T.strip(F.coalesce(F.get("lines", F.col("i")), F.lit("")))
    rows = rows.select("tag", line.alias("translated"))
    if bulk:
        return rows.where("translated <> ''")
    same = F.lower("translated") == F.lower(prepare_translation(F.col("tag")))
    return rows.withColumn("translated", F.when(same, "").otherwise(F.col("translated")))


def translate_missing(
    dictionary: DataFrame,
    translations: DataFrame,
    lang: str,
    call: Callable[[str], str],
    size: int = 80,
    seq: int = 1 << 40,
    concurrency: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(new cache, failed batches)`` after translating what a language lacks.

    Batches hold ``size`` names, one per line, in order of use; services take 200 at
    most.  Answers are written once, so reading both results calls no service twice.
    """
    if not 1 <= size <= 200:
        raise ValueError("a batch holds 1 to 200 names")
    todo = untranslated_tags(dictionary, translations, lang)
    numbered = chunk_rows(todo, [-F.col("post_count"), F.col("name")], size)
    batches = numbered.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("rows"))
    batches = batches.select("chunk", F.transform("rows", lambda r: r["name"]).alias("tags"))
    batches = batches.withColumn("request", F.array_join("tags", "\n"))
    answered = materialize(enrich_rows(batches, call, concurrency=concurrency))
    lines = answered.where("error is null").withColumn("lines", F.split("reply", "\n"))
    fresh = zip_translations(lines, bulk=True).withColumns({"lang": F.lit(lang), "seq": F.lit(seq).cast("long")})
    return upsert_translations(translations, fresh), answered.where("error is not null").select("chunk", "tags", "error")


def translate_tags(
    tags: DataFrame,
    translations: DataFrame,
    lang: str,
    call: Callable[[str], str],
    size: int = 20,
    seq: int = 1 << 40,
    concurrency: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(translated, new cache, failed batches)`` for the tags of a dataset.

    Different tags that the cache lacks are sent in batches of ``size``, underscores as
    blanks, one per line; answers that are missing, or equal to the tag, are not kept.
    """
    asked = tags.select("tag").where("tag is not null").distinct()
    known = translations.where(F.col("lang") == lang).select("tag", "translated")
    todo = materialize(asked.join(known, "tag", "left_anti"))  # numbering reads it several times
    numbered = chunk_rows(todo, [F.col("tag")], size)
    batches = numbered.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("position", "tag"))).alias("rows"))
    batches = batches.select("chunk", F.transform("rows", lambda r: r["tag"]).alias("tags"))
    batches = batches.withColumn("request", F.array_join(F.transform("tags", lambda t: prepare_translation(t)), "\n"))
    answered = materialize(enrich_rows(batches, call, concurrency=concurrency))
    fresh = zip_translations(answered.where("error is null").withColumn("lines", F.split("reply", "\n"))).where("translated <> ''")
    cache = upsert_translations(translations, fresh.withColumns({"lang": F.lit(lang), "seq": F.lit(seq).cast("long")}))
    both = known.unionByName(fresh.select("tag", "translated"))
    return asked.join(both, "tag", "left"), cache, answered.where("error is not null").select("chunk", "tags", "error")
