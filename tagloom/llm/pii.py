"""Personal data and secrets replaced by keyed surrogates of the same kind and form, in DataFrame expressions only.

One pattern finds e-mail addresses, telephone, card and social security numbers, IPv4 addresses, access keys,
passwords, hexadecimal secrets and names behind a form of address. An entity has a canonical form (digits of a
number, lower case of an address, a name without its title, a secret without the name before it); its surrogate is a function of the key, the
kind, the canonical form and an attempt number, so the same entity has the same surrogate in every document.
Surrogates keep kind, length, punctuation and capitals, the script of letters (vowels and consonants apart), the
country code and card brand, the case of hexadecimal secrets, the validity of a card's check digit, the top-level domain, and for names the gender of
the title; addresses of one domain stay together.

Collision checks: all different entities are listed once (counts combined before their shuffle). A surrogate
that equals an entity of the corpus, or that of another entity of its kind, is drawn again with the next attempt
number until none is left. From attempt IN_FORM (IN_FORM_NAMES for given names) the form grows by a character or syllable
an attempt, so entities that fill their form get surrogates too. Words behind a given name are entities of a kind of their own,
"family", and have one surrogate in all names; only given names are drawn again. Only redrawn entities, a small
table, are joined back to the documents that hold them.

Defined results: null texts stay null and have no entity, empty ones stay empty; texts of any length are
searched whole; repeated rows change alike; an empty table gives an empty result; all other columns are passed on as
they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import stored

#: A name of a secret with what stands before its value.
KEYED = r"(?i:password|passwd|pwd|secret|token|api_key)"
#: Kind and pattern, the first that fits an entity counts.
KINDS: dict[str, str] = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]*@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "aws_key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    # a value in quotes, one right behind the sign, or one with a digit behind blanks (prose and code have words there)
    "password": KEYED + r"(?:[\"']?[ \t]*[=:][ \t]*(?:\"[^\"\r\n]{4,}(?=\"|$)|'[^'\r\n]{4,}(?='|$))|[=:][^\s\"'<>|,;]{4,}"
    r"|[\"']?[ \t]*[=:][ \t]*(?=[^\s0-9]*[0-9])[\p{L}0-9+/_.~!@#$%^&*=\-]{4,}(?=[\s\"'<>|,;]|$))",
    "hex_secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)|(?<![\d\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)[3-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{3,4}(?!\d)",
    "male": r"(?<!\p{L})(?:Mr\.?|Herr|Monsieur|Señor|Sr\.)(?: \p{Lu}\p{Ll}+){1,3}",
    "female": r"(?<!\p{L})(?:Mrs\.?|Ms\.?|Frau|Madame|Mme|Señora|Sra\.)(?: \p{Lu}\p{Ll}+){1,3}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Given names for surrogates, fixed values.
GIVEN = {
    "male": "Adam Boris Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul".split(),
    "female": "Alma Berta Clara Diana Elena Flora Greta Hanna Irene Julia Karla Laura Maria Nina Olga Petra".split(),
}
#: Letters that stand for each other: by script, lower case, vowels and consonants apart.
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àâäéèêëíîïóôöúùûüáñçß", "αειουηω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ")
#: What names stand behind, as in KINDS.
TITLES = ("Mr", "Ms", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr.", "Sra.")
#: Attempts within the form of an entity; later ones extend it.
IN_FORM, IN_FORM_NAMES = 20, 6


#: What stands before the value of a password.
BEFORE = "^" + KEYED + r"[\"']?[ \t]*[=:][ \t]*[\"']?"
SECRETS = ("aws_key", "password", "hex_secret")


def _kind(entity: Column) -> Column:
    """The kind; a key or a hexadecimal secret is one behind a name as well."""
    value, found = F.regexp_replace(entity, BEFORE, ""), None
    for kind in ("aws_key", "hex_secret"):
        fits = value.rlike(f"^(?:{KINDS[kind]})$")
        found = F.when(fits, kind) if found is None else found.when(fits, kind)
    for kind, pattern in KINDS.items():
        found = found.when(entity.rlike(f"^(?:{pattern})$"), kind)
    return found.otherwise("other")


def _is_number(kind: Column) -> Column:
    return kind.isin("phone", "card", "ssn")


def _canonical(kind: Column, entity: Column) -> Column:
    plus = F.when(entity.startswith("+"), "+").otherwise("")
    name = F.regexp_replace(entity, r"^[^ ]+ ", "")
    return (
        F.when(_is_number(kind), F.concat(plus, F.regexp_replace(entity, r"[^0-9]", "")))
        .when(kind == "email", F.lower(entity)).when(kind.isin("male", "female"), name)
        .when(kind == "hex_secret", F.lower(F.regexp_replace(entity, BEFORE, ""))).when(kind.isin(*SECRETS), F.regexp_replace(entity, BEFORE, ""))
        .otherwise(entity)
    )


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)


def _draw(digest: Column, i: Column, n: int) -> Column:
    """A number below ``n`` for place ``i``, from two bytes of the digest (places go round after 64)."""
    at = F.lit(1) + 2 * F.pmod(i, F.lit(62))
    return F.pmod(F.conv(F.substring(digest, at.cast("int"), F.lit(4)), 16, 10).cast("int") + F.floor(i / 62).cast("int") * 7, F.lit(n)).cast("int")


def _pick(values: str, digest: Column, i: Column) -> Column:
    return F.substring(F.lit(values), _draw(digest, i, len(values)) + 1, F.lit(1))


def _mapped(text: Column, digest: Column) -> Column:
    """``text`` with each letter and digit replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        small = F.lower(c)
        new = F.when(c.rlike("[0-9]"), _pick("0123456789", digest, i))
        for letters in CLASSES:
            drawn = _pick(letters, digest, i)
            new = new.when(F.instr(F.lit(letters), small) > 0, F.when(c == small, drawn).otherwise(F.upper(drawn)))
        return new.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the card check, modulo ten."""
    turned = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(turned, F.lit(0), lambda a, x: a + x) % 10


def _seeds(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The digests an entity's surrogate is drawn from: of itself, and of what it shares with others."""
    shared = F.when(kind == "email", F.substring_index(canon, "@", -1))
    return F.struct(_digest(key, kind, canon, attempt.cast("string")).alias("own"), _digest(key, F.lit("domain"), shared).alias("domain"))


def _more(letters: str, attempt: Column, in_form: int = IN_FORM) -> Column:
    """What extends a form at an attempt, letters to be replaced by others of their class."""
    return F.repeat(F.lit(letters), F.greatest(F.lit(0), attempt - in_form + 1))


def _family(key: str, word: Column, attempt: Column) -> Column:
    return _mapped(F.concat(word, _more("ba", attempt)), _digest(key, F.lit("family"), word, attempt.cast("string")))


def _surrogate(kind: Column, canon: Column, attempt: Column, families: Column, seeds: Column, key: str) -> Column:
    """The surrogate of a canonical form, itself in canonical form; ``families`` maps family names to their attempts."""
    d, tried = seeds["own"], attempt.cast("string")
    original = F.regexp_replace(canon, "[^0-9]", "")
    digits = F.concat(original, _more("0", attempt))
    drawn = F.array_join(F.transform(F.split(digits, ""), lambda c, i: _pick("0123456789", d, i)), "")
    kept = F.concat(F.substring(digits, 1, 1), F.substring(drawn, F.lit(2), F.length(drawn)))
    stem = F.substring(kept, F.lit(1), F.length(kept) - 1)
    check = F.concat(stem, ((10 - _luhn(F.concat(stem, F.lit("0")))) % 10).cast("string"))
    card = F.when(_luhn(original) == 0, check).otherwise(kept)
    phone = F.when(canon.startswith("+"), F.concat(F.lit("+"), kept)).otherwise(drawn)
    octet = lambda c, i: (
        F.when((F.length(c) == 1) & (attempt < 4), 1 + _draw(d, i, 9)).when((F.length(c) == 2) & (attempt < 4), 10 + _draw(d, i, 90))
        .when(attempt < 4, 100 + _draw(d, i, 155)).otherwise(1 + _draw(d, i, 254)).cast("string")
    )
    ip = F.array_join(F.transform(F.split(F.concat(canon, _more(".100", attempt, 2 * IN_FORM)), r"\."), octet), ".")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    top = F.substring_index(domain, ".", -1)
    place = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(_mapped(F.concat(local, _more("b", attempt)), d), F.lit("@"), _mapped(place, seeds["domain"]), F.lit("."), top)
    prefix = F.when(kind == "aws_key", F.substring(canon, 1, 4)).otherwise("")
    rest = F.concat(F.substring(canon, F.length(prefix) + 1, F.length(canon)), _more("b", attempt))
    hexed = F.array_join(F.transform(F.split(rest, ""), lambda c, i: _pick("0123456789abcdef", d, i)), "")
    upper = F.array_join(F.transform(F.split(rest, ""), lambda c, i: _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", d, i)), "")
    secret = F.concat(prefix, F.when(kind == "aws_key", upper).when(kind == "hex_secret", hexed).otherwise(_mapped(rest, d)))
    names = F.split(canon, " ")
    family = F.transform(names, lambda n: _family(key, n, F.coalesce(F.element_at(families, n), F.lit(0))))
    seed = _digest(key, F.lit("given"), names[0], tried)
    given = [F.get(F.array(*map(F.lit, GIVEN[g])), _draw(seed, F.lit(0), len(GIVEN[g]))) for g in ("male", "female")]
    ending = F.when(attempt >= IN_FORM_NAMES, _mapped(_more("ba", attempt, IN_FORM_NAMES), F.reverse(seed))).otherwise("")
    given = F.concat(F.when(kind == "male", given[0]).otherwise(given[1]), ending)
    full = F.concat_ws(" ", given, F.array_join(F.slice(family, F.lit(2), F.size(family)), " "))
    name = F.when(F.size(names) > 1, full).otherwise(family[0])
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", drawn)
        .when(kind == "card", card).when(kind.isin(*SECRETS), secret).when(kind.isin("male", "female"), name)
        .when(kind == "family", _family(key, canon, attempt)).otherwise(_mapped(F.concat(canon, _more("b", attempt)), d))
    )


def _with_surrogate(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (kind, canon, attempt, families) with ``new``; digests are a column of their own, made once per row."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    return rows.withColumn("seeds", _seeds(key, kind, canon, attempt)).withColumn("new", _surrogate(kind, canon, attempt, F.col("families"), F.col("seeds"), key)).drop("seeds")


def _in_form(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate with the punctuation, capitals or title of the entity."""
    digits = F.regexp_replace(surrogate, "[^0-9]", "")
    filled = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(
        c.rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))
    ).otherwise(c)), "")
    filled = F.concat(filled, F.substring(digits, F.length(F.regexp_replace(entity, "[^0-9]", "")) + 1, F.length(digits)))
    cased = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(
        F.substring(entity, i + 1, F.lit(1)) == F.lower(F.substring(entity, i + 1, F.lit(1))), c
    ).otherwise(F.upper(c))), "")
    before = F.regexp_extract(entity, BEFORE, 0)
    value = F.substring(entity, F.length(before) + 1, F.length(entity))
    # hexadecimal digits in the case of the secret's letters; of mixed ones each letter as the one in its place
    placed = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substring(value, i + 1, F.lit(1)).rlike("[A-F]"), F.upper(c)).otherwise(c)), "")
    hexed = F.when(value == F.lower(value), surrogate).when(value == F.upper(value), F.upper(surrogate)).otherwise(placed)
    secret = F.concat(before, F.when(kind == "hex_secret", hexed).otherwise(surrogate))
    title = F.concat(F.regexp_extract(entity, r"^[^ ]+ ", 0), surrogate)
    return F.when(_is_number(kind), filled).when(kind == "email", cased).when(kind.isin("male", "female"), title).when(kind.isin(*SECRETS), secret).otherwise(surrogate)


def _words(kind: Column, canon: Column) -> Column:
    """Family names of a name: the words behind the given one, or a single word."""
    names = F.split(canon, " ")
    return F.when(kind.isin("male", "female"), F.when(F.size(names) > 1, F.slice(names, F.lit(2), F.size(names))).otherwise(names))


def _drawn_apart(listed: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, families) of all entities, with attempts whose surrogates do not collide.

    It ends: the surrogates of an extended form grow until all places of a digest count.
    """
    drawn = stored(_with_surrogate(listed.withColumn("attempt", F.lit(0)), key), "drawn")
    originals = listed.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real"))
    while True:
        # the least attempt and canonical form keeps a surrogate that several drew
        firsts = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("drawn"))
        real = firsts.join(originals, ["kind", "new"], "left").where("drawn > 1 OR real").select("kind", "new", "first", F.coalesce("real", F.lit(False)).alias("real"))
        bad = stored(drawn.join(real, ["kind", "new"]).where("real OR canon <> first.canon").select("kind", "canon", "attempt", "families"), "collisions")
        if bad.isEmpty():
            return drawn.select("kind", "canon", "attempt", "families")
        again = _with_surrogate(bad.withColumn("attempt", F.col("attempt") + 1), key)
        drawn = stored(drawn.join(bad, ["kind", "canon"], "left_anti").unionByName(again), "drawn")


def redrawn(listed: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, families) of the entities whose first surrogates collide, with attempts that do not.

    ``families`` holds the attempts of those words of a name that were drawn again.
    """
    nothing = F.lit(None).cast("map<string,int>").alias("families")
    words = listed.select(F.explode(_words(F.col("kind"), F.col("canon"))).alias("canon")).distinct().select(F.lit("family").alias("kind"), "canon", nothing)
    again = stored(_drawn_apart(words, key).where("attempt > 0").select(F.col("canon").alias("word"), F.col("attempt").alias("tried")), "families")
    named = listed.select("kind", "canon", F.explode(F.array_distinct(_words(F.col("kind"), F.col("canon")))).alias("word")).join(again, "word")
    named = named.groupBy("kind", "canon").agg(F.map_from_entries(F.collect_list(F.struct("word", "tried"))).alias("families"))
    return _drawn_apart(listed.join(named, ["kind", "canon"], "left"), key).where("attempt > 0 OR families IS NOT NULL")


def _may_hold(text: Column) -> Column:
    """Whether a text has what every entity has some of; most texts fail this cheap test before the pattern.

    Only access keys, hexadecimal secrets and names can be without a digit and one of @, = and :.
    """
    test = text.rlike("[0-9@=:]|A[KS]IA|[A-Fa-f]{32}")
    for title in TITLES:
        test = test | text.contains(title)
    return test


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and, if asked for, the number of entities in ``count_col``."""
    columns = docs.columns
    with_pii = F.coalesce(_may_hold(F.col(text_col)) & F.col(text_col).rlike(PATTERN), F.lit(False))
    hits = docs.where(with_pii).select(
        F.struct(*[docs[c] for c in columns]).alias("row"), F.monotonically_increasing_id().alias("place"), F.col(text_col).alias("text"),
        F.regexp_extract_all(text_col, F.lit(PATTERN), F.lit(0)).alias("found"),
    )
    hits = stored(hits, "hits")
    listed = hits.select(F.explode("found").alias("entity")).groupBy("entity").count().withColumn("kind", _kind(F.col("entity")))
    forms = stored(listed.select("entity", "kind", _canonical(F.col("kind"), F.col("entity")).alias("canon")), "forms")
    later = stored(redrawn(forms.select("kind", "canon").distinct(), key), "redrawn")
    by_form = later.join(forms, ["kind", "canon"]).select("entity", F.struct("attempt", "families").alias("attempt"))
    attempts = hits.select("place", F.explode("found").alias("entity")).distinct().join(by_form, "entity").groupBy("place").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias("attempts")
    )
    # each step is an array of its own, so nothing is computed again for every character
    known = F.transform("found", lambda e: F.struct(
        e.alias("e"), _kind(e).alias("kind"), F.coalesce(F.element_at(F.col("attempts"), e)["attempt"], F.lit(0)).alias("attempt"),
        F.element_at(F.col("attempts"), e)["families"].alias("families"),
    ))
    formed = F.transform(known, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["attempt"].alias("attempt"), x["families"].alias("families"), _canonical(x["kind"], x["e"]).alias("canon")))
    seeded = F.transform(formed, lambda x: F.struct(
        x["e"].alias("e"), x["kind"].alias("kind"), x["attempt"].alias("attempt"), x["families"].alias("families"), x["canon"].alias("canon"), _seeds(key, x["kind"], x["canon"], x["attempt"]).alias("seeds")
    ))
    drawn = F.transform(seeded, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), _surrogate(x["kind"], x["canon"], x["attempt"], x["families"], x["seeds"], key).alias("new")))
    done = hits.join(attempts, "place", "left").withColumn("new", F.transform(drawn, lambda x: _in_form(x["kind"], x["e"], x["new"])))
    pieces = F.split("text", PATTERN, -1)
    merged = F.array_join(F.zip_with(pieces, "new", lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    changed = done.select(*[(merged if c == text_col else F.col("row")[c]).alias(c) for c in columns], *([F.size("found").cast("long").alias(count_col)] if count_col else []))
    rest = docs.where(~with_pii)
    if count_col:
        rest = rest.select(*columns, F.lit(0).cast("long").alias(count_col))
    return rest.unionByName(changed)
