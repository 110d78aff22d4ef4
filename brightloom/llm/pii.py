"""Personal data: patterns, and the words that give a protected entity away.

Taking out an address does little if a rare name beside it points to the same person. How
much a word reveals is estimated from the corpus: the pointwise mutual information of word
and entity, against the information of the entity itself. A word that (nearly) always stands
with one entity reveals (nearly) all of it, and is generalised or removed wherever it stands in
the documents that hold the entity. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.batches import stored
from brightloom.llm.spans import overlaps, with_matches, with_replaced, written

# The patterns of the kinds. Possessive forms and the looks back only keep long
# runs linear; they match what the plain forms match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}]+"
KINDS = ("email", "ip", "card", "phone", "term")


@dataclass(frozen=True)
class Disclosure:
    """reach: code points on either side of an entity in which the two words that make up its surroundings are
    looked for. contexts: distinct surroundings of the entity, in documents that hold the word as well. A word whose
    share of the entity's information reaches `generalise` is replaced by its class, at `remove` it is taken out.
    """

    reach: int = 80
    contexts: int = 2
    generalise: float = 0.90
    remove: float = 0.98


def content_key(text_column: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    each = F.transform(F.split(F.reverse(number), ""), worth)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def scan(docs: DataFrame, rule: Disclosure, id_column: str, text_column: str) -> DataFrame:
    """One row for each document: pattern spans by kind and start, and the surroundings of each."""
    found = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), content_key(text_column).alias("key"), F.col(f"`{text_column}`").alias("text"))
    for name, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        found = with_matches(found, name, "text", pattern)
    small = lambda part: F.coalesce(part.try_cast("bigint"), F.lit(256)) <= 255
    found = found.withColumns(
        {
            "ip": F.filter("ip", lambda s: F.forall(F.split(s["value"], r"\."), small)),
            "card": F.filter("card", lambda s: F.when(F.length(digits(s["value"])).between(13, 19), luhn(digits(s["value"]))).otherwise(False)),
            "phone": F.filter("phone", lambda s: F.length(digits(s["value"])).between(9, 15)),
        }
    )

    def tagged(name: str) -> Column:
        plain = (lambda v: F.lower(v)) if name in ("email", "ip") else digits

        def one(s: Column) -> Column:
            offset = F.greatest(F.lit(0), s["start"] - rule.reach)
            return F.struct(
                F.lit(KINDS.index(name)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(name).alias("kind"),
                F.unhex(F.md5(F.concat_ws(":", F.lit(name), plain(s["value"])))).alias("entity"), offset.alias("offset"),
                F.substring(F.col("text"), (offset + 1).cast("int"), (s["end"] + rule.reach - offset).cast("int")).alias("around"),
            )

        return F.transform(name, one)

    found = found.select("doc_id", "row", "key", "text", F.concat(*map(tagged, KINDS[:4])).alias("base"))
    bare = F.array_sort(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(" ").alias("label"))))
    return with_replaced(found.withColumn("_bare", bare), "bare", "text", "_bare").drop("_bare")


def surroundings(scanned: DataFrame) -> DataFrame:
    """(row, entity, contexts): each entity of a document, with hashes of the two words on either side of its places."""
    each = scanned.select("row", F.explode("base").alias("m")).select("row", "m.entity", "m.start", "m.end", "m.offset", "m.around")
    each = with_matches(each, "words", "around", WORD)
    here = lambda w: F.struct(F.lower(w["value"]).alias("term"), (w["start"] + F.col("offset")).alias("start"), (w["end"] + F.col("offset")).alias("end"))
    whole = lambda w: ((w["start"] > 0) | (F.col("offset") == 0)) & (w["end"] < F.length("around"))
    each = each.withColumn("words", F.transform(F.filter("words", whole), here))
    before = F.slice(F.reverse(F.filter("words", lambda w: w["end"] <= F.col("start"))), 1, 2)
    after = F.slice(F.filter("words", lambda w: w["start"] >= F.col("end")), 1, 2)
    each = each.withColumn("context", F.xxhash64(F.transform(F.concat(before, after), lambda w: w["term"])))
    return each.groupBy("row", "entity").agg(F.collect_set("context").alias("contexts"))


def several_contexts(rule: Disclosure) -> Column:
    """Whether the arrays `contexts` of a group hold `rule.contexts` different values."""
    if rule.contexts <= 2:
        return F.lit(True) if rule.contexts < 2 else F.min(F.array_min("contexts")) < F.max(F.array_max("contexts"))
    return F.size(F.array_distinct(F.flatten(F.collect_set("contexts")))) >= rule.contexts


def bare_terms() -> Column:
    """The different words of a text outside its entities."""
    return F.array_distinct(F.regexp_extract_all(F.lower("bare"), F.lit(WORD), F.lit(0)))


def disclosing(scanned: DataFrame, near: DataFrame, counts: DataFrame, total: float, rule: Disclosure) -> DataFrame:
    """(entity, term, share) of the words that reveal an entity, from counts over whole documents.

    share: pointwise mutual information over the information of the entity,
    log(n(e,t) N / (n(e) n(t))) / log(N / n(e)), with n in documents, whose words are those outside
    entities. As n(e,t) is n(e) at most, a word in more than N^(1-g) n(e)^g documents cannot reach a
    share of g; such pairs are left out before the join by document. All counts combine before
    their shuffles, so a hot entity or word is no task of its own.
    """
    # An entity with fewer surroundings in all has fewer with any word: the entries of a list go here.
    entity = near.groupBy("entity").agg(F.count(F.lit(1)).alias("holders"), several_contexts(rule).alias("several")).filter("several").drop("several")
    held = stored(near.join(entity, "entity").withColumn("most", F.pow(F.lit(total), 1 - rule.generalise) * F.pow("holders", F.lit(rule.generalise)) + 1e-6))
    rows = held.groupBy("row").agg(F.max("most").alias("_most"))
    words = scanned.join(rows, "row").select("row", "_most", F.explode(bare_terms()).alias("term"))
    words = words.join(counts, "term").filter(F.col("users") <= F.col("_most")).drop("_most")
    pairs = held.join(words, "row").filter(F.col("users") <= F.col("most"))
    met = pairs.groupBy("entity", "term", "holders", "users").agg(F.count(F.lit(1)).alias("together"), several_contexts(rule).alias("several"))
    gained = F.log(F.col("together") * total / (F.col("holders") * F.col("users")))
    share = F.when(F.col("holders") < total, gained / F.log(F.lit(total) / F.col("holders"))).otherwise(0.0)
    return met.filter("several").select("entity", "term", share.alias("share")).filter(F.col("share") >= rule.generalise)


SPANS = "array<struct<rank:int,start:bigint,end:bigint,kind:string,label:string>>"


def find_personal_data(docs: DataFrame, rule: Disclosure = Disclosure(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key, spans) of every whole text; `key` is a hash of the text.

    spans, by kind and start: rank, start, end, kind, and the label that takes the span's place.
    Kinds are `email`, `ip`, `card`, `phone` and `term`, a word that reveals an entity of the same text.
    A null text has no spans; null ids pass through; each of several equal rows gets the same
    spans (as documents they count once each, as surroundings once together); no rows give no rows.
    """
    found = scan(docs, rule, id_column, text_column)
    # Texts are scanned once more to count their words, so that only those that hold an entity are written.
    counts = stored(found.select(F.explode(bare_terms()).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("users")))
    held = lambda name: F.when(F.size("base") > 0, F.col(name)).alias(name)
    scanned = stored(found.select("doc_id", "row", "key", "base", held("text"), held("bare")))
    near = stored(surroundings(scanned))
    shown = stored(disclosing(scanned, near, counts, float(max(scanned.count(), 1)), rule))
    label = lambda share, value: (
        F.when(share >= rule.remove, F.lit(""))
        .when(value.rlike("[0-9]"), F.lit("[NUMBER]"))
        .when(value.rlike(r"^\p{Lu}"), F.lit("[NAME]"))
        .otherwise(F.lit("[WORD]"))
    )
    shares = near.join(shown, "entity").groupBy("row", "term").agg(F.max("share").alias("share"))
    shares = shares.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    texts = with_matches(scanned.select("row", "text").join(shares, "row"), "words", "text", WORD)
    share = lambda w: F.try_element_at("shares", F.lower(w["value"]))
    term = lambda w: F.struct(
        F.lit(4).alias("rank"), w["start"].alias("start"), w["end"].alias("end"), F.lit("term").alias("kind"), label(share(w), w["value"]).alias("label")
    )
    terms = texts.select("row", F.transform(F.filter("words", lambda w: share(w).isNotNull()), term).alias("terms"))
    base = F.transform(
        "base", lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label"))
    )
    apart = F.filter(F.col("terms").cast(SPANS), lambda t: ~overlaps(t["start"], t["end"], F.col("base")))
    spans = F.sort_array(F.concat(base.cast(SPANS), F.coalesce(apart, F.array().cast(SPANS))))
    return scanned.join(terms, "row", "left").select("doc_id", "key", spans.alias("spans"))


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The same columns, with every span in the text replaced by its label; `n_chars`, if there, is counted anew.

    Spans are found once for each different text, and equal texts are replaced alike. Null texts stay
    null, empty ones empty; repeated rows stay; columns may have any names; no rows give no rows.
    """
    found = find_personal_data(docs, rule, id_column, text_column).filter(F.size("spans") > 0)
    found = stored(found.groupBy("key").agg(F.first("spans").alias("spans")))
    by_text = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["label"].alias("label")))
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, content_key(text_column).alias("key"), F.col(f"`{text_column}`").alias("text"))
    joined = keyed.join(found.select("key", by_text.alias("spans")), "key", "left")
    joined = joined.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,back:bigint,end:bigint,label:string>>")))
    out = with_replaced(joined, "clean", "text", "spans")

    def column(name: str) -> Column:
        if name == text_column:
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.length("clean").cast(docs.schema[name].dataType).alias(name)
        return F.col("row")[name].alias(name)

    return out.select(*map(column, docs.columns))


def personal_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the pattern spans, and all spans written out."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(written(F.filter(spans, lambda s: s["rank"] < 4)), 256).alias("base_sha256"), written(spans).alias("spans")
    )
