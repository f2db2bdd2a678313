"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Entities are e-mail addresses, IPv4 addresses, card numbers and phone numbers found by pattern. The
corpus says how strongly a term near an entity reveals it: with document frequencies ``n`` of
``N`` documents, ``PMI(t; e) = log(n(t, e) N / (n(t) n(e)))`` against the entity's own information
``IC(e) = log(N / n(e))``. A term that occurs with the entity in at least ``support`` documents
and whose PMI reaches ``alpha * IC`` discloses it and is generalised, or removed if it occurs with
nothing else (PMI = IC). A term occurs with every entity of its document, wherever it stands, and each
of its occurrences there is a span. ``whole=False`` looks at an entity's surroundings only, as the
query's SQL does.

Scale: counts are map-side combined; positions are running sums over one document's matches. Of the texts
that hold an entity of at least ``support`` documents the distinct terms are exploded, of those that
hold a disclosing term the words; an entity of fewer documents has no pair of ``support``. A term
is paired with the entities of its documents only if the counts of the two alone allow their PMI to
reach ``alpha * IC``, so frequent words meet frequent entities only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import Sealed, pick, stored

# The kinds in their order. Each pattern finds the same matches as its plain form
# (e-mail [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and so on) but starts only where a match
# can start and never gives back, so long runs of letters or digits stay linear. Of the card
# chains, only those of 16 to 19 digits are matched at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}[\p{L}\p{M}\p{N}]+"
REACH = 120  # code points on either side of an entity in which terms are looked for
NEAR = 8  # terms on either side


def luhn(digits: Column) -> Column:
    """Does the string of digits pass the Luhn check?"""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def is_valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (F.when(kind == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
            .when(kind == "card", luhn(digits)).when(kind == "phone", F.length(digits).between(8, 15)).otherwise(F.lit(True)))


def base_spans(docs: DataFrame) -> DataFrame:
    """From (id, digest, text): one row per valid base match: id, digest, kind, start, end (code
    points, end exclusive), match, left, right, m (rows of this id and text)."""
    hits = None
    for kind in PATTERNS:
        found = F.regexp_extract_all(F.col("text"), F.lit(PATTERNS[kind]), F.lit(0))
        some = docs.where(F.contains(F.col("text"), F.lit(NEEDS[kind]))) if kind in NEEDS else docs
        one = some.select("id", "digest", "text", found.alias("found")).where(F.size("found") > 0)
        one = one.select("id", "digest", "found", F.split("text", PATTERNS[kind], -1).alias("around"))
        one = one.select("id", "digest", F.lit(kind).alias("kind"), F.posexplode(F.arrays_zip(
            "found", F.slice("around", F.lit(1), F.size("found")).alias("before"),
            F.slice("around", F.lit(2), F.size("found")).alias("after"))).alias("i", "m"))
        one = one.select("id", "digest", "kind", "i", F.col("m.found").alias("match"), F.length("m.before").alias("gap"),
                         F.right(F.col("m.before"), F.lit(REACH)).alias("left"), F.left(F.col("m.after"), F.lit(REACH)).alias("right"))
        hits = one if hits is None else hits.unionByName(one)
    # repeated rows become one that says how often it stands
    hits = hits.groupBy(*hits.columns).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("id", "digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(w)).withColumn("start", F.col("end") - F.length("match"))
    return hits.where(is_valid(F.col("kind"), F.col("match"))).select("id", "digest", "kind", "start", "end", "match", "left", "right", "m")


def entity_of(kind: Column, match: Column) -> Column:
    value = F.when(kind.isin("card", "phone"), F.regexp_replace(match, "[^0-9]", "")).otherwise(F.lower(match))
    return F.concat_ws(":", kind, value)


def near_terms(spans: DataFrame) -> DataFrame:
    """(id, digest, entity, ic kind, term, start, end): the nearest terms on either side of a span."""
    def words(side: str):
        ctx = F.col(side)
        s = spans.select("id", "digest", "m", "kind", "match", "start", "end", ctx.alias("ctx"),
                         F.regexp_extract_all(ctx, F.lit(TERM), F.lit(0)).alias("w"), F.split(ctx, TERM, -1).alias("g"))
        s = s.select("*", F.posexplode("w").alias("i", "word"))
        before = F.aggregate(F.slice("g", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + \
            F.aggregate(F.slice("w", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
        s = s.withColumn("at", before).withColumn("n", F.size("w"))
        cut = F.length("ctx") >= REACH  # a word at the far edge may be cut
        if side == "left":
            s = s.where((F.col("i") >= F.col("n") - NEAR) & ~(cut & (F.col("at") == 0)))
            origin = F.col("start") - F.length("ctx")
        else:
            s = s.where((F.col("i") < NEAR) & ~(cut & (F.col("at") + F.length("word") >= REACH)))
            origin = F.col("end")
        return s.select("id", "digest", "m", entity_of(F.col("kind"), F.col("match")).alias("entity"), F.lower("word").alias("term"),
                        (origin + F.col("at")).alias("start"), (origin + F.col("at") + F.length("word")).alias("end"))
    return words("left").unionByName(words("right")).distinct()


def terms_of(text: Column) -> Column:
    """Distinct lower-cased terms of a whole text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def reaches(n_et: Column, total: float, alpha: float) -> Column:
    """Does the PMI of ``n_et`` with n_e and n_t reach ``alpha`` of the entity's information?"""
    n_et, n_e, n_t = (c.cast("double") for c in (n_et, F.col("n_e"), F.col("n_t")))
    pmi, ic = F.log(n_et * total / (n_t * n_e)), F.log(total / n_e)
    return (ic > 0) & (pmi >= alpha * ic)


def reaching(scored: DataFrame, total: float, alpha: float) -> DataFrame:
    """(entity, term, removed) of the counted pairs (n_et, n_e, n_t) that reach ``alpha``."""
    return (scored.where(reaches(F.col("n_et"), total, alpha))
            .select("entity", "term", (F.col("n_t") <= F.col("n_et")).alias("removed")))


def disclosing(docs: DataFrame, near: DataFrame, alpha: float, support: int) -> DataFrame:
    """(entity, term, removed): terms whose PMI with the entity reaches ``alpha`` of its information. All four
    numbers count rows, repeated ones as often as they stand."""
    pairs = near.select("id", "digest", "m", "entity", "term").distinct().groupBy("entity", "term").agg(F.sum("m").alias("n_et"))
    entities = near.select("id", "digest", "m", "entity").distinct().groupBy("entity").agg(F.sum("m").alias("n_e"))
    pairs = pairs.where(F.col("n_et") >= support)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return reaching(pairs.join(entities, "entity").join(terms, "term"), float(docs.count()), alpha)


def _same_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by (id, digest); null ids are equal."""
    r = right.withColumnRenamed("id", "_id").withColumnRenamed("digest", "_digest")
    return left.join(r, _match_key(left, r), how).drop("_id", "_digest")


def whole_terms(docs: DataFrame, base: DataFrame, alpha: float, support: int) -> DataFrame:
    """(id, digest, start, end, removed): every occurrence of a disclosing term in the documents that
    hold its entity; both are counted over whole documents."""
    held = base.select("id", "digest", "m", entity_of(F.col("kind"), F.col("match")).alias("entity")).distinct()
    entities = held.groupBy("entity").agg(F.sum("m").alias("n_e")).where(F.col("n_e") >= support)
    held = stored(held.join(entities, "entity").select("id", "digest", "m", "entity", "n_e"), "pii-held")
    some = _same_document(docs, held.select("id", "digest").distinct(), "left_semi")
    # repeated rows are looked at once and counted ``m`` times
    some = stored(some.groupBy("id", "digest").agg(F.first("text").alias("text")), "pii-texts")
    total = float(docs.count())
    terms = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    terms = some.select("id", "digest", F.explode(terms_of(F.col("text"))).alias("term")).join(terms.where(F.col("n_t") >= support), "term")
    # n_et is at most n_e and n_t: what these do not allow to reach alpha is no pair
    pairs = (_same_document(terms, held).where(reaches(F.least("n_e", "n_t"), total, alpha))
             .groupBy("entity", "term", "n_e", "n_t").agg(F.sum("m").alias("n_et")).where(F.col("n_et") >= support))
    told = stored(reaching(pairs, total, alpha), "pii-told")
    told = held.join(told, "entity").groupBy("id", "digest", "term").agg(F.max("removed").alias("removed"))
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    places = (_same_document(some, told.select("id", "digest").distinct(), "left_semi")
              .select("id", "digest", words.alias("w"), F.split("text", TERM, -1).alias("g"))
              .select("id", "digest", F.posexplode(F.arrays_zip("w", F.slice("g", F.lit(1), F.size("w")).alias("gap"))).alias("i", "x"))
              .select("id", "digest", "i", F.lower("x.w").alias("term"), F.length("x.w").alias("n"), F.length("x.gap").alias("gap")))
    w = Window.partitionBy("id", "digest").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    places = places.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(w)).withColumn("start", F.col("end") - F.col("n"))
    t = told.withColumnRenamed("id", "_id").withColumnRenamed("digest", "_digest").withColumnRenamed("term", "_term")
    return (places.join(t, _match_key(places, t) & (places["term"] == t["_term"]))
            .select("id", "digest", "start", "end", "removed"))


def all_spans(docs: DataFrame, alpha: float = 0.9, support: int = 3, whole: bool = True) -> DataFrame:
    """From (id, digest, text): id, digest, kind, start, end, removed. Terms never overlap base spans; they are
    looked for in whole texts or, without ``whole``, near entities only."""
    base = stored(base_spans(docs), "pii-base")
    if whole:
        terms = whole_terms(docs, base, alpha, support).withColumn("kind", F.lit("term"))
    else:
        near = stored(near_terms(base), "pii-near")
        terms = (near.join(disclosing(docs, near, alpha, support), ["entity", "term"]).groupBy("id", "digest", "start", "end")
                 .agg(F.max("removed").alias("removed")).withColumn("kind", F.lit("term")))
    both = (base.select("id", "digest", "kind", "start", "end", F.lit(False).alias("removed"))
            .unionByName(terms.select("id", "digest", "kind", "start", "end", "removed")))
    # running values from either end: a frame up to the last row would be summed anew for every row
    entity, w = F.col("kind") != "term", Window.partitionBy("id", "digest")
    forth, back = w.orderBy("start", "end", "kind"), w.orderBy(F.desc("start"), F.desc("end"), F.desc("kind"))
    last_end = F.max(F.when(entity, F.col("end"))).over(forth.rowsBetween(Window.unboundedPreceding, 0))
    next_start = F.min(F.when(entity, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return (both.withColumn("_e", last_end).withColumn("_s", next_start)
            .where(entity | ~(F.coalesce(F.col("_e") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_s") < F.col("end"), F.lit(False))))
            .drop("_e", "_s"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pick(docs, id=id_col, text=text_col).select("id", F.xxhash64(text).alias("digest"), text.alias("text"))


def _match_key(left: DataFrame, right: DataFrame):
    return left["id"].eqNullSafe(right["_id"]) & (left["digest"] == right["_digest"])


def find(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end by kind, then
    start, comma-joined; base ones only, and all). Terms are looked for in whole texts.

    Null and empty texts have no spans. Rows are told apart by (id, hash of the text): repeated rows
    count as often as they stand, in every number, and get equal results; a null id is an id like
    any other; no rows give no rows; other columns play no part."""
    d = keyed(docs, id_col, text_col)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("k")
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "start", "end", "kind"))),
                         lambda s: F.struct(s["k"].alias("k"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("s")))
    found = (all_spans(d, **options).groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
             .agg(listed.alias("s"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in PATTERNS]))
    j = d.select("id", "digest").join(found, _match_key(d, found), "left")
    spans = F.coalesce("s", F.array().cast("array<struct<k:bigint,s:string>>"))
    base = F.filter(spans, lambda s: s["k"] <= len(PATTERNS))
    return j.select(F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in PATTERNS],
                    F.sha2(F.array_join(base["s"], ","), 256).alias("base_sha256"), F.array_join(spans["s"], ",").alias("spans"))


def sanitise(docs: DataFrame, id_col="doc_id", text_col="text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets, disclosing terms generalised to
    ``[TERM]`` or removed, wherever in the text they stand. Base spans that overlap are replaced as one, by the first one's kind.
    ``chars_col``, if there, is brought up to date. Null texts stay null, empty ones empty; repeated rows count as
    often as they stand and are masked alike; null ids are ids; no rows give no rows; other columns stay."""
    d = keyed(docs, id_col, text_col)
    spans = all_spans(d, **options)
    w = Window.partitionBy("id", "digest").orderBy("start", F.col("end").desc(), "kind")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.coalesce(F.col("start") < reached, F.lit(False)), 0).otherwise(1))
    spans = spans.withColumn("g", F.sum("new").over(w)).groupBy("id", "digest", "g").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", "start").alias("kind"), F.max("removed").alias("removed"))
    mark = F.when(F.col("removed"), F.lit("")).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    by_doc = spans.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", mark.alias("mark")))).alias("_spans"))
    sealed = Sealed(docs)
    text = F.col(sealed.column(text_col))
    t = sealed.df.withColumn("_key", F.xxhash64(F.coalesce(text, F.lit(""))))
    j = t.join(by_doc, F.col(sealed.column(id_col)).eqNullSafe(by_doc["_id"]) & (t["_key"] == by_doc["_digest"]), "left")
    chars, s = F.split(text, ""), F.col("_spans")
    piece = F.transform(s, lambda x, i: F.concat(
        F.array_join(F.slice(F.col("_chars"), F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(F.lit(0)).cast("int") + 1,
                             (x["start"] - F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(F.lit(0))).cast("int")), ""), x["mark"]))
    tail = F.array_join(F.slice(F.col("_chars"), F.element_at(s, -1)["end"].cast("int") + 1, F.size("_chars")), "")
    j = j.withColumn("_chars", F.when(s.isNotNull(), chars))
    out = j.withColumn(sealed.column(text_col), F.when(s.isNull(), text).otherwise(F.concat(F.array_join(piece, ""), tail)))
    if chars_col and chars_col in docs.columns:
        c = sealed.column(chars_col)
        out = out.withColumn(c, F.when(s.isNull(), F.col(c)).otherwise(F.length(text).cast(sealed.df.schema[c].dataType)))
    return sealed.open(out)
