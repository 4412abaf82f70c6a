"""Personal data: pattern spans, and terms that give protected values away.

Patterns find e-mail and IP addresses, card and phone numbers in whole texts,
and credentials: long runs of letters and digits with many different characters.
Protected entities are the values found and what they generalise to, a ladder of
value, class (an address's domain or network, a number's prefix) and kind. How
strongly a term reveals one is estimated from the corpus: with N documents, n(t)
of them holding term t, n(e) holding entity e, and n(e,t) holding both, wherever
they stand, the disclosure is PMI(e;t) / IC(e) = 1 - ln(n(t)/n(e,t)) / ln(N/n(e)):
0 for a term spread evenly, 1 for one found only in documents with e. A term that
reaches ``DISCLOSURE`` for an entity, in at least ``SUPPORT`` different texts with
it and more often than chance allows, is a span wherever it occurs, in documents
without the entity too. Chance: were the term independent of the entity, the
probability of so many common documents is at most exp(-n(t) KL(n(e,t)/n(t) ||
n(e)/N)); this, times all pairs of a term and an entity that are tried, must stay
under ``CHANCE``, so the bar rises with the vocabulary. Copies of a text count
once as evidence. Terms that
give a single value away with certainty are removed; others are generalised to
the kind that they disclose most.

DataFrame functions only. Equal texts with values are counted once with their
number. What is broadcast is counted first; beyond ``SMALL`` rows it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key128, matches, stored

KINDS = ("email", "ip", "card", "phone")
#: The given patterns. Possessive quantifiers and the looks behind change no
#: match: they keep long runs from being tried again from each of their
#: characters, which would take the square of their length.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Credentials: a run of this pattern with a letter, a digit and so many different characters.
CODE, CODE_CHARACTERS = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", 8
DISCLOSURE, SUPPORT = 0.85, 3
#: Expected number of terms that a corpus of independent words gives.
CHANCE = 0.01
#: Rows of terms that are broadcast at most.
SMALL = 100_000
TERM = r"\p{L}[\p{L}\p{N}]{2,}"
#: Stands for a letter or digit of a value, and terms with what runs into a value: a
#: term inside a value's span is that value's part, not a term.
_MARK = "\uffff"
_OUTSIDE = rf"\p{{L}}[\p{{L}}\p{{N}}{_MARK}]{{2,}}"
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _luhn(match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The matches of the kind's pattern that pass its check."""
    spans = F.filter(matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    hint = text.rlike(HINTS[kind])
    return F.when(hint, spans).otherwise(F.array().cast(_SPAN))


def _code_spans(text: Column) -> Column:
    varied = lambda x: F.size(F.array_distinct(F.split(x, ""))) >= CODE_CHARACTERS
    spans = F.filter(matches(text, CODE), lambda s: s["value"].rlike("[A-Za-z]") & s["value"].rlike("[0-9]") & varied(s["value"]))
    return F.when(text.rlike(CODE), spans).otherwise(F.array().cast(_SPAN))


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with columns c0, c1, ... so that none clashes with those made
    here, and which of them is the text."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), f"c{docs.columns.index('text')}"


def with_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with a column of spans for each kind and for credentials."""
    own = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({k: base_spans(own, k) for k in KINDS} | {"code": _code_spans(own)})


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def base_string() -> Column:
    return F.array_join(F.concat(*(_joined(k, F.col(k)) for k in KINDS)), ",")


def _class_of(kind: str, value: Column) -> Column:
    """What a value generalises to: the domain, the first two parts of an
    address, the issuer's six digits, the first group of a phone number."""
    if kind == "email":
        return F.substring_index(value, "@", -1)
    if kind == "ip":
        return F.substring_index(value, ".", 2)
    if kind == "card":
        return F.left(F.regexp_replace(value, "[^0-9]", ""), F.lit(6))
    return F.regexp_extract(value, r"^\+[0-9]+[\x20().-]*[0-9]*", 0)


def _entities(kind: str) -> Column:
    """(level, name) of the entities of a kind: 2 for values, 1 for classes, 0 for kinds."""
    entity = lambda level, name: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"), name.alias("name"))
    found = F.col(kind)
    parts = [F.transform(found, lambda s: entity(2, s["value"])), F.when(F.size(found) > 0, F.array(entity(0, F.lit("")))).otherwise(F.filter(F.array(entity(0, F.lit(""))), lambda _: F.lit(False)))]
    if kind != "code":
        parts.append(F.transform(found, lambda s: entity(1, _class_of(kind, s["value"]))))
    return F.concat(*parts)


def _masked(text: str) -> Column:
    """The text with the letters and digits of its values as ``_MARK``; places stay."""
    own = F.translate(F.col(text), _MARK, " ")
    spans = F.array_sort(F.concat(*map(F.col, (*KINDS, "code"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substr(own, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        value = F.substr(F.regexp_replace(s["value"], r"[\p{L}\p{N}]", _MARK), F.greatest(a["at"] - s["start"], F.lit(0)) + 1)
        return F.when(s["end"] > a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(between, value)).alias("out"))).otherwise(a)

    new = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(own, a["at"] + 1)))
    return F.when(F.size(spans) > 0, new).otherwise(own)


def _terms(text: Column, pattern: str = TERM) -> Column:
    """The distinct terms of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _evidence(total: int) -> Column:
    """How much more often than by chance term and entity stand together: minus
    the log of what bounds its probability, from n_t, n_et, n_e and the number
    of different texts with both."""
    p, q = F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0)), F.col("n_e") / F.lit(float(total))
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    return F.when(q < 1, F.col("texts") / p * (p * F.log(p / q) + rest)).otherwise(0.0)


def disclosing(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, chance: float = CHANCE) -> DataFrame:
    """(term, kind, sure): the terms that disclose an entity, with the kind of
    the one disclosed most. ``sure`` marks those found in no document but a
    value's."""
    rows, text = _plain(docs.select("text"))
    spanned = with_spans(rows.where(F.col(text).isNotNull()), text)
    kinds = (*KINDS, "code")
    held = spanned.where(F.size(F.concat(*map(F.col, kinds))) > 0)
    outside = F.filter(_terms(_masked(text), _OUTSIDE), lambda x: ~F.contains(x, F.lit(_MARK)))
    held = held.select(key128(text).alias("key"), F.array_distinct(F.concat(*map(_entities, kinds))).alias("entities"), outside.alias("terms"))
    # Copies of a text are one row with their number.
    held = stored(held.groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms")))

    # Entities and terms of fewer texts than ``support`` can't reach it.
    own = held.select("key", "copies", F.explode("entities").alias("entity"))
    counts = own.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count("*").alias("texts"))
    entities = stored(counts.where(F.col("texts") >= support).select("entity", "n_e"))
    pairs = own.join(entities, "entity").select("key", "copies", "entity").join(held.select("key", "terms"), "key")
    pairs = pairs.select("entity", F.explode("terms").alias("term"), "copies").groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts"))
    pairs = stored(pairs.where(F.col("texts") >= support))
    found = stored(pairs.select("term").distinct())
    total = docs.count()
    tried = max(1, entities.count() * held.select(F.explode("terms").alias("term")).distinct().count())
    every = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    if found.count() <= SMALL:
        every, found = every.join(F.broadcast(found), "term", "left_semi"), None
    n_t = every.groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = n_t if found is None else n_t.join(found, "term", "left_semi")
    score = F.when(F.lit(total) > F.col("n_e"), 1 - F.log(F.col("n_t") / F.col("n_et")) / F.log(F.lit(total) / F.col("n_e"))).otherwise(0.0)
    risk = pairs.join(n_t, "term").join(entities, "entity").withColumn("score", score)
    risk = risk.where((F.col("score") >= disclosure) & (_evidence(total) >= math.log(tried / chance)))
    best = F.max(F.struct("score", F.col("entity.level").alias("level"), F.col("entity.kind").alias("kind")))["kind"]
    return risk.groupBy("term").agg(best.alias("kind"), F.max((F.col("entity.level") == 2) & (F.col("n_t") == F.col("n_et"))).alias("sure"))


def hits(docs: DataFrame, **limits: float) -> DataFrame:
    """(key, terms): for each text, with a value or without, the disclosing terms
    (term, kind, sure) that it holds. Texts without such terms have no row."""
    risk = stored(disclosing(docs, **limits))
    texts = docs.select(key128("text").alias("key"), F.explode(_terms(F.col("text"))).alias("term"))
    held = texts.join(F.broadcast(risk) if risk.count() <= SMALL else risk, "term").groupBy("key")
    return held.agg(F.collect_set(F.struct("term", "kind", "sure")).alias("terms"))


def _with_all_spans(docs: DataFrame, text: str, **limits: float) -> DataFrame:
    """``docs`` with base spans, ``code`` and ``terms``: the spans (start, end,
    value, kind, sure) of all occurrences of disclosing terms."""
    kind = "array<struct<start:int,end:int,value:string,kind:string,sure:boolean>>"
    held = stored(hits(docs.select(F.col(text).alias("text")), **limits))
    few = held.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] <= SMALL
    entry = F.transform("terms", lambda t: F.struct(t["term"].alias("key"), F.struct(t["kind"].alias("kind"), t["sure"].alias("sure")).alias("value")))
    held = held.select("key", F.map_from_entries(entry).alias("hits"))
    found = docs.withColumn("key", key128(text)).join(F.broadcast(held) if few else held.hint("merge"), "key", "left").drop("key")
    found = with_spans(found, text)
    hit = lambda s: F.element_at("hits", F.lower(s["value"]))
    words = F.filter(matches(_masked(text), _OUTSIDE), lambda s: hit(s).isNotNull())
    spans = F.transform(words, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), hit(s)["kind"].alias("kind"), hit(s)["sure"].alias("sure")))
    return found.withColumn("terms", F.when(F.col("hits").isNotNull(), spans).otherwise(F.array().cast(kind))).drop("hits")


def find(docs: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_codes,
    n_terms, protected): ``protected`` says whether the text holds any value.

    A null text is an empty one and has no spans. Repeated rows have equal
    spans; each counts as a document. An empty table gives an empty result.
    Columns other than doc_id and text are not read.
    """
    rows, text = _plain(docs.select("doc_id", "text"))
    done = _with_all_spans(rows, text, **limits)
    base = base_string()
    more = F.array_join(F.concat(_joined("code", F.col("code")), _joined("term", F.col("terms"))), ",")
    return done.select(
        F.col("c0").alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(base, 256).alias("base_sha256"),
        F.when(more == "", base).otherwise(F.concat_ws(",", base, more)).alias("spans"),
        F.size("code").cast("long").alias("n_codes"),
        F.size("terms").cast("long").alias("n_terms"),
        (F.size(F.concat(*map(F.col, (*KINDS, "code")))) > 0).alias("protected"),
    )


def _tagged(kind: str) -> Column:
    tag = F.lit(f"<{kind}>")
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag.alias("by")))


def sanitised(docs: DataFrame, **limits: float) -> DataFrame:
    """``docs`` with each span of its text replaced: values by their kind in
    angle brackets, disclosing terms by the kind they disclose, as in
    <email term>, or by nothing where they give a single value away with
    certainty. Overlapping spans are replaced as one, by the kind that begins
    first. Columns and rows stay, whatever the names; null texts stay null."""
    rows, text = _plain(docs)
    done = _with_all_spans(rows, text, **limits)
    tagged = [_tagged(k) for k in (*KINDS, "code")]
    by = lambda s: F.when(s["sure"], "").otherwise(F.concat(F.lit("<"), s["kind"], F.lit(" term>")))
    tagged.append(F.transform(F.col("terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.array(F.substr(text, a["at"] + 1, s["start"] - a["at"]), s["by"])
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], kept).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        )

    done = done.withColumn("all", F.array_sort(F.concat(*tagged)))
    new = F.aggregate("all", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    done = done.withColumn(text, F.when(F.size("all") > 0, new).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        done = done.withColumn(f"c{docs.columns.index('n_chars')}", F.length(text).cast("long"))
    return done.select(*rows.columns).toDF(*docs.columns)
