"""Text functions: tags, tokens, labels, content types, dates and model replies."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    BRACKETED,
    CONTENT_TYPES,
    DATE_AHEAD,
    DATE_NAMED,
    DATE_NUMBERS,
    ECHO,
    FENCE,
    FILLER_WORDS,
    IN_A_MONTH,
    IN_A_WEEK,
    IN_TWO_DAYS,
    INSERTED,
    MONTH_DAYS,
    MONTH_END,
    MONTH_MIDDLE,
    MONTHS,
    OVERLAP_STOPWORDS,
    QUERY_STOPWORDS,
    RESPONSE,
    SENTENCE_END,
    TODAY,
    TOMORROW,
    WEEKDAYS,
)


def strip_tags(text: Column) -> Column:
    """Without [MEMORY]…[/MEMORY] echoes, trimmed."""
    return F.trim(F.regexp_replace(text, ECHO, ""))


def words(text: Column) -> Column:
    """Parts between white space; none for a blank text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def query_tokens(text: Column, stopwords: tuple[str, ...] = QUERY_STOPWORDS) -> Column:
    """Distinct lower-case words of four and more characters, without stopwords."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stopwords)))


def overlap_tokens(text: Column, stopwords: tuple[str, ...] = OVERLAP_STOPWORDS) -> Column:
    return F.array_except(F.array_distinct(words(F.lower(text))), F.array(*map(F.lit, stopwords)))


def overlap(a: Column, b: Column) -> Column:
    """Common tokens as a share of the larger set; 0 if either is empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / larger)


def contains_any(lowered: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(lowered, F.lit(p))
    return out


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    """Those of the lower-case phrases that the text holds, whatever its case, as an
    array. The text is lower-cased once, not once a phrase."""
    listed = F.array(*map(F.lit, phrases)).cast("array<string>")
    return F.transform(F.array(F.lower(text)), lambda t: F.filter(listed, lambda p: F.contains(t, p)))[0]


def estimated_tokens(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.floor(F.length(text) / 4) + 1).cast("int")


def relative_age(ts: Column, as_of: Column) -> Column:
    """A label of how long ago ``ts`` was; empty if it is null."""
    s = F.timestamp_diff("SECOND", ts, as_of)
    days, rest = F.floor(s / 86400), F.pmod(s, F.lit(86400))
    label = lambda n, unit: F.concat(F.lit("["), n.cast("string"), F.lit(f" {unit} temu] "))
    return (
        F.when(ts.isNull(), "")
        .when(days > 30, label(F.floor(days / 30), "mies."))
        .when(days > 0, label(days, "dni"))
        .when(rest > 3600, label(F.floor(rest / 3600), "godz."))
        .when(rest > 300, label(F.floor(rest / 60), "min"))
        .otherwise("[przed chwilą] ")
    )


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often it is read."""
    return F.transform(F.array(value), body)[0]


def _hits(lowered: Column, kind: str) -> Column:
    return sum((lowered.rlike(p).cast("int") for p in CONTENT_TYPES[kind][2]), F.lit(0))


def content_type(text: Column) -> Column:
    """The first type of which the text has a pattern."""

    def first(t: Column) -> Column:
        out = F.lit("GENERAL")
        for kind, (_, _, patterns) in reversed(CONTENT_TYPES.items()):
            out = F.when(functools.reduce(operator.or_, (t.rlike(p) for p in patterns)), kind).otherwise(out)
        return out

    return once(F.lower(text), first)


def content_density(text: Column) -> Column:
    """How dense the text's first type is in it, from its number of patterns."""

    def or_else(n: Column, least: float, other: Column) -> Column:
        return once(n, lambda n: F.when(n > 0, F.least(F.lit(1.0), F.lit(least) + n * F.lit(0.1))).otherwise(other))

    def dense(t: Column) -> Column:
        out = F.lit(0.3)
        for kind, (_, least, _) in reversed(CONTENT_TYPES.items()):
            out = or_else(_hits(t, kind), least, out)
        return out

    return F.round(once(F.lower(text), dense), 6)


def type_priority(kind: Column) -> Column:
    out = F.lit(3)
    for name, (priority, _, _) in CONTENT_TYPES.items():
        out = F.when(kind == name, priority).otherwise(out)
    return out


def trimmed(text: Column, target: Column) -> Column:
    """The text cut to about ``target`` characters by its content type's rule."""
    dots = lambda x: F.concat(F.trim(F.substr(x, F.lit(1), F.greatest(target - 3, F.lit(0)))), F.lit("..."))
    plain = F.regexp_replace(F.regexp_replace(text, BRACKETED, ""), INSERTED, ",")
    calm = text
    for w in FILLER_WORDS:
        calm = F.regexp_replace(calm, rf"(?i)\b{w}\b\s*", "")
    calm = F.trim(F.regexp_replace(calm, r"\s+", " "))
    parts = F.split(text, SENTENCE_END)
    fits = lambda a, s: F.length(a["t"]) + F.length(s) + 2 <= target
    start = F.struct(F.concat(parts[0], F.lit(".")).alias("t"), F.lit(True).alias("go"))
    core = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start,
        lambda a, s: F.when(a["go"] & fits(a, s), F.struct(F.concat(a["t"], F.lit(" "), s, F.lit(".")).alias("t"), F.lit(True).alias("go"))).otherwise(F.struct(a["t"].alias("t"), F.lit(False).alias("go"))),
        lambda a: a["t"],
    )
    short = lambda x: once(x, lambda t: F.when(F.length(t) <= target, F.trim(t)).otherwise(dots(t)))

    def by_kind(kind: Column) -> Column:
        return (
            F.when(kind == "CODE", F.concat(F.lit("[CODE TRUNCATED - "), estimated_tokens(text).cast("string"), F.lit(" tokens]")))
            .when(kind == "INSTRUCTION", core)
            .when(kind == "FACT", short(plain))
            .when(kind == "EMOTIONAL", short(calm))
            .otherwise(dots(text))
        )

    return F.when(F.length(text) <= target, text).otherwise(once(content_type(text), by_kind))


def date_value(text: Column, today: Column) -> Column:
    """The date that a phrase names, by ordered rules; the first that holds counts."""
    return once(F.lower(text), lambda t: _date_in(t, today))


def _date_in(t: Column, today: Column) -> Column:
    number = F.try_to_number(F.regexp_extract(t, DATE_AHEAD, 1), F.lit("999999")).cast("int")
    unit = F.regexp_extract(t, DATE_AHEAD, 2)
    out = [
        F.when(unit != "", F.date_add(today, number * F.when(F.contains(unit, F.lit("tyg")), 7).when(F.contains(unit, F.lit("mies")), 30).otherwise(1))),
        F.when(F.contains(t, F.lit(IN_A_WEEK)), F.date_add(today, 7)),
        F.when(F.contains(t, F.lit(IN_A_MONTH)), F.date_add(today, 30)),
        F.when(F.contains(t, F.lit(TOMORROW)), F.date_add(today, 1)),
        F.when(F.contains(t, F.lit(IN_TWO_DAYS)), F.date_add(today, 2)),
        F.when(contains_any(t, TODAY), today),
    ]
    for word, day in WEEKDAYS.items():
        ahead = F.pmod(F.lit(day) - F.weekday(today), F.lit(7))
        out.append(F.when(F.contains(t, F.lit(word)), F.date_add(today, F.when(ahead == 0, 7).otherwise(ahead))))

    def rolled(day: Column, month: Column) -> Column:
        made = lambda y: F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day))
        this = made(F.year(today))
        return F.when(this < today, made(F.year(today) + 1)).otherwise(this)

    part = lambda pattern, i: F.when(F.regexp_extract(t, pattern, i) != "", F.regexp_extract(t, pattern, i).cast("int"))
    out.append(rolled(part(DATE_NUMBERS, 1), part(DATE_NUMBERS, 2)))
    months = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    out.append(rolled(part(DATE_NAMED, 1), F.try_element_at(months, F.regexp_extract(t, DATE_NAMED, 2))))
    for word, month in MONTHS.items():
        end = contains_any(t, MONTH_END)
        mid = contains_any(t, MONTH_MIDDLE)
        day = F.when(end, MONTH_DAYS[month - 1]).when(mid, 15)
        out.append(F.when(F.contains(t, F.lit(word)), F.try_to_date(F.format_string("%04d-%02d-%02d", F.year(today), F.lit(month), day))))
    return F.date_format(F.coalesce(*out), "yyyy-MM-dd")


REPLY = "thought string, hint string, response string, mood string, new_concern string, resolved_concern string, topic string, safe_haven boolean"


def parsed_reply(raw: Column) -> Column:
    """A struct of a model's JSON reply: fenced or broken JSON still gives the
    response, and an empty one gives a placeholder."""
    clean = F.trim(F.regexp_replace(F.trim(raw), FENCE, ""))
    data = F.from_json(clean, REPLY)
    found = F.regexp_extract(raw, RESPONSE, 1)
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\\\", "\\"), ("\\t", "\t")):
        found = F.replace(found, F.lit(a), F.lit(b))
    some = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.struct(
        F.coalesce(some(data["response"]), some(found), F.lit("…")).alias("response"),
        F.coalesce(F.trim(data["thought"]), F.lit("")).alias("thought"),
        F.coalesce(F.trim(data["hint"]), F.lit("")).alias("hint"),
        data["mood"].alias("mood"), data["new_concern"].alias("new_concern"), data["resolved_concern"].alias("remove_concern"), data["topic"].alias("topic"),
        F.coalesce(data["safe_haven"], F.lit(False)).alias("safe_haven"),
    )


def ascii_folded(text: Column) -> Column:
    """Lower case without the marks of decomposable letters; other non-ASCII
    characters, such as the barred l, go."""
    plain = F.translate(F.lower(text), "ąáàâäãåćçčęéèêëíìîïńñóòôöõśšúùûüýÿźżž", "aaaaaaaccceeeeeiiiinnooooossuuuuyyzzz")
    return F.regexp_replace(plain, r"[^\x00-\x7F]", "")


def memory_line(ts: Column, as_of: Column) -> Column:
    """One line of a prompt's memories, from source, entity_type, importance, text and final_score."""
    head = F.concat(F.lit("- ["), F.col("source"), F.lit(", type:"), F.coalesce("entity_type", F.lit("")), F.lit(", importance:"), F.col("importance").cast("string"), F.lit("] "))
    return F.concat(head, relative_age(ts, as_of), F.col("text"), F.lit(" (relevance: "), F.format_string("%.2f", F.round("final_score", 2)), F.lit(")"))


def hours_label(ts: Column, as_of: Column) -> Column:
    """How long ago a message of the last days was said, by hours and then days;
    empty if ``ts`` is null."""
    s = F.timestamp_diff("SECOND", ts, as_of)
    ago = lambda n, unit: F.concat(F.lit("["), F.floor(n).cast("string"), F.lit(f"{unit} temu] "))
    return F.when(ts.isNull(), "").when(s < 3600, "[przed chwilą] ").when(s < 86400, ago(s / 3600, "h")).otherwise(ago(s / 86400, "d"))
