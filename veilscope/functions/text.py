"""Text expressions: normalisers, answer selection, ids, labels, and the parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def strip(c: Column) -> Column:
    """Without white space at both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Lower case; anything but letters, digits and ``_`` becomes a blank; single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def squeeze(c: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def squeeze_lower(c: Column) -> Column:
    """As ``squeeze``, in lower case; punctuation stays."""
    return squeeze(F.lower(c))


def without_tags(c: Column) -> Column:
    """Tags and white space become single blanks; case stays."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))


def select_answer(answers: Column) -> Column:
    """The first answer that isn't blank, stripped; else empty."""
    return F.coalesce(F.get(F.filter(F.transform(answers, strip), lambda a: a != ""), F.lit(0)), F.lit(""))


def first_answer(answers: Column, answer: Column) -> Column:
    """The first of the answers even if it is blank; the single answer if there are none."""
    return F.coalesce(F.get(answers, F.lit(0)), answer, F.lit(""))


def answer_candidates(answer: Column, answers: Column) -> Column:
    """The answer and the other answers, stripped, without blanks and repetitions, in order."""
    every = F.concat(F.array(answer), F.coalesce(answers, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, strip), lambda a: a != ""))


def example_id(dataset: Column, split: Column, row: Column, question: Column, answer: Column) -> Column:
    """MD5 of the parts, with single blanks in texts."""
    return F.md5(F.concat_ws("|||", squeeze(dataset), squeeze(split), row.cast("string"), squeeze(question), squeeze(answer)))


def normalize_label(c: Column) -> Column:
    """A label of the taxonomy: itself, by another name, or OTHER."""
    value = F.upper(strip(F.regexp_replace(strip(c), "[`\"'.,:;!?]+", "")))
    names = F.create_map(*(F.lit(x) for pair in fixed.LABEL_ALIASES.items() for x in pair))
    return F.when(value.isin(*fixed.TAXONOMY), value).otherwise(F.coalesce(F.try_element_at(names, value), F.lit("OTHER")))


def normalize_label_pilot(c: Column) -> Column:
    """(label, is_new): blanks go too, and an unknown name in snake case is a new label."""
    value = F.regexp_replace(strip(c), "[`\"'.,:;!?\\s]+", "")
    known = F.struct(F.upper(value).alias("label"), F.lit(False).alias("is_new"))
    new = F.struct(F.lower(value).alias("label"), F.lit(True).alias("is_new"))
    return F.when(F.upper(value).isin(*fixed.TAXONOMY), known).when(F.lower(value).rlike("^[a-z][a-z0-9_]*$"), new).otherwise(F.struct(F.lit("OTHER").alias("label"), F.lit(False).alias("is_new")))


def parse_model_answer(c: Column) -> Column:
    """(label, is_new) from a model's answer: the object between its outermost braces, if that is JSON and not empty; else
    a known word. An object without either key is OTHER."""
    kind = "struct<field_type:string,new_type:string>"
    raw = F.coalesce(c, F.lit(""))
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    inner = F.from_json(braces, kind)
    word = F.regexp_extract(F.upper(raw), r"\b(" + "|".join(fixed.PILOT_TYPES) + r")\b", 1)
    snake = "^[a-z][a-z0-9_]{1,63}$"
    field, new = strip(inner["field_type"]), strip(inner["new_type"])
    row = lambda label, is_new: F.struct(label.alias("label"), F.lit(is_new).alias("is_new"))
    no_object = F.coalesce(F.size(F.json_object_keys(braces)), F.lit(0)) <= 0
    return (
        F.when(no_object, F.when(word != "", row(word, False)).otherwise(row(F.lit("OTHER"), False)))
        .when(field.isin(*fixed.PILOT_TYPES), row(field, False)).when(field.rlike(snake), row(field, True)).when(new.rlike(snake), row(new, True)).otherwise(row(F.lit("OTHER"), False))
    )


def basename(c: Column) -> Column:
    """The last part of a path with either kind of slashes."""
    return F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)


def extract_question(question: Column, prompt: Column, chat: Column) -> Column:
    """The question; else the prompt; else what follows ``Question:`` in the chat, without tags."""
    full = lambda c: F.when(squeeze(c) != "", squeeze(c))
    return F.coalesce(full(question), full(prompt), full(F.regexp_extract(without_tags(chat), r"(?i)Question:\s*(.*)", 1)), F.lit(""))


def thumb_size(width: Column, height: Column, most: int = 1024) -> Column:
    """(width, height) of a picture whose longer side is ``most`` at most, its shape kept."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale)).cast("long")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def char_code_sum(c: Column) -> Column:
    """The sum of the characters' code points, from which seeds are made."""
    return F.aggregate(F.split(F.coalesce(c, F.lit("")), ""), F.lit(0).cast("long"), lambda s, x: s + F.ascii(x))
