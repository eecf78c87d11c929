"""Expressions over token arrays: sub-tokens, answer spans, their context, and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import normalize, strip

SPAN = "struct<start:int,end:int>"
#: Stands between tokens that are normalised together; it is neither white space nor part of a word.
_MARK = "\x01"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row.

    An expression that a lambda refers to is computed again for each element, as the optimizer may inline it; bound to
    a lambda's variable it is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def flatten_tokens(lines: Column) -> Column:
    """Tokens of nested lines of words in reading order, stripped, without blank ones; ``bbox`` stands in for a
    missing ``bounding_box``."""
    tokens = F.transform(F.flatten(F.transform(F.filter(F.coalesce(lines, F.array()), lambda x: x["words"].isNotNull()), lambda x: x["words"])), lambda w: F.struct(strip(w["text"]).alias("text"), F.coalesce(w["bounding_box"], w["bbox"]).alias("bbox")))
    return F.filter(tokens, lambda t: t["text"] != "")


def normalized_tokens(tokens: Column) -> Column:
    """Each token normalised; all at once, as one text with marks between the tokens."""
    marked = F.array_join(F.transform(tokens, lambda t: F.translate(F.coalesce(t, F.lit("")), _MARK, " ")), _MARK)
    each = F.transform(F.split(F.regexp_replace(F.lower(marked), rf"[^\p{{L}}\p{{N}}_{_MARK}]+", " "), _MARK), lambda t: F.trim(t))
    return F.when(F.size(tokens) > 0, each).otherwise(F.array().cast("array<string>"))


def subtokens(tokens: Column) -> Column:
    """(part, token): the words of each normalised token with the token's index."""
    return words_of(normalized_tokens(tokens))


def words_of(normalized: Column) -> Column:
    """(part, token) of tokens that are normalised already."""
    part = lambda p, i: F.struct(p.alias("part"), i.cast("int").alias("token"))
    none = F.array().cast("array<struct<part:string,token:int>>")
    words = lambda t, i: F.when(t == "", none).when(F.instr(t, " ") == 0, F.array(part(t, i))).otherwise(F.transform(F.split(t, " "), lambda p: part(p, i)))
    return F.flatten(F.transform(normalized, words))


def find_spans(flat: Column, answer: Column) -> Column:
    """All spans (start, end) of token indices whose sub-tokens equal the answer's words, each once, in order.

    Window starts are found on the plain array of parts, so each step is one slice and one comparison. Spans are whole
    numbers while repetitions are left out, as those are told apart by hash."""
    none = F.array().cast(f"array<{SPAN}>")

    def search(v: Column) -> Column:
        parts, at, words = v["parts"], v["at"], v["words"]
        n, first = F.size(words), F.get(words, F.lit(0))
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - n + 1, F.lit(1))), lambda i: (F.get(parts, i - 1) == first) & (F.slice(parts, i, n) == words))
        codes = F.array_distinct(F.transform(starts, lambda i: F.shiftleft(F.get(at, i - 1).cast("long"), 32) + F.get(at, i + n - 2)))
        spans = F.transform(codes, lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("start"), (c % (1 << 32)).cast("int").alias("end")))
        return F.when(first == "", none).otherwise(spans)

    words = F.split(normalize(answer), " ")
    return let(flat, lambda f: let(F.struct(f["part"].alias("parts"), f["token"].alias("at"), words.alias("words")), search))


def union_of_spans(flat: Column, candidates: Column) -> Column:
    """The spans of every candidate in order, each once."""
    return let(F.struct(flat.alias("flat"), candidates.alias("candidates")), lambda v: F.array_distinct(F.flatten(F.transform(v["candidates"], lambda c: find_spans(v["flat"], c)))))


def expand(spans: Column, k: Column | int, n: Column) -> Column:
    """Spans with ``k`` more tokens at either side, within ``n`` tokens, each once."""
    k = F.lit(k) if isinstance(k, int) else k
    wider = F.transform(spans, lambda s: F.struct(F.greatest(s["start"] - k, F.lit(0)).alias("start"), F.least(s["end"] + k, n - 1).alias("end")))
    return F.when(n <= 0, spans).otherwise(F.array_distinct(wider))


def record_spans(spans: Column, start: Column, end: Column) -> Column:
    """Valid spans of a record; else its single (start, end)."""
    valid = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    return F.when(F.size(F.coalesce(valid, F.array().cast(f"array<{SPAN}>"))) > 0, valid).when(start.isNotNull() & end.isNotNull(), F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))).otherwise(F.array().cast(f"array<{SPAN}>"))


def replaced(tokens: Column, spans: Column, mask: str | None) -> Column:
    """Tokens without those of the spans, or with ``mask`` in their places; in time proportional to both."""

    def body(v: Column) -> Column:
        n = F.size(v["tokens"])
        covered = F.array_distinct(F.flatten(F.transform(F.filter(v["spans"], lambda s: s["start"] <= F.least(s["end"], n - 1)), lambda s: F.sequence(s["start"], F.least(s["end"], n - 1)))))
        kept = F.array_except(F.sequence(F.lit(0), n - 1), covered)
        token = lambda i: F.get(v["tokens"], i)
        if mask is None:
            out = F.transform(kept, token)
        else:
            pair = lambda i, t: F.struct(i.alias("i"), t.alias("t"))
            both = F.concat(F.transform(kept, lambda i: pair(i, token(i))), F.transform(covered, lambda i: pair(i, F.lit(mask))))
            out = F.transform(F.sort_array(both), lambda x: x["t"])
        return F.when((n == 0) | (F.size(v["spans"]) <= 0), v["tokens"]).otherwise(out)

    return let(F.struct(tokens.alias("tokens"), spans.alias("spans")), body)


def redact(tokens: Column, spans: Column, strategy: str, mask: str = fixed.MASK_TEXT) -> Column:
    """Tokens of spans left as they are (none), removed (drop) or replaced (mask)."""
    if strategy == "none":
        return tokens
    if strategy in ("drop", "mask"):
        return replaced(tokens, spans, mask if strategy == "mask" else None)
    raise ValueError(f"unknown strategy {strategy}")


def joined(tokens: Column) -> Column:
    """Tokens that aren't blank, joined by single blanks."""
    return F.array_join(F.filter(F.transform(tokens, strip), lambda t: t != ""), " ")
