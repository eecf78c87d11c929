"""The rule cascade that types a question and its answer.

Each rule is (condition, label, reason, confidence); the first that holds decides. Conditions are built from a small
set of predicates, so that the same table yields the Catalyst expression here and SQL for other engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import squeeze

ANSWER_PATTERNS = {"money": fixed.MONEY, "percent": fixed.PERCENT, "phone": fixed.PHONE, "email": fixed.EMAIL, "url": fixed.URL, "date": fixed.DATE_LIKE, "numeric": fixed.NUMERIC, "zip": fixed.ZIP, "page": r"(?i)\bpage\b", "digit": r"\d", "letter": "[A-Za-z]", "no_person": "(?i)" + fixed.fused(fixed.NO_PERSON), "clock": "(?i)" + fixed.CLOCK_OR_DAY}
QUESTION_PATTERNS = {
    **{name: fixed.fused(patterns) for name, patterns in fixed.QUESTIONS.items()},
    "item": r"\b(upc|promo no|item#|item no|code|id|number)\b", "expiration": r"\bexpiration date\b", "source": r"\bsources?\b", "stand_for": r"\bstand for\b",
    "short_what": r"^what is [a-z]{2,6}\??$", "when": r"\b(time|timing|scheduled|schedule time|working hours|date|when)\b", "footnote": r"\bfootnote\b", "date_word": r"\bdate\b",
    "identifier_word": fixed.fused([w.replace(".", r"\.") for w in fixed.IDENTIFIER_WORDS]),
}

#: A condition is a list that must hold altogether; an item is (predicate, argument), a list of which one must hold, or
#: ("not", item). Predicates: q and a search a pattern in the question or answer, words bounds the answer's words from
#: above, long from below, digits counts them, in compares the answer in lower case, identifier looks at the answer
#: and compact at the answer without commas. Order, labels, reasons and confidences are fixed values.
RULES = [
    ([("empty", None)], "OTHER", "empty_answer", 1.0),
    ([("in", fixed.BOOLEAN_VALUES)], "BOOLEAN", "boolean_value", 1.0),
    ([[("a", "email"), ("a", "url")]], "CONTACT", "email_or_url_regex", 1.0),
    ([("a", "percent")], "PERCENTAGE", "percentage_regex", 1.0),
    ([("in", fixed.SPECIAL_LABELS)], "CATEGORY_LABEL", "generic_short_label", 0.9),
    ([("q", "QUANTITY"), ("a", "numeric")], "QUANTITY", "question_quantity_numeric", 0.97),
    ([("q", "DOCUMENT_REFERENCE"), [("a", "numeric"), ("identifier", None), ("a", "page")]], "DOCUMENT_REFERENCE", "question_doc_reference", 0.98),
    ([("q", "item"), ("compact", None)], "IDENTIFIER", "question_identifier_like", 0.95),
    ([("q", "CONTACT"), [("a", "phone"), ("a", "email"), ("a", "url")]], "CONTACT", "question_contact", 0.98),
    ([("q", "CONTACT"), ("digits", 7)], "CONTACT", "question_contact_numeric", 0.96),
    ([("q", "DATE_TIME"), ("a", "date")], "DATE_TIME", "question_date_and_date_like_answer", 0.98),
    ([("q", "expiration"), ("a", "date")], "DATE_TIME", "question_expiration_date", 0.98),
    ([("q", "source")], "FREE_TEXT", "question_sources", 0.94),
    ([("q", "stand_for")], "CATEGORY_LABEL", "abbreviation_expansion", 0.95),
    ([("q", "short_what"), ("words", 4), ("not", ("a", "digit"))], "CATEGORY_LABEL", "short_abbreviation_like_question", 0.9),
    ([("q", "NON_MONEY_NUMERIC"), ("a", "numeric")], "QUANTITY", "question_non_money_numeric", 0.97),
    ([("q", "NON_MONEY_MEASURE"), ("a", "numeric")], "QUANTITY", "question_measure_numeric", 0.96),
    ([("q", "PERCENTAGE"), [("a", "percent"), ("a", "numeric")]], "PERCENTAGE", "question_percentage", 0.95),
    ([("q", "LOCATION"), ("words", 8), ("not", ("a", "digit"))], "LOCATION", "question_location", 0.94),
    ([("q", "when"), ("a", "digit"), ("a", "clock")], "DATE_TIME", "question_time_or_date_span", 0.97),
    ([("a", "date"), ("not", ("q", "QUANTITY")), ("not", ("q", "IDENTIFIER")), ("not", ("q", "identifier_word"))], "DATE_TIME", "date_like_regex", 0.92),
    ([("a", "money")], "MONEY", "money_regex", 1.0),
    ([("q", "MONEY"), ("a", "numeric")], "MONEY", "question_money_numeric_answer", 0.96),
    ([("q", "IDENTIFIER"), [("a", "numeric"), ("identifier", None)]], "IDENTIFIER", "question_identifier", 0.95),
    ([("q", "ADDRESS"), ("a", "zip")], "ADDRESS", "question_address_zip", 0.92),
    ([("q", "ADDRESS")], "ADDRESS", "question_address", 0.9),
    ([("q", "ORG_NAME"), ("words", 12), ("not", ("a", "date"))], "ORG_NAME", "question_org_name", 0.94),
    ([("q", "PERSON_NAME"), ("not", ("a", "digit")), ("words", 8), ("not", ("a", "no_person"))], "PERSON_NAME", "question_person_name", 0.94),
    ([("q", "ROLE_TITLE")], "ROLE_TITLE", "question_role_title", 0.94),
    ([("q", "TITLE_HEADER"), ("words", 20), ("q", "footnote")], "FREE_TEXT", "question_footnote_text", 0.93),
    ([("q", "TITLE_HEADER"), ("words", 20)], "TITLE_HEADER", "question_title_header", 0.93),
    ([("q", "CATEGORY_LABEL"), ("words", 10), ("not", ("a", "digit"))], "CATEGORY_LABEL", "question_category_label", 0.92),
    ([("a", "phone"), ("digits", 7)], "CONTACT", "phone_regex", 0.95),
    ([("compact", None), ("a", "letter"), ("a", "digit"), ("q", "date_word"), ("a", "date")], "DATE_TIME", "question_date_over_identifier", 0.95),
    ([("compact", None), ("a", "letter"), ("a", "digit")], "IDENTIFIER", "alphanumeric_identifier_regex", 0.9),
    ([("a", "numeric")], "QUANTITY", "plain_numeric", 0.85),
    ([("words", 4), ("not", ("a", "digit"))], "CATEGORY_LABEL", "short_text_category_like", 0.82),
    ([("long", 4), ("not", ("a", "money")), ("not", ("a", "percent")), ("not", ("a", "date"))], "FREE_TEXT", "long_text_span", 0.8),
]


def _holds(item, q: Column, a: Column) -> Column:
    if isinstance(item, list):
        return reduce(Column.__or__, (_holds(x, q, a) for x in item))
    name, argument = item
    identifier = lambda x: x.rlike(r"\d") & x.rlike(fixed.IDENTIFIER)
    return {
        "empty": lambda: a == "",
        "in": lambda: F.lower(a).isin(*argument),
        "q": lambda: q.rlike(QUESTION_PATTERNS[argument]),
        "a": lambda: a.rlike(ANSWER_PATTERNS[argument]),
        "identifier": lambda: identifier(a),
        "compact": lambda: identifier(F.replace(a, F.lit(","), F.lit(""))),
        "digits": lambda: F.length(F.regexp_replace(a, r"\D", "")) >= argument,
        "words": lambda: F.size(F.split(a, " ")) <= argument,
        "long": lambda: F.size(F.split(a, " ")) >= argument,
        "not": lambda: ~_holds(argument, q, a),
    }[name]()


def label(question: Column, answer: Column) -> Column:
    """(field_type, rule_reason, rule_confidence); nulls and 0 where no rule holds."""
    q, a = F.lower(squeeze(question)), squeeze(answer)
    result = lambda kind, reason, sure: F.struct(F.lit(kind).cast("string").alias("field_type"), F.lit(reason).cast("string").alias("rule_reason"), F.lit(sure).alias("rule_confidence"))
    chain = F
    for conditions, kind, reason, sure in RULES:
        chain = chain.when(reduce(Column.__and__, (_holds(c, q, a) for c in conditions)), result(kind, reason, sure))
    return chain.otherwise(result(None, None, 0.0))


def _sql(item) -> str:
    if isinstance(item, list):
        return "(" + " OR ".join(map(_sql, item)) + ")"
    name, argument = item
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    identifier = lambda x: f"(regexp_matches({x}, '\\d') AND regexp_matches({x}, {quoted(fixed.IDENTIFIER)}))"
    return {
        "empty": lambda: "a = ''",
        "in": lambda: "lower(a) IN (" + ", ".join(map(quoted, argument)) + ")",
        "q": lambda: f"regexp_matches(q, {quoted(QUESTION_PATTERNS[argument])})",
        "a": lambda: f"regexp_matches(a, {quoted(ANSWER_PATTERNS[argument])})",
        "identifier": lambda: identifier("a"),
        "compact": lambda: identifier("replace(a, ',', '')"),
        "digits": lambda: f"length(regexp_replace(a, '\\D', '', 'g')) >= {argument}",
        "words": lambda: f"len(string_split(a, ' ')) <= {argument}",
        "long": lambda: f"len(string_split(a, ' ')) >= {argument}",
        "not": lambda: f"NOT {_sql(argument)}",
    }[name]()


def label_sql(column: int) -> str:
    """A CASE over ``q`` and ``a`` for other engines: 0 the type, 1 the reason, 2 the confidence."""
    last = ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "CAST(0.0 AS DOUBLE)")[column]
    shown = lambda rule: f"CAST({rule[3]} AS DOUBLE)" if column == 2 else f"'{rule[1 + column]}'"
    return "CASE " + " ".join(f"WHEN {' AND '.join(map(_sql, rule[0]))} THEN {shown(rule)}" for rule in RULES) + f" ELSE {last} END"
