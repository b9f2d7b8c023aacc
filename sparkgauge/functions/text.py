"""Column expressions on strings: pointers, tokens, normal forms."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's trim() and \\s have it.
JS_SPACES = "\\t\\n\\x0B\\f\\r\\x20\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
JS_SPACE = f"[{JS_SPACES}]"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_SPACE}+|{JS_SPACE}+\\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(js_trim(c), f"{JS_SPACE}+", " ")


def token_form(c: Column) -> Column:
    """Trimmed, lower case, white space collapsed: the form in which abstention tokens match."""
    return F.lower(collapse(c))


def wildcard(pointer: Column) -> Column:
    """Array indexes of a JSON Pointer become ``*``; a first part without a slash before it stays."""
    return F.array_join(
        F.transform(F.split(pointer, "/"), lambda t, i: F.when((i > 0) & t.rlike("^[0-9]+\\z"), F.lit("*")).otherwise(t)), "/"
    )


def canonical_field(pointer: Column) -> Column:
    return F.array_join(F.transform(F.split(pointer, "/"), lambda t: F.when(t.rlike("^[0-9]+\\z"), F.lit("*")).otherwise(t)), "/")


def escape_token(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_token(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_error(pointer: Column) -> Column:
    """Why a pointer can't be split; null if it can."""
    return (
        F.when(~pointer.startswith("/"), F.lit("does not start with /"))
        .when(pointer.rlike("~([^01]|$)"), F.lit("invalid escape"))
    )


def pointer_tokens(pointer: Column) -> Column:
    return F.transform(F.filter(F.split(pointer, "/", -1), lambda t, i: i > 0), unescape_token)


def search_tokens(field: Column) -> Column:
    """What to look for in a text: the field's name, and the name with blanks."""
    return F.array_distinct(F.array(field, F.trim(F.replace(field, F.lit("_"), F.lit(" ")))))


# --- normal forms of values ------------------------------------------------------------


def text_form(c: Column) -> Column:
    return F.lower(collapse(c))


def currency_form(c: Column) -> Column:
    """Minimal decimal of an amount of money, null if it is none.

    Currency signs and white space go; commas count only as thousands separators; a minus
    sign or parentheses negate; minus zero is zero.
    """
    valid = "^([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\\.[0-9]+)?\\z|^\\.[0-9]+\\z"

    def decimal(parts: Column, negative: Column) -> Column:
        whole = F.regexp_replace(F.get(parts, F.lit(0)), "^0+(?=[0-9])", "")
        rest = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "0+\\z", "")
        digits = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit("."), rest)))
        return _let(digits, lambda d: F.when(negative & (d != "0"), F.concat(F.lit("-"), d)).otherwise(d))

    def amount(bare: Column) -> Column:
        inside = bare.startswith("(") & bare.endswith(")") & (F.length(bare) > 1)
        body = F.regexp_replace(F.when(inside, bare.substr(F.lit(2), F.length(bare) - 2)).otherwise(bare), "^-", "")
        plain = lambda x: F.split(F.replace(x, F.lit(","), F.lit("")), "\\.", -1)
        return _let(body, lambda x: F.when(x.rlike(valid), decimal(plain(x), inside | bare.startswith("-"))))

    return _let(F.regexp_replace(c, f"[\\p{{Sc}}{JS_SPACES}]", ""), amount)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: as a column it would be copied to each place in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Months by their first three letters, in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Accepted names of months.
MONTH_NAMES = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)


def date_form(c: Column) -> Column:
    """ISO date of ``2024-01-31``, ``1/31/24``, ``01/31/2024``, ``Jan 31, 2024`` and the like; null if it is no date."""
    us = "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})\\z"
    named = f"^(?i)({MONTH_NAMES})\\.? ([0-9]{{1,2}}),? ([0-9]{{4}})\\z"
    two = lambda x: F.lpad(x, 2, "0")

    def iso_of(t: Column) -> Column:
        full = lambda y: F.when(F.length(y) == 4, y).when(y < "50", F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))
        year = _let(F.regexp_extract(t, us, 3), full)
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(t, 1, 3)))
        return (
            F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"), t)
            .when(t.rlike(us), F.concat_ws("-", year, two(F.regexp_extract(t, us, 1)), two(F.regexp_extract(t, us, 2))))
            .when(t.rlike(named), F.concat_ws("-", F.regexp_extract(t, named, 3), two(month.cast("string")), two(F.regexp_extract(t, named, 2))))
        )

    return F.date_format(F.try_to_date(_let(collapse(c), iso_of), "yyyy-MM-dd"), "yyyy-MM-dd")


def normal_form(kind: Column, value: Column) -> Column:
    """Of a string by its rule's kind; what a kind can't read is compared as text."""
    return (
        F.when(kind == "currency", F.coalesce(currency_form(value), text_form(value)))
        .when(kind == "date", F.coalesce(date_form(value), text_form(value)))
        .when(kind == "text", text_form(value))
        .otherwise(value)
    )


# --- responses -------------------------------------------------------------------------


#: Fixed value: how every JSON text begins.  A parser says no to others by an exception, which costs more than all the rest of a repair.
JSON_START = '^[ \\t\\r\\n]*(?:[\\[{"]|-?[0-9]|true|false|null)'


def repair_text(c: Column) -> Column:
    """The text, if it begins like JSON: what a parser is asked."""
    return F.when(c.rlike(JSON_START), c)


def parsed_text(c: Column) -> Column:
    return F.to_json(F.try_parse_json(repair_text(c)))


def _unfenced(c: Column) -> Column:
    full = js_trim(F.regexp_replace(F.regexp_replace(js_trim(c), "(?i)^```(?:json)?\\s*", ""), "\\s*```$", ""))
    # most texts hold no fence and begin and end with a visible character of ASCII: the patterns would look at each of their places for nothing
    bare = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(F.contains(c, F.lit("```")), full).when(bare, c).otherwise(js_trim(c))


def _outermost(c: Column) -> Column:
    return F.coalesce(*[F.get(F.regexp_extract_all(c, F.lit(p), F.lit(0)), F.lit(0)) for p in ("(?s)\\{.*\\}", "(?s)\\[.*\\]")])


def _relaxed(c: Column) -> Column:
    return F.regexp_replace(c, ",\\s*([}\\]])", "$1")


#: What a repair tries after the text as it is, each from the text before.
RUNGS: tuple[Callable[[Column], Column], ...] = (_unfenced, _outermost, _relaxed)


def repair_json(raw: Column) -> Column:
    """The first of these that parses, as JSON text: as it is, without a code fence, the outermost
    braces or brackets, the same without commas before a closer; null if none does.

    Each is made once, and only if those before it don't parse; what doesn't begin like JSON is not given to a parser.
    As one column this is a lambda in a lambda, which Spark interprets; over a table ``adapters.repaired`` does the same in compiled code.
    """
    # each rung hands on what was found, the text it tried, and those before it
    step = lambda found, text, tries: F.struct(found.alias("found"), text.alias("text"), tries.alias("tries"))
    ladder = _let(raw, lambda c: step(parsed_text(c), c, F.array(repair_text(c))))
    down = lambda rung: lambda s: step(s["found"], F.when(s["found"].isNull(), rung(s["text"])), s["tries"])
    for rung in RUNGS:
        ladder = _let(ladder, down(rung))
        ladder = _let(ladder, lambda s: step(F.coalesce(s["found"], parsed_text(s["text"])), s["text"], F.when(s["found"].isNull(), F.concat(s["tries"], F.array(repair_text(s["text"]))))))
    return last_of_keys(_let(ladder, lambda s: repair_result(s["found"], [F.get(s["tries"], F.lit(i)) for i in range(len(RUNGS) + 1)])))


def repair_result(found: Column, tries: list[Column]) -> Column:
    """What Python gets: strings only, as Spark measures a list anew from its batch's first row with every row it adds."""
    return F.struct(found.alias("found"), *[F.when(found.isNull(), t).alias(f"try{i}") for i, t in enumerate(tries)])


def last_of_keys(result: Column) -> Column:
    """What was found; an object that repeats a key is no VARIANT: only such texts, and those that begin like JSON and are none, are looked at again."""
    return F.arrow_udf(_last_of_keys, "string")(result)


def _last_of_keys(result: pa.Array) -> pa.Array:
    """``found``, or else the first of the tries that is JSON, with the last value of each key."""
    found, *tries = result.flatten()
    left = np.zeros(len(found), bool)
    for t in tries:
        left |= t.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(left)
    if not len(at):
        return found
    read = [_reparsed(texts) for texts in zip(*[t.take(pa.array(at)).to_pylist() for t in tries], strict=True)]
    return pc.replace_with_mask(found, pa.array(left), pa.array(read, found.type))


def _reparsed(texts: tuple[str | None, ...]) -> str | None:

    def refuse(word: str):
        raise ValueError(word)

    for text in texts:
        try:
            if text is not None:
                return json.dumps(json.loads(text, parse_constant=refuse), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            continue
    return None


def logprob_confidence(tokens: Column, value: Column) -> Column:
    """exp of the mean logprob of the tokens that the value holds, else of all; null without tokens.

    ``tokens``: array of (token, logprob).
    """
    inside = F.filter(tokens, lambda t: (F.length(value) > 0) & (F.length(js_trim(t["token"])) > 0) & F.contains(value, js_trim(t["token"])))
    pool = F.when(F.size(inside) > 0, inside).otherwise(tokens)
    mean = F.aggregate(pool, F.lit(0.0), lambda a, t: a + t["logprob"]) / F.size(pool)
    return F.when(F.size(tokens) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean))))


#: Statuses that may pass, and those that would meet every call.
RETRIED_STATUS, FATAL_STATUS = (408, 425, 429), (401, 402, 403, 407)


def failure_kind(status: Column) -> Column:
    """What an HTTP status means for a call: null (usable), transport_failure, fatal or contract_failure."""
    return (
        F.when(status.isin(*RETRIED_STATUS) | (status >= 500), F.lit("transport_failure"))
        .when(status.isin(*FATAL_STATUS), F.lit("fatal"))
        .when((status < 200) | (status >= 300), F.lit("contract_failure"))
    )


# --- what may be published -------------------------------------------------------------


def redact_url(url: Column) -> Column:
    """A project's id in a path gives way to a fixed mark; the first one only."""
    return F.regexp_replace(url, "^(.*?)/projects/[^/]+/", "$1/projects/<gcp-project>/")


def redact_ray(ray: Column) -> Column:
    """A request ray without the letters of its place, 64 characters at most."""
    return F.regexp_replace(F.substring(ray, 1, 64), "-[A-Za-z]{3}\\z", "")


def salted_digest(salt: Column, doc_class: Column, doc: Column) -> Column:
    return F.sha2(F.concat_ws(":", salt, doc_class, doc), 256)
