"""Three-state values, confidences, and the rule of what counts as a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal_form, token_form

#: Strings that say that there is no value.
ABSTENTION_TOKENS = ("n/a", "not present", "not applicable", "none", "unknown")
DEFAULT_CONFIDENCE = 0.5


def predicted_state(found: Column, value_json: Column) -> Column:
    """``missing`` without a key, ``null`` for JSON null, else ``present`` (the empty string too)."""
    return F.when(~F.coalesce(found, F.lit(False)), F.lit("missing")).when(value_json == "null", F.lit("null")).otherwise(F.lit("present"))


def valid_confidence(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & c.between(0.0, 1.0), F.lit(False))


def json_string(value_json: Column) -> Column:
    """The string that a JSON text holds; null for any other JSON."""
    return F.when(value_json.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "v string")["v"])


def substantive(found: Column, value_json: Column, in_vocabulary: Column, rule: str = "headline") -> Column:
    """Is a produced value one?  Omitted keys and null never are; under ``strict`` all else is; under
    ``headline`` blank strings and abstention tokens outside the field's own vocabulary are not."""
    there = F.coalesce(found & (value_json != "null"), F.lit(False))
    if rule == "strict":
        return there
    form = token_form(json_string(value_json))
    hollow = (form == "") | (form.isin(*ABSTENTION_TOKENS) & ~F.coalesce(in_vocabulary, F.lit(False)))
    return there & ~F.coalesce(hollow, F.lit(False))


def equal_values(a_json: Column, b_json: Column) -> Column:
    """Equality of canonical JSON texts (keys sorted), so types count."""
    return F.coalesce(a_json == b_json, F.lit(False))


#: Provenance keys that are kept, each a string of 1 to 200 characters.
PROVENANCE_KEYS = ("modelVersion", "vendorVersion", "calibratorVersion", "apiVersion", "requestId")


def clean_provenance(p: Column) -> Column:
    return F.struct(*[F.when(F.length(p[k]).between(1, 200), p[k]).alias(k) for k in PROVENANCE_KEYS])


def field_violation(is_object: Column, has_value: Column, has_confidence: Column, confidence: Column) -> Column:
    """The first fault of a produced field; null if it has none."""
    return (
        F.when(~is_object, F.lit("not_an_object"))
        .when(~has_value, F.lit("no_value_key"))
        .when(has_confidence & ~valid_confidence(confidence), F.lit("invalid_confidence"))
    )


def provenance_fault(p: Column) -> Column:
    """The first kept key whose value is no string of 1 to 200 characters; null if all are such or missing."""
    return F.coalesce(*[F.when(p[k].isNotNull() & ~F.length(p[k]).between(1, 200), F.lit(k)) for k in PROVENANCE_KEYS])


#: A JSON string with the colon after it if it is a key.
_STRING = r'"(?:[^"\\]|\\.)*+":?'


def normal_container(kind: Column, value_json: Column) -> Column:
    """A canonical JSON array or object with every string in it, keys apart, in its normal form; all else as it is."""
    strings, between = F.regexp_extract_all(value_json, F.lit(_STRING), F.lit(0)), F.split(value_json, _STRING, -1)
    text = lambda x: F.from_json(F.concat(F.lit('{"v":'), x, F.lit("}")), "v string")["v"]
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    normal = F.transform(strings, lambda x: F.when(x.endswith(":"), x).otherwise(quoted(normal_form(kind, text(x)))))
    pairs = F.zip_with(between, normal, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.array_join(pairs, "")


def salted_members(rows, ids, salt: Column):
    """``rows(doc_class, doc)`` with ``digest`` and ``known``: whether a list of salted digests has it."""
    from .text import salted_digest

    listed = ids.select(F.col("digest").alias("_listed")).distinct()
    out = rows.withColumn("digest", salted_digest(salt, F.col("doc_class"), F.col("doc")))
    return out.join(listed, out["digest"] == listed["_listed"], "left").withColumn("known", F.col("_listed").isNotNull()).drop("_listed")
