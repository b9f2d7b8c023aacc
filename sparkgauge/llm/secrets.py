"""Secrets in texts: fixed patterns, and windows of high entropy within candidate strings.

Everything is an expression over one row: no shuffle, no Python.  Regular expressions give
matches but not their places, so a text is also split at the same pattern; lengths of the
pieces and matches, added up, are the places (in code points).

Entropy: over each candidate string (a long run of characters of keys and tokens) a window
slides by one character; counts of the window's characters are carried along, and their sum of c log2 c changes
only by the character that enters and the one that leaves.  A window counts if
its entropy reaches the threshold of the candidate's character class; windows that overlap or touch are one span.
Candidates that the allow list names, or that lie in a span found by a pattern, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

#: The patterns of the base spans, in the order of their kinds.
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE_CHARS = 12
#: A run of 18 or more after all is one that the shorter pattern matches and that is long enough.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyRules:
    """What counts as random: thresholds in bits for windows of ``window`` characters."""

    window: int = 20
    candidate: str = "[A-Za-z0-9+/_=-]{20,}"
    #: Character classes in the order tried: name, pattern of the whole candidate, bits.
    classes: tuple = (
        ("digits", "^[0-9]+$", 2.8),
        ("hex", "^[0-9a-fA-F]+$", 3.0),
        ("letters", "^[A-Za-z]+$", 3.7),
        ("alnum", "^[A-Za-z0-9]+$", 3.6),
        ("base64", "^.*$", 3.8),
    )
    #: Candidates that one of these matches are no secrets.
    allow: tuple = (
        "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
        "(?i)example|sample|placeholder|dummy|changeme|xxxx",
        "^[A-Za-z]+([/_=-][A-Za-z]*)+$",  # paths and compounds of words
        "^[0-9]+([/_=-][0-9]*)+$",  # dates, numbers, rulers
        "(?i)123456789|987654321|abcdefghijkl|qwertyuiop",  # rows of digits, letters, keys
    )


_SPAN = "array<struct<start:int,end:int>>"


def _places(matches: str, pieces: str) -> str:
    """SQL: spans of ``matches`` out of the text's ``pieces`` between them."""
    return f"""
      aggregate(
        if(size({matches}) = 0, cast(array() as array<int>), sequence(0, size({matches}) - 1)),
        named_struct('at', 0, 'out', cast(array() as {_SPAN})),
        (x, i) -> named_struct(
          'at', x.at + char_length({pieces}[i]) + char_length({matches}[i]),
          'out', array_append(x.out, named_struct(
            'start', x.at + char_length({pieces}[i]),
            'end', x.at + char_length({pieces}[i]) + char_length({matches}[i])))),
        x -> x.out)"""


def _windows(codes: str, kinds: str, window: int, bits: str) -> str:
    """SQL: the runs (array of from, to) of a candidate that its windows of enough entropy cover.

    ``codes``: the candidate's characters as numbers from 1; ``kinds``: how many different ones there are."""
    gain = lambda n: f"(({n} + 1) * log2({n} + 1) - if({n} = 0, 0D, {n} * log2({n})))"
    came, went = f"{codes}[i]", f"if(i >= {window}, {codes}[i - {window}], 0)"
    # the sum over the window's counts, first without the character that leaves, then with the one that enters
    left = f"(if({went} = 0, 0, get(x.counts, {went} - 1)) - 1)"
    entered = f"(get(x.counts, {came} - 1) - if({came} = {went}, 1, 0))"
    total = f"(x.sum - if({went} = 0, 0D, {gain(left)}) + {gain(entered)})"
    full = f"(i >= {window} - 1 AND log2({window}) - {total} / {window} >= {bits} - 1e-9)"
    apart = f"(x.to >= 0 AND x.to < i - {window} + 1)"
    return f"""
      aggregate(
        sequence(0, size({codes}) - 1),
        named_struct('sum', 0D, 'counts', array_repeat(0, {kinds}), 'from', -1, 'to', -1, 'runs', cast(array() as array<struct<from:int,to:int>>)),
        (x, i) -> named_struct(
          'sum', {total},
          'counts', transform(x.counts, (held, place) -> held + if(place + 1 = {came}, 1, 0) - if(place + 1 = {went}, 1, 0)),
          'from', if({full} AND (x.from < 0 OR {apart}), i - {window} + 1, x.from),
          'to', if({full}, i + 1, x.to),
          'runs', if({full} AND {apart}, array_append(x.runs, named_struct('from', x.from, 'to', x.to)), x.runs)),
        x -> if(x.from < 0, x.runs, array_append(x.runs, named_struct('from', x.from, 'to', x.to))))"""


def _text(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(
        f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"
    )


def find_secrets(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """The rows of ``docs`` with ``base`` and ``found``: arrays of (start, kind, end), where kind
    is the place in ``KINDS``, sorted; ``found`` holds the base spans and those of entropy.

    Null text counts as empty, an empty text has no spans, a long one is read whole; every row gives one row, repeated
    rows too; an empty table gives no rows.  Further columns pass through whatever their names, but for ``base``
    and ``found`` (in any case).
    """
    order, (docs, others) = docs.columns, aside(docs, ("doc_id", "text"))
    rows = docs.withColumn("_st", F.coalesce("text", F.lit("")))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": rules.candidate}
    for kind, pattern in patterns.items():
        rows = rows.withColumn(f"_sm_{kind}", F.regexp_extract_all("_st", F.lit(pattern), F.lit(0)))
    rows = rows.withColumn("_sv", F.when(F.size("_sm_assign") > 0, F.regexp_extract_all("_st", F.lit(ASSIGN), F.lit(2))))
    for kind, pattern in patterns.items():
        # most texts have no match: only the others are split
        rows = rows.withColumn(f"_sp_{kind}", F.when(F.size(f"_sm_{kind}") > 0, F.split("_st", pattern, -1)))
    for kind in patterns:
        rows = rows.withColumn(f"_sl_{kind}", F.expr(_places(f"_sm_{kind}", f"_sp_{kind}")))
    spans = lambda kind, of: f"transform({of}, s -> named_struct('start', s.start, 'kind', {KINDS.index(kind)}, 'end', s.end))"
    # arrays are zipped rather than looked up inside a lambda, where they would be computed for each element
    long_values = (
        f"filter(zip_with(_sl_assign, coalesce(_sv, array()), (s, v) -> "
        f"named_struct('start', s.start, 'end', s.end, 'long', char_length(v) >= {ASSIGN_VALUE_CHARS})), s -> s.long)"
    )
    rows = rows.withColumn(
        "base",
        F.expr(f"array_sort(concat({spans('assign', long_values)}, {spans('access', '_sl_access')}, {spans('hex', '_sl_hex')}))"),
    )
    quote = lambda p: "r'" + p.replace("'", "\\'") + "'"
    bits = "CASE " + " ".join(f"WHEN m RLIKE {quote(p)} THEN {b}D" for _, p, b in rules.classes) + " END"
    allowed = " OR ".join(f"m RLIKE {quote(p)}" for p in rules.allow) or "false"
    # candidates outside the base spans, with their class's threshold
    rows = rows.withColumn(
        "_sc",
        F.expr(f"""
          filter(
            zip_with(_sm_entropy, _sl_entropy, (m, s) -> named_struct(
              'start', s.start, 'bits', {bits},
              'text', m, 'allowed', {allowed},
              'known', exists(base, b -> b.start <= s.start AND s.end <= b.end))),
            c -> NOT c.allowed AND NOT c.known AND c.bits <= log2({rules.window}))"""),
    )
    # a character's number is its place among the different ones of its candidate
    rows = rows.withColumn("_sk", F.expr("transform(_sc, c -> named_struct('chars', split(c.text, ''), 'kinds', array_distinct(split(c.text, ''))))"))
    rows = rows.withColumn("_sn", F.expr("transform(_sk, c -> named_struct('codes', transform(c.chars, y -> cast(array_position(c.kinds, y) as int)), 'kinds', size(c.kinds)))"))
    runs = _windows("n.codes", "n.kinds", rules.window, "c.bits")
    rows = rows.withColumn("_sw", F.expr(f"zip_with(_sc, _sn, (c, n) -> named_struct('start', c.start, 'runs', {runs}))"))
    rows = rows.withColumn(
        "found",
        F.expr(f"""
          array_sort(concat(base, flatten(transform(_sw, w -> transform(w.runs,
            r -> named_struct('start', w.start + r.from, 'kind', {KINDS.index('entropy')}, 'end', w.start + r.to))))))"""),
    )
    every = {c: others[c] if c in others else F.col(c.lower()) for c in order if c.lower() not in ("base", "found")}
    return rows.select(*[x.alias(c) for c, x in every.items()], "base", "found")


def secrets_digest(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy`` of every row."""
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    n = lambda kind, of: F.expr(f"cast(size(filter({of}, s -> s.kind = {KINDS.index(kind)})) as bigint)").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[n(k, "base") for k in KINDS[:3]], F.sha2(_text("base"), 256).alias("base_sha256"),
        _text("found").alias("spans"), n("entropy", "found"),
    )
