"""Preference labels and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLIGHT = 0.5


#: Labels after ``normal_label`` (fixed values of the published formats): A is preferred, B is preferred.
A_LABELS = ("a", "a-is-clearly-better", "a-clearly-better", "clearly-a", "response-a", "option-a", "left", "0", "0.0", "response-0", "response-1")
A_SLIGHT = ("a-is-slightly-better", "a-slightly-better", "slightly-a")
B_LABELS = ("b", "b-is-clearly-better", "b-clearly-better", "clearly-b", "response-b", "option-b", "right", "1", "1.0", "response-2")
B_SLIGHT = ("b-is-slightly-better", "b-slightly-better", "slightly-b")


#: How the published data spell them, from A to B.
USUAL = ("A-is-clearly-better", "A-is-slightly-better", "Tie", "B-is-slightly-better", "B-is-clearly-better")


def normal_label(raw: Column) -> Column:
    """Lower case, trimmed, each blank and underscore a hyphen."""
    return F.translate(F.lower(F.trim(raw.cast("string"))), "_ ", "--")


def signed_weight(raw: Column, slight: float = SLIGHT) -> Column:
    """Weight of a label, negative where B is preferred and 0 for ties, nulls and anything unknown.

    The published spellings are told by equality; only others are normalised and go through the rule.
    """
    text = raw.cast("string")
    usual = F.when(text == USUAL[0], F.lit(1.0)).when(text == USUAL[1], F.lit(float(slight))).when(text == USUAL[2], F.lit(0.0)).when(text == USUAL[3], F.lit(-float(slight))).when(text == USUAL[4], F.lit(-1.0))
    return usual.otherwise(_ruled_weight(text, slight))


def _ruled_weight(raw: Column, slight: float) -> Column:
    """The same by rule.

    Clear labels weigh 1, slight ones ``slight``. Numbers 0 and 1 name A and B; response-1 is A, response-2 is B. Beyond the known labels,
    one that names a or b as a part between hyphens and says better counts for that side, a first.
    """
    x = normal_label(raw)
    known = {**dict.fromkeys(A_LABELS, 1.0), **dict.fromkeys(A_SLIGHT, float(slight)), **dict.fromkeys(B_LABELS, -1.0), **dict.fromkeys(B_SLIGHT, -float(slight))}
    side = F.when(x.rlike("(^|-)a($|-)"), F.lit(1.0)).when(x.rlike("(^|-)b($|-)"), F.lit(-1.0)).otherwise(F.lit(0.0))
    loose = F.when(x.contains("better"), side * F.when(x.contains("slight"), F.lit(float(slight))).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    # a map, not a branch for each spelling: a plan holds this for every use of every label and must stay small enough to be compiled
    return F.coalesce(F.create_map(*[F.lit(v) for pair in known.items() for v in pair])[x], loose)


def sign_and_weight(raw: Column, slight: float = SLIGHT) -> Column:
    """struct(sign, weight) of a label: see ``signed_weight``."""
    w = F.coalesce(signed_weight(raw, slight), F.lit(0.0))
    return F.struct(F.signum(w).cast("int").alias("sign"), F.abs(w).alias("weight"))


def response_id(prompt: Column, side: str, text: Column) -> Column:
    """An alternative's id within its prompt: prompt::A_ and twelve hex digits of the text's SHA-1."""
    return F.concat(prompt.cast("string"), F.lit(f"::{side}_"), F.substring(F.sha1(text.cast("string").cast("binary")), 1, 12))


def safe_name(name: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(name.cast("string"), r"[^A-Za-z0-9_.-]+", "_"), 1, most)


def safe_double(x: Column) -> Column:
    """A number, or null for blanks, words and NaN."""
    v = x.try_cast("double")
    return F.when(F.isnan(v), F.lit(None)).otherwise(v)


def score_sign(a: Column, b: Column, delta: Column) -> Column:
    d = a - b
    return F.when(d > delta, F.lit(1)).when(d < -delta, F.lit(-1)).otherwise(F.lit(0))
