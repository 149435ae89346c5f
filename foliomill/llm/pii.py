"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Six kinds: email, ip, card (Luhn), phone, iban (mod 97) and secret (a run of letters and digits in
hexadecimal or base 64). Matches are leftmost and do not overlap within a kind; one that fails its
validator is dropped and not retried shorter. Each span has a score: a prior by kind, raised where
a word that speaks for the kind stands within ``context_chars`` characters on either side, lowered
by a word that speaks against it; context does not reach past the next match of the kind. A span
with a checksum or a fixed form (the first four kinds) is always kept; an IBAN or a secret must
also reach ``min_score``, which a secret does only by its context.

Positions count code points from 0, end exclusive. Built-in functions only: ``split`` gives the
text between matches, ``regexp_extract_all`` the matches, running sums of lengths the positions.
Patterns are possessive and start only where a run starts, so long runs cost linear time, as do
many matches. A text without the characters a kind needs is not searched for it.

Edge cases: null text counts as empty; repeated rows each give a row; no span gives the hash of
the empty string and an empty ``spans``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import matches_of
from .common import table

LOCAL = r"[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """``needs`` is a cheap test that any text with a match passes; ``group`` 0 is the whole match."""

    name: str
    needs: str
    pattern: str
    prior: float
    speaks_for: str
    speaks_against: str = ""
    always: bool = True


# Fixed patterns; where a run may only be entered at its start, or where the last match ended, the match is the same and the cost linear.
# A card is a whole run of digits with at most one space or hyphen between two; runs of other lengths than 14 to 19 would be dropped anyway.
KINDS = (
    Kind("email", r"@", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"e-?mail|contact|mailto|write|correo|courriel", r"example|noreply"),
    Kind("ip", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.7, r"\bip\b|address|host|server|login", r"version|section|release|chapter"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13}", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", 0.7, r"card|visa|master|credit|carte|karte|tarjeta", r"order|tracking|isbn|serial"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, r"tel|phone|call|mobile|fax|anruf", r"order|id"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[ ]?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.6, r"iban|bank|konto|account|compte|cuenta", r"serial|licen[sc]e|model", always=False),
    Kind("secret", r"[A-Za-z0-9+/_-]{24}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,200}+(?![A-Za-z0-9+/_-])", 0.4, r"token|secret|password|passwd|api.?key|access.?key|credential", r"sha-?[0-9]+|checksum|digest|commit", always=False),
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d, i: F.when((n - i) % 2 == 1, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN without spaces has remainder 1: first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97)) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        # leading zeros aside, a part has at most three digits
        return F.forall(F.split(match, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(match, r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255
        )
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.translate(match, " ", "")
        return F.length(plain).between(15, 34) & mod97(plain)
    if kind == "secret":
        return F.length(digits).between(4, F.length(match) - 4)
    return F.lit(True)


def find_kind(kind: Kind, order: int, text: Column, context_chars: int, min_score: float) -> Column:
    """Array of spans of one kind: start, end, order, kind, match, score."""
    confirmed = F.filter(matches_of(text, kind.pattern, kind.needs), lambda x: valid(kind.name, x["m"]))

    def scored(x: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.right(x["left"], F.lit(context_chars)), F.left(x["right"], F.lit(context_chars))))
        score = F.lit(kind.prior) + F.when(near.rlike(kind.speaks_for), 0.3).otherwise(0.0)
        if kind.speaks_against:
            score = score - F.when(near.rlike(kind.speaks_against), 0.3).otherwise(0.0)
        return F.struct(
            x["s"].alias("start"), F.lit(order).alias("rank"), x["e"].alias("end"), F.lit(kind.name).alias("kind"), x["m"].alias("match"), F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3).alias("score")
        )

    spans = F.transform(confirmed, scored)
    if not kind.always:
        spans = F.filter(spans, lambda x: x["score"] >= min_score)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,match:string,score:double>>")
    return F.coalesce(spans, empty)


def find_spans(docs: DataFrame, text_col: str = "text", context_chars: int = 40, min_score: float = 0.6) -> DataFrame:
    """``docs`` with ``spans``: array of (start, rank, end, kind, match, score), ordered by start, then kind as listed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_text", text)
    parts = [f"_{k.name}" for k in KINDS]
    df = df.withColumns({p: find_kind(k, i, F.col("_text"), context_chars, min_score) for i, (p, k) in enumerate(zip(parts, KINDS, strict=True))})
    return df.withColumn("spans", F.sort_array(F.concat(*parts))).drop("_text", *parts)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["rank"] < 4)
    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores")
    return found.select(
        "doc_id", *[of(k.name) for k in KINDS[:4]], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *[of(k.name) for k in KINDS[4:]], F.size("spans").cast("long").alias("n_spans"), scores
    )
