"""Personal data by bootstrapped contextual extraction.

Base matches (addresses, numbers) of four kinds are found by their patterns and
are the seeds. The one or two words in front of a seed are a lexical pattern, in
which values in front of it are marks and a list of values is one mark.
Identifier-like tokens are the instances that patterns point to: five or more
ASCII letters, digits and ``._@:/#+-`` of any length, beginning with a letter or
digit, three digits or more, behind a blank, a quote, a bracket or one of
``,;|=``. Patterns and instances form a graph, and the
seeds grow over it in ``ROUNDS`` rounds: a pattern's confidence is the share of
seeds among its different instances, and it is accepted when that is high and
its lower confidence bound at least ``MIN_BOUND`` (both are shares, so a larger
corpus does not loosen them). The instances of accepted patterns become seeds
for the patterns not yet accepted, so no pattern is supported by its own finds.
An accepted value is reported as kind ``found`` wherever it is an instance.

Per text only matches and their contexts are kept, so the graph's tables are
small; hot patterns and values are aggregated before they are shuffled.

Cases: null text is empty; a token that touches a base match is no instance;
one that stands first in its text has no pattern; repeated rows give equal
rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import materialise
from fleetlake.llm.spans import MARK, apart, join_rows, keyed, matches, replaced

KINDS = ("email", "ip", "card", "phone")
# The kinds' patterns, written so that no repetition backtracks; a match starts at a run's
# first character, or where the match before it ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# A token of five characters or more with at least three digits, letters, digits and marks only, at the start of the
# text or behind a blank or a separator.
TOKEN = (
    r"""(?<![^\s,;|=()\[\]{}<>"'])(?=(?:[A-Za-z._@:/#+-]*+[0-9]){3})[A-Za-z0-9][A-Za-z0-9._@:/#+-]{4,}+"""
)
# What a context names only as a mark: whatever may be a match of some kind, and other digits.
VALUE = rf"{EMAIL}|{PHONE}|{TOKEN}|[0-9]++"

ROUNDS = 3
MIN_CONFIDENCE = 0.8
# Evidence: the one-sided 95% lower bound of a pattern's share of seeds.
MIN_BOUND = 0.5
Z = 1.645
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits holds."""
    turned = F.reverse(digits)

    def part(i: Column) -> Column:
        d = F.substring(turned, i + 1, F.lit(1)).cast("int")
        twice = F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part), F.lit(0), lambda a, b: a + b
    )
    return total % 10 == 0


def _card_holds(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(16, 19) & luhn(F.substring(digits, 1, 19))


def _context(before: Column) -> Column:
    """The one or two words that end at a match, values as marks and lists of values as one; null without a word."""
    marked = F.regexp_replace(before, VALUE, MARK)
    short = F.regexp_replace(marked, rf"{MARK}(?:[^\p{{L}}\p{{N}}{MARK}]*+{MARK})++", MARK)
    words = F.filter(F.split(F.lower(short), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), 2), " "))


def find_matches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, the spans of each base kind, and ``tokens``; all with value and context."""
    rows = keyed(docs)
    text = F.col("text")
    number = F.lit(True)
    spans = {
        "email": matches(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(
            matches(text, IP, number),
            lambda s: F.forall(F.split(s["value"], r"\."), lambda p: p.rlike(BYTE)),
        ),
        "card": F.filter(matches(text, CARD, number), lambda s: _card_holds(s["value"])),
        "phone": F.filter(
            matches(text, PHONE, F.contains(text, F.lit("+"))),
            lambda s: F.length(_digits(s["value"])).between(8, 15),
        ),
        "tokens": matches(text, TOKEN, number),
    }

    def compact(found: Column) -> Column:
        return F.transform(
            found,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                _context(s["before"]).alias("context"),
            ),
        )

    return rows.select("doc_id", "text_key", *[compact(c).alias(k) for k, c in spans.items()])


def _edges(found: DataFrame) -> DataFrame:
    """``pattern``, ``value``, ``seed``: different contexts of different values."""
    base = F.concat(*[F.col(k) for k in KINDS])
    tagged = F.concat(
        F.transform(base, lambda s: F.struct(s["context"].alias("pattern"), s["value"].alias("value"), F.lit(1).alias("seed"))),
        F.transform(
            F.col("fresh"), lambda s: F.struct(s["context"].alias("pattern"), s["value"].alias("value"), F.lit(0).alias("seed"))
        ),
    )
    return (
        found.select(F.explode(tagged).alias("e"))
        .select("e.*")
        .filter("pattern IS NOT NULL")
        .groupBy("pattern", "value")
        .agg(F.max("seed").alias("seed"))
    )


def _bound(mean: Column, n: Column) -> Column:
    """Lower end of the Wilson interval of a mean of ``n`` scores in 0..1."""
    z2 = F.lit(Z * Z)
    middle = mean + z2 / (2 * n)
    half = Z * F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) / n + z2 / (4 * n * n))
    return (middle - half) / (1 + z2 / n)


def confident_patterns(
    edges: DataFrame, rounds: int = ROUNDS, min_bound: float = MIN_BOUND, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """``pattern``, ``confidence`` of the patterns accepted within ``rounds`` rounds.

    After each round the values of accepted patterns join the seeds, and the
    support of the other patterns is counted anew. An accepted pattern stays
    so with the confidence it was accepted with; a pattern that is scored is
    not yet accepted, so none of its seeds is its own find.
    """
    scored = edges
    accepted = None
    for _ in range(rounds):
        made = (
            scored.groupBy("pattern")
            .agg(F.count("*").alias("n"), F.avg("seed").alias("confidence"))
            .filter((F.col("confidence") >= min_confidence) & (_bound(F.col("confidence"), F.col("n")) >= min_bound))
            .select("pattern", "confidence")
        )
        if accepted is not None:
            made = accepted.unionByName(made.join(accepted, "pattern", "left_anti"))
        accepted = materialise(made, "patterns")
        found = accepted_values(edges, accepted).withColumn("known", F.lit(1))
        scored = edges.join(found, "value", "left").withColumn("seed", F.greatest("seed", F.coalesce("known", F.lit(0))))
    return accepted


def accepted_values(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """``value`` of every instance of ``patterns``."""
    return edges.join(patterns.select("pattern"), "pattern", "left_semi").select("value").distinct()


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``text_key``, ``base`` and ``spans`` (kind, start, end; by kind, then start) of every row."""
    base = F.concat(*[F.col(k) for k in KINDS])
    found = materialise(find_matches(docs), "personal-matches").withColumn(
        "fresh",
        apart(F.col("tokens"), base),
    )
    edges = materialise(_edges(found), "pattern-edges")
    values = accepted_values(edges, confident_patterns(edges, **options))
    added = (
        found.filter(F.size("fresh") > 0)
        .select("doc_id", "text_key", F.explode("fresh").alias("t"))
        .select("doc_id", "text_key", "t.start", "t.end", "t.value")
        .distinct()
        .join(values, "value", "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("added"))
    )

    def of_kind(spans: Column, kind: str) -> Column:
        return F.transform(
            spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        )

    plain = F.concat(*[of_kind(F.col(k), k) for k in KINDS]).cast(_SPANS)
    joined = join_rows(found.select("doc_id", "text_key", plain.alias("base")), added, "left")
    more = F.coalesce(of_kind(F.col("added"), "found").cast(_SPANS), F.array().cast(_SPANS))
    return joined.select("doc_id", "text_key", "base", F.concat("base", more).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars`` of the new text where there is one."""
    found = personal_data(docs, **options).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    by_start = F.array_sort(
        F.transform(
            "spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        )
    )
    found = found.select(F.col("doc_id").alias("span_id"), F.col("text_key").alias("span_key"), by_start.alias("spans_by_start"))
    text = docs["text"]
    same = docs["doc_id"].eqNullSafe(F.col("span_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("span_key"))

    clean = replaced(
        text, F.col("spans_by_start"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    )
    changed = F.col("spans_by_start").isNotNull()
    new = {"text": F.when(changed, clean).otherwise(text)}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(changed, F.length(clean).cast(kind)).otherwise(docs["n_chars"])
    joined = docs.join(found, same, "left")
    return joined.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])
