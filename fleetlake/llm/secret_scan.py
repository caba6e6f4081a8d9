"""Secret scans with multipart credential linking.

Strong secrets are found by their own patterns. Other parts are weak: account
names, key ids, hosts, short labelled values, unlabelled random strings. A weak
part says little alone, but a secret next to its identifier or endpoint can be
used. Each part has a role (identifier, secret, endpoint); an interval join
finds parts of different roles whose texts lie within ``SCOPE`` code points,
and only parts so linked are reported. Strong matches take part in the join
and are always reported.

The join is an equi-join on row and block of ``SCOPE`` code points (each part
meets its own and the neighbouring blocks), so a long text with many parts is
split by block.

Cases: null text is empty and has no spans; a weak part inside a strong match
is not reported again; repeated rows give equal rows; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlake.llm.common import materialise
from fleetlake.llm.spans import join_rows, keyed, matches, outside

SCOPE = 200

# Strong patterns, in the order they are listed in results.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
STRONG = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ROLE_OF_STRONG = {"assign": "secret", "access": "identifier", "hex": "secret"}

# Weak parts: labelled values by role, addresses, and unlabelled strings that mix cases and digits.
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
IDENTIFIER = rf"(?i:user_?name|user_?id|user|login|account|client_?id|access_?key_?id|access_?key|key_?id){_VALUE}[A-Za-z0-9._@+-]{{3,}}"
ENDPOINT = rf"(?:[a-z][a-z0-9+.-]{{1,15}}://[A-Za-z0-9._~%/?=&:@-]+|(?i:host_?name|host|server|endpoint){_VALUE}[A-Za-z0-9.-]{{3,}}(?::[0-9]+)?)"
SECRET = rf"(?i:passphrase|pass|pwd|private_?key|auth_?key|auth|credentials?|signature){_VALUE}[A-Za-z0-9+/_.=-]{{6,}}"
# a whole run of any length; MIXED is tested on the run itself
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
WEAK = {"identifier": ("weak_id", IDENTIFIER), "endpoint": ("weak_endpoint", ENDPOINT), "secret": ("weak_secret", SECRET)}
LISTED = (*STRONG, *[kind for kind, _ in WEAK.values()], "weak_random")


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def find_parts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and an array of ``start``, ``end`` for each kind in ``LISTED``."""
    rows = keyed(docs)
    text, low = F.col("text"), F.lower("text")

    def any_of(words) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | F.contains(low, F.lit(word))
        return out

    assigned = matches(text, ASSIGN, any_of(ASSIGN_WORDS))
    labelled = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    found = rows.select(
        "doc_id",
        "text_key",
        "text",
        F.filter(assigned, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= 6).alias("assign"),
        matches(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        matches(text, HEX, F.length(text) >= 24).alias("hex"),
        matches(text, IDENTIFIER, labelled & any_of(("user", "login", "account", "client", "key"))).alias("weak_id"),
        matches(text, ENDPOINT, labelled & any_of(("://", "host", "server", "endpoint"))).alias("weak_endpoint"),
        matches(text, SECRET, labelled & any_of(("pass", "pwd", "key", "auth", "credential", "signature"))).alias(
            "weak_secret"
        ),
    )
    # unlabelled strings matter only beside another part that could complete them
    other = (F.size("access") > 0) | (F.size("weak_id") > 0) | (F.size("weak_endpoint") > 0)
    mixed = F.filter(
        matches(text, RANDOM, other),
        lambda s: s["value"].rlike(MIXED[0]) & s["value"].rlike(MIXED[1]) & s["value"].rlike(MIXED[2]),
    )
    return found.withColumn("weak_random", mixed).select(
        "doc_id", "text_key", *[_bare(F.col(k)).alias(k) for k in LISTED]
    )


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts with a part of another role within ``scope`` code points."""
    first = F.floor(F.col("start") / F.lit(scope)).cast("int")
    last = F.floor((F.col("end") - 1) / F.lit(scope)).cast("int")
    # a weak part meets the blocks from one before its start to one after its end
    weak = parts.filter("weak").withColumn("block", F.explode(F.sequence(first - 1, last + 1)))
    others = parts.withColumn("block", F.explode(F.sequence(first, last)))
    others = others.select(*[F.col(c).alias(f"o_{c}") for c in ("doc_id", "text_key", "role", "start", "end", "block")])
    near = (
        F.col("doc_id").eqNullSafe(F.col("o_doc_id"))
        & (F.col("text_key") == F.col("o_text_key"))
        & (F.col("block") == F.col("o_block"))
        & (F.col("role") != F.col("o_role"))
        & (F.col("o_start") - F.col("end") <= scope)
        & (F.col("start") - F.col("o_end") <= scope)
    )
    return weak.join(others, near, "left_semi").select("doc_id", "text_key", "kind", "start", "end").distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id``, ``text_key``, ``base`` and ``spans`` (arrays of kind, start, end, by start and kind) of every row."""
    found = materialise(find_parts(docs), "secret-parts")
    roles = ROLE_OF_STRONG | {kind: role for role, (kind, _) in WEAK.items()} | {"weak_random": "secret"}

    def tagged(kind: str) -> Column:
        return F.transform(
            F.col(kind),
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(roles[kind]).alias("role"),
                F.lit(kind not in STRONG).alias("weak"),
                s["start"].alias("start"),
                s["end"].alias("end"),
            ),
        )

    # only rows where two roles meet can link
    several = found.filter(" OR ".join(f"size({k}) > 0" for k in LISTED if k not in STRONG))
    parts = (
        several.select("doc_id", "text_key", F.explode(F.concat(*[tagged(k) for k in LISTED])).alias("p"))
        .select("doc_id", "text_key", "p.*")
        .distinct()
    )
    added = (
        _linked(parts, scope)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))
    )
    rank = F.create_map(*[x for i, k in enumerate(LISTED) for x in (F.lit(k), F.lit(i))])

    def ordered(spans: Column) -> Column:
        keyed_ = F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
        )
        return F.array_sort(keyed_)

    def strong(kind: str) -> Column:
        return F.transform(
            F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
        )

    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    base = F.concat(*[strong(k) for k in STRONG])
    joined = join_rows(found, added, "left").select(
        "doc_id",
        "text_key",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in STRONG],
        base.alias("strong"),
        F.coalesce("added", empty).alias("added"),
    )
    # a weak part that lies inside a strong match is the same thing
    fresh = outside(F.col("added"), F.col("strong"))
    return joined.select(
        "doc_id",
        "text_key",
        *[f"n_{k}" for k in STRONG],
        ordered(F.col("strong")).alias("base"),
        ordered(F.concat("strong", fresh)).alias("spans"),
    )
