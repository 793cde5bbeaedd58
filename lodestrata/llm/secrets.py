"""Operator 11: secrets, and credentials whose parts lie apart, by DataFrame functions only.

Base kinds (assign, access, hex) are always reported. Weak candidates are parts of a credential
that alone mean little: account names and key identifiers (``identifier``), short or unnamed
secrets (``credential``), places to log in at (``endpoint``). They are reported only when
complementary parts co-occur: a secret with an identifier or an endpoint in its scope. A base span
is such a part too: an access key is an identifier, the other two are secrets. A weak candidate that
begins inside a base span is that span once more, and left out.

A secret's scope reaches ``REACH`` code points to both sides of it and ends at blank lines; a part
is in the scope that it begins in. Parts meet by an interval join: a secret is put in each cell of
``REACH`` code points that its scope touches, another part in the cell where it begins, and (row,
block, cell) is the key of an equi-join whose condition compares the intervals. Parts of a kind do
not overlap, so a cell holds a bounded number of them, however long the text.

Places come without Python: a text split at a pattern gives the pieces between its matches, and
running sums of lengths are the places of the matches. The parts found are written once to the
shared folder with a row number, so texts are scanned once and equal or null ids stay apart.

Defined results: a null text is empty; a null id stays null; repeated rows give repeated rows;
an empty table gives no rows; other columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import shared_path

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("identifier", "credential", "endpoint")
KINDS = BASE_KINDS + WEAK_KINDS
#: Kinds that hold a secret; the others say whose it is or where it is good for.
SECRETS = ("assign", "hex", "credential")
REACH = 240
#: Matches whose running sums are made in one go.
STEP = 256

_IS = r"[\"']?\x20*[:=]\x20*[\"']?"
_NAMED = r"(?i:password|passwd|secret|token|api_?key)"
PATTERNS = {
    # The first three are fixed by the contract.
    "assign": _NAMED + _IS + r"[A-Za-z0-9+/_.=-]+",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "identifier": r"(?:ASIA|AROA|AIDA)[A-Z0-9]{16,}|(?i:user(?:[_-]?name|[_-]?id)?|login|client[_-]?id|account[_-]?id|tenant[_-]?id|access[_-]?key[_-]?id)" + _IS + r"[A-Za-z0-9@._+-]{3,}",
    "credential": r"[a-z][a-z0-9+]{1,14}://[^\x09-\x0D\x20\"'<>:/@]+:[^\x09-\x0D\x20\"'<>@]+@[^\x09-\x0D\x20\"'<>]+"
    r"|(?i:pwd|pass|passphrase|auth|credentials?|private[_-]?key|secret[_-]?access[_-]?key|signature|token|password|passwd|secret|api[_-]?key)" + _IS + r"[^\x09-\x0D\x20\"',;:=]{4,}"
    r"|[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"[a-z][a-z0-9+]{1,14}://[^\x09-\x0D\x20\"'<>]{4,}|(?i:host|hostname|endpoint|server|database|bucket)" + _IS + r"[A-Za-z0-9._:/-]{3,}",
}
_LONG_RUN = r"^[A-Za-z0-9+/_-]+={0,2}$"
#: What a match has to satisfy besides; matches that fail are dropped, and not tried again.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "assign": lambda m: m.rlike("^" + _NAMED + _IS + "[A-Za-z0-9+/_.=-]{6}"),
    "access": lambda m: F.length(m) >= 20,
    "credential": lambda m: ~m.rlike(_LONG_RUN) | (m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")),
}
_BLANK = r"\n[ \t\r]*\n"
_PART = "struct<start:bigint,end:bigint,block:bigint,good:boolean>"


def _running(entries: Column) -> Column:
    """The places of matches from (before, blanks, size, good): each lies behind all that came earlier.

    Sums go on from step to step, ``STEP`` matches each, so that appending costs no more on long lists.
    """

    def state(at: Column, block: Column, out: Column) -> Column:
        return F.struct(at.alias("at"), block.alias("block"), out.alias("out"))

    def add(s: Column, m: Column) -> Column:
        start, block = s["at"] + m["before"], s["block"] + m["blanks"]
        place = F.struct(start.alias("start"), (start + m["size"]).alias("end"), block.alias("block"), m["good"].alias("good"))
        return state(start + m["size"], block, F.array_append(s["out"], place))

    def step(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, state(s["at"], s["block"], F.expr(f"cast(array() as array<{_PART}>)")), add)
        return F.transform(F.array(inner), lambda r: state(r["at"], r["block"], F.array_append(s["out"], r["out"])))[0]

    def steps(found: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int")), lambda k: F.slice(found, k * STEP + 1, F.lit(STEP)))
        return F.aggregate(parts, state(F.lit(0).cast("long"), F.lit(0).cast("long"), F.expr(f"cast(array() as array<array<{_PART}>>)")), step, lambda s: F.flatten(s["out"]))

    return F.transform(F.array(entries), steps)[0]


def places(text: Column, kind: str) -> Column:
    """The spans of a kind in a text, with the number of blank lines before them."""
    pattern, check = PATTERNS[kind], CHECKS.get(kind, lambda m: F.lit(True))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), matches.alias("match"))
    entries = F.transform(
        zipped,
        lambda z: F.struct(
            F.length(z["piece"]).cast("long").alias("before"),
            F.size(F.regexp_extract_all(z["piece"], F.lit(_BLANK), F.lit(0))).cast("long").alias("blanks"),
            F.coalesce(F.length(z["match"]), F.lit(0)).cast("long").alias("size"),
            F.coalesce(check(z["match"]) & z["match"].isNotNull(), F.lit(False)).alias("good"),
        ),
    )
    number = KINDS.index(kind)
    kept = F.transform(F.filter(_running(entries), lambda p: p["good"]), lambda p: F.struct(p["start"].alias("start"), F.lit(number).alias("kind"), p["end"].alias("end"), p["block"].alias("block")))
    return F.when(text.rlike(pattern), kept).otherwise(F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,block:bigint>>)"))


def parts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, id, parts): all base spans and weak candidates of each row, written to the shared folder and read again."""
    path = shared_path(df.sparkSession, "secrets")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_column), F.concat(*[places(text, kind) for kind in KINDS]).alias("__parts"))
    found.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, weak): per row the weak candidates that belong to a credential, from ``parts``."""
    weak, secret = F.col("p.kind") >= len(BASE_KINDS), F.col("p.kind").isin([KINDS.index(k) for k in SECRETS])
    one = found.select("__row", F.explode("__parts").alias("p"))
    earlier = Window.partitionBy("__row").orderBy("p.start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn("covered", F.max(F.when(~weak, F.col("p.end"))).over(earlier)).filter(~weak | F.col("covered").isNull() | (F.col("covered") <= F.col("p.start")))
    cells = F.sequence(F.floor(F.greatest(F.col("p.start") - reach, F.lit(0)) / reach), F.floor((F.col("p.end") + reach) / reach))
    secrets = one.filter(secret).select("__row", F.col("p.block").alias("block"), F.explode(cells).alias("cell"), F.col("p").alias("secret"))
    others = one.filter(~secret).select("__row", F.col("p.block").alias("block"), F.floor(F.col("p.start") / reach).alias("cell"), F.col("p").alias("other"))
    near = (F.col("other.start") >= F.col("secret.start") - reach) & (F.col("other.start") <= F.col("secret.end") + reach)
    pairs = secrets.join(others, ["__row", "block", "cell"]).filter(near)
    ends = pairs.select("__row", F.explode(F.array("secret", "other")).alias("p")).filter(weak).distinct()
    return ends.groupBy("__row").agg(F.collect_list("p").alias("__weak"))


def find_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH) -> DataFrame:
    """Per row the id and ``spans``, an array of (start, kind, end) by start, then kind as listed in ``KINDS``; code points, end exclusive."""
    found = parts(df, id_column, text_column)
    base = F.filter("__parts", lambda p: p["kind"] < len(BASE_KINDS))
    numbers = [KINDS.index(k) for k in SECRETS]
    meets = F.exists("__parts", lambda p: p["kind"] >= len(BASE_KINDS)) & F.exists("__parts", lambda p: p["kind"].isin(numbers)) & F.exists("__parts", lambda p: ~p["kind"].isin(numbers))
    alone = found.filter(~meets).select(id_column, base.alias("spans"))
    some = found.filter(meets)
    joined = some.join(linked(some, reach), "__row", "left").select(id_column, F.concat(base, F.coalesce("__weak", F.array())).alias("spans"))
    names = F.array(*map(F.lit, KINDS))
    ordered = F.transform(F.array_sort("spans"), lambda p: F.struct(p["start"].alias("start"), names[p["kind"]].alias("kind"), p["end"].alias("end")))
    return alone.unionByName(joined).select(id_column, ordered.alias("spans"))


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The result columns of the registered query, from ``find_secrets``."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        id_column, *counts, F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
