"""Operator 6: quality rules as a learned decision list. DataFrame operations only.

Statistics of every text are Spark expressions inside the row: no shuffle, no Python. A decision
list is learned by sequential covering on a bounded sample of labelled rows (``TRAIN_ROWS``, chosen
by a hash of the id) that pass the base rule: grow a conjunction of thresholds by information gain on
two thirds, prune it on the rest, keep it if its precision there is high, remove what it covers,
repeat. The third that prunes moves on with every try, so few labels serve for both, and learning
ends when each third has refused a rule in a row. The list comes out as one ordered Spark
conditional expression that names the rule that rejects a row, if any.

Repeated three-word windows are found by sorting 64-bit hashes of a text's windows with their
places; windows with an equal neighbour are repeated, and the union of their words is counted.

Defined results: a null text is an empty one, without words, and fails the base rule. A null id
keeps its row. Without labelled rows the list is empty and only the base rule rejects.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD_SPACE_CLASS, checkpoint, hash_sample

TRAIN_ROWS = 4000
QUANTILES = 40
MAX_RULES = 8
MAX_LITERALS = 3
MIN_PRECISION = 0.97
#: Bad rows that a literal covers where it is grown, and that a rule covers where it is pruned, at least.
MIN_COVER, MIN_PROOF = 4, 2
FOLDS = 3
#: The rule that every row has to pass before the learned ones. Fixed by the contract.
BASE_RULE = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "line_share": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaims / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "n_words": "n_words",
}


def statistics(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row the id, the kept columns and the counts of its text, all long."""
    held = [id_column, *keep]
    rows = df.select(*held, F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    rows = rows.select(
        *held,
        F.length("t").cast("long").alias("n_chars"),
        F.expr(r"cast(regexp_count(t, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        F.expr(r"cast(regexp_count(t, '\\p{Lu}') as bigint)").alias("n_capitals"),
        F.expr("cast(regexp_count(t, '!') as bigint)").alias("n_exclaims"),
        F.split("t", WORD_SPACE_CLASS, -1).alias("pieces"),
        F.filter(F.split("t", "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
    )
    held += ["n_symbols", "n_capitals", "n_exclaims"]
    rows = rows.select(
        *held,
        (F.col("n_chars") - F.size("pieces") + 1).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array_remove("pieces", "").alias("words"),
    )
    held += ["word_chars", "n_lines", "n_dup_lines"]
    hashes = F.expr("slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, greatest(size(words) - 2, 0))")
    rows = rows.select(*held, F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), hashes.alias("h"))
    held += ["n_words", "n_distinct"]
    placed = F.expr("if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x as x, i as i))), array())")
    rows = rows.select(*held, placed.alias("s"))
    again = F.expr("filter(s, (e, k) -> (k > 0 and get(s, k - 1).x = e.x) or get(s, k + 1).x <=> e.x)")
    rows = rows.select(*held, F.sort_array(F.transform(again, lambda e: e["i"])).alias("p"))
    covered = "aggregate(p, struct(0 as n, -3 as last), (a, i) -> struct(a.n + least(3, i - a.last) as n, i as last)).n"
    rows = rows.select(*held, F.expr(f"cast({covered} as bigint)").alias("n_repeat_words"))
    # through a generator, as Spark would push a later filter on a count (say on ``kept``) into these
    # projections and compute a text's words anew for every word of it
    counts = [c for c in rows.columns if c not in (id_column, *keep)]
    return rows.select(id_column, *keep, F.explode_outer(F.array(F.struct(*counts))).alias("__counts")).select(id_column, *keep, "__counts.*")


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Literal, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The text of the first rule that covers a row, as an ordered conditional expression; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(holds(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: DataFrame, cuts: dict[str, list[float]], taken: Rule) -> tuple[float, Literal, int, int] | None:
    """The literal of the highest gain over rows (bad, and the bin of each feature), from one small histogram."""
    names = list(FEATURES)
    bins = F.posexplode(F.array(*[F.col(f"bin_{name}") for name in names])).alias("f", "b")
    counted = rows.select("bad", bins).groupBy("f", "b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    best = None
    for f, name in enumerate(names):
        own = {row["b"]: (row["p"], row["n"]) for row in counted if row["f"] == f}
        p0, n0 = (sum(x[i] for x in own.values()) for i in (0, 1))
        if not p0 or not n0:
            continue
        low_p = low_n = 0
        for b, threshold in enumerate(cuts[name]):
            low_p, low_n = low_p + own.get(b, (0, 0))[0], low_n + own.get(b, (0, 0))[1]
            for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                literal = Literal(name, above, threshold)
                gain = _gain(p, n, p0, n0)
                if p >= MIN_COVER and literal not in taken and gain > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, literal, p, n)
    return best


def learn(sample: DataFrame) -> list[Rule]:
    """A decision list for ``quality = 0`` from rows with statistics, ``quality`` and ``fold`` (0 to 2)."""
    exprs = [F.expr(e).cast("double").alias(name) for name, e in FEATURES.items()]
    values = sample.select(*exprs).agg(*[F.percentile_approx(name, [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias(name) for name in FEATURES]).first()
    if values is None or values[0] is None:
        return []
    cuts = {name: sorted(set(values[name])) for name in FEATURES}
    counts = [c for c in sample.columns if c not in ("quality", "fold")]
    bad = (F.col("quality") == 0).cast("int").alias("bad")
    bins = [sum(((F.expr(FEATURES[name]).cast("double") > cut).cast("int") for cut in cuts[name]), F.lit(0)).alias(f"bin_{name}") for name in FEATURES]
    table = checkpoint(sample.select(*counts, "fold", bad, *bins).coalesce(2))
    rules: list[Rule] = []
    left, fold, refused = table, 0, 0
    while len(rules) < MAX_RULES and refused < FOLDS:
        fold = (fold + 1) % FOLDS
        rule: Rule = ()
        rows = left.filter(F.col("fold") != fold)
        while len(rule) < MAX_LITERALS and (found := _best(rows, cuts, rule)):
            rule += (found[1],)
            rows = rows.filter(found[1].column())
            if found[3] == 0:
                break
        refused += 1
        if not rule:
            continue
        heads = [rule[: i + 1] for i in range(len(rule))]
        test = left.filter(F.col("fold") == fold).agg(*[F.sum(F.when(holds(h), x).otherwise(0)) for h in heads for x in (F.col("bad"), 1 - F.col("bad"))]).first()
        scored = [((test[2 * i] or 0), (test[2 * i + 1] or 0), h) for i, h in enumerate(heads)]
        p, n, rule = max(scored, key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), x[0], -len(x[2])))
        if p < MIN_PROOF or p / (p + n) < MIN_PRECISION:
            continue
        rule = _with_margin(rule, left.filter((F.col("bad") == 1) & holds(rule)))
        rules.append(rule)
        left, refused = left.filter(~holds(rule)), 0
    return rules


def _with_margin(rule: Rule, covered: DataFrame) -> Rule:
    """Thresholds halfway between where the gain set them and the bulk of the covered bad rows."""
    far = covered.agg(*[F.percentile_approx(F.expr(FEATURES[x.feature]).cast("double"), 0.05 if x.above else 0.95, 10_000) for x in rule]).first()
    return tuple(Literal(x.feature, x.above, (x.threshold + edge) / 2) for x, edge in zip(rule, far, strict=True))


def fit(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = TRAIN_ROWS) -> list[Rule]:
    """Learns from at most ``rows`` labelled ids, chosen by a hash of the id."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min("quality").alias("quality"))
    chosen = hash_sample(chosen, rows, id_column)
    joined = df.select(id_column, text_column).join(F.broadcast(chosen), id_column)  # ``rows`` rows of two numbers
    fold = F.pmod(F.xxhash64(id_column, F.lit("fold")), F.lit(FOLDS)).alias("fold")
    counted = statistics(joined, id_column, text_column, keep=("quality",)).filter(f"not ({BASE_RULE})")
    return learn(checkpoint(counted.select(*counted.columns, fold).drop(id_column)))


def judge(df: DataFrame, rules: list[Rule], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row the id, its statistics, ``base_failed``, ``rule`` (the rule that rejects it, or null) and ``kept``."""
    rows = statistics(df, id_column, text_column)
    rows = rows.withColumn("base_failed", F.expr(BASE_RULE))
    rows = rows.withColumn("rule", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def digest(judged: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The result columns of the registered query, from ``judge``."""
    return judged.select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
