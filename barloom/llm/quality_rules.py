"""Quality by learned decision lists (DataFrame functions only).

Statistics of a text are plain columns. Rules are learned by sequential covering from labelled statistics: a rule grows by the
threshold that gains most (information gain of the bad rows it keeps), is pruned on rows kept apart, is accepted when precise
enough there, and the rows it covers leave; learning ends when nothing gains or three rules in a row are refused. The list becomes one ordered ``when`` expression.

Each grow step counts (statistic, bin) cells of all labelled rows in Spark; only the cells (statistics x bins) reach the driver.

Defined results: null or empty text has no words and fails the base test; repeated rows are judged alike; null ids stay; labels that
are null or empty leave the base test alone; an empty table gives an empty result. Repeated windows are found by 64-bit hashes
of word triples inside one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, stage, text_of, words

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "line_words"]


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of a character class a text has."""
    return F.length(F.regexp_replace(text, f"[^{chars}]++", "")).cast("long")


def _covered(starts: Column) -> Column:
    """Words in three-word windows that begin at the sorted ``starts``."""
    steps = F.zip_with(F.slice(starts, F.lit(2), F.size(starts)), starts, lambda b, a: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return F.when(F.size(starts) == 0, 0).otherwise(F.aggregate(steps, F.lit(0), lambda s, x: s + x))


def statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with its statistics added under ``prefix``: those in ``BASE`` (long) and ``FEATURES`` (double)."""
    b = lambda name: f"_b_{name}"
    p = lambda name: prefix + name
    w, t = F.col(b("w")), F.col(b("t"))
    d = docs.withColumn(b("t"), text_of(F.col(text))).withColumn(b("w"), words(F.col(b("t")))).withColumn(b("n"), F.size(b("w")))
    d = d.withColumn(b("l"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
    windows = F.when(F.col(b("n")) >= 3, F.transform(F.sequence(F.lit(0), F.col(b("n")) - 3), window))
    d = d.withColumn(b("s"), F.coalesce(F.sort_array(windows), F.expr("cast(array() as array<struct<h:bigint,p:int>>)")))
    s = F.col(b("s"))
    same = lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
    d = d.withColumn(b("r"), F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"])))
    d = d.withColumns({
        p("n_words"): F.col(b("n")).cast("long"),
        p("word_chars"): F.length(F.array_join(w, "")).cast("long"),
        p("n_symbols"): count_chars(t, SYMBOLS),
        p("n_dup_lines"): (F.size(b("l")) - F.size(F.array_distinct(b("l")))).cast("long"),
        p("n_repeat_words"): _covered(F.col(b("r"))).cast("long"),
        b("upper"): count_chars(t, r"\p{Lu}"), b("marks"): count_chars(t, "!?"), b("digits"): count_chars(t, "0-9"), b("lines"): F.size(b("l")),
    })
    share = lambda a, c: F.when(F.col(c) > 0, F.col(a) / F.col(c)).otherwise(0.0)
    d = d.withColumns({
        p("word_length"): share(p("word_chars"), p("n_words")), p("symbol_share"): share(p("n_symbols"), p("n_words")),
        p("dup_line_share"): share(p("n_dup_lines"), b("lines")), p("repeat_share"): share(p("n_repeat_words"), p("n_words")),
        p("upper_share"): share(b("upper"), p("word_chars")), p("mark_share"): share(b("marks"), p("n_words")),
        p("digit_share"): share(b("digits"), p("word_chars")), p("line_words"): share(p("n_words"), b("lines")),
    })
    return d.drop(*[b(x) for x in ("t", "w", "n", "l", "s", "r", "upper", "marks", "digits", "lines")])


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


PREFIX = "_b_q_"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its statistics under ``PREFIX``, as a table in the shared folder: learning reads the narrow columns of it, judging reads all,
    and texts are taken apart once and never shuffled."""
    return stage(statistics(docs, text, PREFIX), "measured")


def plain_statistics(table: DataFrame, *keys: str) -> DataFrame:
    """The keys and the statistics of a ``measured`` table, under their own names."""
    return table.select(*keys, *[F.col(PREFIX + x).alias(x) for x in BASE + FEATURES])


Condition = tuple[str, str, float]  # statistic, "<=" or ">", threshold


def holds(rule: list[Condition], prefix: str = "") -> Column:
    out = F.lit(True)
    for name, op, at in rule:
        c = F.col(prefix + name)
        out = out & ((c <= at) if op == "<=" else (c > at))
    return out


class DecisionList:
    """Ordered conjunctions of thresholds; a row that meets one is bad, any other is good."""

    def __init__(self, rules: list[list[Condition]]):
        self.rules = rules

    def good(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(holds(rule, prefix), False).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join("bad if " + " and ".join(f"{n} {op} {at:.6g}" for n, op, at in r) for r in self.rules)


def kept_rows(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base test and the list, with all their columns, in one pass and without a shuffle.

    The partition number is there because a filter is not pushed below a projection that has it: pushed down, the statistics
    would be written out again for each of their uses, inside lambdas for each word.
    """
    judged = statistics(docs, text, PREFIX).withColumn("_b_part", F.spark_partition_id())
    return passing(judged.filter("_b_part >= 0"), rules).select(*docs.columns)


def passing(table: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of a ``measured`` table that pass the base test and the list, without the statistics."""
    return table.filter(~base_failed(PREFIX) & rules.good(PREFIX)).drop(*[PREFIX + x for x in BASE + FEATURES])


def learn(
    labelled: DataFrame, bad: str, key: Column, bins: int = 24, max_rules: int = 8, max_conditions: int = 4, min_precision: float = 0.95,
    min_rows: int = 3, features: list[str] | None = None,
) -> DecisionList:
    """Learn a list from all labelled rows. ``bad``: 0/1 column. ``key``: hashed to set a third of the rows apart for pruning."""
    features = features or FEATURES
    rows = labelled.select(*features, F.col(bad).cast("int").alias("_b_bad"), (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("_b_apart"))
    rows = stage(rows.filter("_b_bad is not null"), "labelled")
    grow, apart = rows.filter(~F.col("_b_apart")), rows.filter("_b_apart")
    at = [i / bins for i in range(1, bins)]
    of_bad = lambda f: F.percentile_approx(F.when(F.col("_b_bad") == 1, F.col(f)), at, 2000).alias(f"bad_{f}")
    cuts_row = grow.agg(*[F.percentile_approx(f, at, 2000).alias(f) for f in features], *[of_bad(f) for f in features]).first()
    cuts = {f: sorted({*(cuts_row[f] or []), *(cuts_row[f"bad_{f}"] or [])}) for f in features}
    rules: list[list[Condition]] = []
    failed = 0
    while len(rules) < max_rules and failed < 3:
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            best = _best_condition(grow.filter(holds(rule)), features, cuts)
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 1.0:
                break
        if not rule:
            break
        good_part = _pruned(rule, apart, min_precision, min_rows)
        if good_part:
            rules.append(good_part)
            apart = apart.filter(~holds(good_part))
        failed = 0 if good_part else failed + 1
        grow = grow.filter(~holds(good_part or rule))  # what a refused rule covers leaves too: other bad rows get their turn
    return DecisionList(rules)


def _best_condition(rows: DataFrame, features: list[str], cuts: dict[str, list[float]]) -> tuple[Condition, float] | None:
    """The threshold with the largest gain, and the share of bad rows it leaves."""
    cells = []
    for f in features:
        number = F.lit(0)
        for c in cuts[f]:
            number = number + F.when(F.col(f) > c, 1).otherwise(0)
        cells.append(F.struct(F.lit(f).alias("f"), number.alias("bin")))
    counted = rows.select(F.explode(F.array(*cells)).alias("c"), "_b_bad").groupBy("c.f", "c.bin").agg(F.sum("_b_bad"), F.count("*")).collect()
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for f, i, p, n in counted:
        table.setdefault(f, {})[i] = (p, n)
    best: tuple[float, Condition, float] | None = None
    for f in features:
        have = table.get(f, {})
        all_p, all_n = sum(p for p, _ in have.values()), sum(n for _, n in have.values())
        if not all_p or all_p == all_n:
            continue
        low_p = low_n = 0
        for i, c in enumerate(cuts[f]):
            p, n = have.get(i, (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for op, q, m in (("<=", low_p, low_n), (">", all_p - low_p, all_n - low_n)):
                if q and m < all_n:
                    gain = q * (math.log2(q / m) - math.log2(all_p / all_n))
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, (f, op, c), q / m)
    return (best[1], best[2]) if best and best[0] > 1e-9 else None


def _pruned(rule: list[Condition], apart: DataFrame, min_precision: float, min_rows: int) -> list[Condition]:
    """The prefix of the rule that is worth most on the rows set apart, if it is precise enough there."""
    if not rule:
        return []
    sums = []
    for i in range(1, len(rule) + 1):
        h = holds(rule[:i])
        sums += [F.sum(F.when(h, F.col("_b_bad"))), F.count(F.when(h, 1))]
    got = apart.agg(*sums).first()
    scored = [((2 * (got[2 * i] or 0) - got[2 * i + 1]) / got[2 * i + 1], -i, i) for i in range(len(rule)) if got[2 * i + 1] >= min_rows]
    if not scored:
        return []
    worth, _, i = max(scored)
    return rule[:i + 1] if (worth + 1) / 2 >= min_precision else []
