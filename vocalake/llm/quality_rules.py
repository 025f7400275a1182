"""Quality rules: a threshold table compiled into Spark projections, without user functions.

A rule is a metric, a direction and a bound. compile_rules turns the table into one array column
that names the rules a text fails; Spark evaluates it in the projection that follows the metrics.
The metrics are lengths, symbol, stop-word, case and line ratios over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalake.llm.common import SPACE, SPACE_CHARS, WORD, text_of


@dataclass(frozen=True)
class Rule:
    """A text fails if its metric is below `least` or above `most`."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Common short words of the languages served; any text of prose has some. Fixed values.
STOP_WORDS = (
    "the and of to in is that for it on with as was at be by this are or from an have not but they which "
    "der die das und ist von zu den mit sich auf für nicht ein eine im auch es an werden "
    "le la les des et est une un dans que pour qui sur pas par avec plus au en de "
    "el los las y una por con para como más del se su al lo no"
).split()

#: The production table. Bounds are wide: a rule is to catch what is clearly no prose.
RULES = (
    Rule("word_length", "mean_word_chars", least=2.0, most=20.0),
    Rule("symbols", "symbol_ratio", most=0.2),
    Rule("exclamations", "exclamation_ratio", most=0.4),
    Rule("stop_words", "stop_word_ratio", least=0.01),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
    Rule("ellipsis_lines", "ellipsis_line_ratio", most=0.3),
    Rule("bullet_lines", "bullet_line_ratio", most=0.9),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row fails, in the table's order."""
    failed = []
    for rule in rules:
        metric = F.col(rule.metric)
        tests = [metric < rule.least] * (rule.least is not None) + [metric > rule.most] * (rule.most is not None)
        if not tests:
            raise ValueError(f"rule {rule.name} has no bound")
        failed.append(F.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(rule.name)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def _windows(hashes: str, size: int) -> Column:
    """Hashes of the runs of `size` words; none for shorter texts."""
    cut = [f"slice({hashes}, {k + 1}, size({hashes}) - {size - 1})" for k in range(size)]
    mixed = cut[-1]
    for part in reversed(cut[:-1]):
        mixed = f"zip_with({part}, {mixed}, (a, b) -> xxhash64(a, b))"
    return F.expr(f"CASE WHEN size({hashes}) >= {size} THEN {mixed} ELSE array() END")


def _packed(windows: str) -> Column:
    """Sorted longs of a window's hash above its position, for texts in which a window occurs twice.

    The position takes as many low bits as the text needs, so that plain longs are sorted.
    """
    return F.expr(
        f"CASE WHEN size(array_distinct({windows})) < size({windows}) THEN sort_array(zip_with({windows}, "
        f"sequence(0L, size({windows}) - 1L), (h, i) -> (h & (-shiftleft(1L, width))) | i)) ELSE array() END"
    )


def _repeated(windows: str, packed: str) -> Column:
    """Positions of windows that occur twice, in order; neighbours are compared by their whole hash."""
    at = "CAST({} & (shiftleft(1L, width) - 1) AS INT)"
    here, before, after = at.format("x"), at.format(f"{packed}[i - 1]"), at.format(f"{packed}[i + 1]")
    return F.expr(
        f"array_sort(transform(filter({packed}, (x, i) -> (i > 0 AND {windows}[{here}] = {windows}[{before}]) "
        f"OR (i < size({packed}) - 1 AND {windows}[{here}] = {windows}[{after}])), x -> {here}))"
    )


def measured(docs: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """docs' rows as struct `row`, with the counts and ratios that rules refer to.

    A window of words counts as repeated if its 64-bit hash occurs twice in the text; a false match
    has a chance of about n^2 / 2^65 for n words. Null texts count as empty: all counts are 0.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = docs.select(row, text_of(F.col(f"`{text}`")).alias("txt"))
    trimmed = F.btrim(F.col("txt"), F.lit(SPACE_CHARS))
    df = df.select(
        "row",
        "txt",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")).alias("words"),
        F.filter(F.split("txt", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    stop = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("txt", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("txt", F.lit("!")).cast("long").alias("n_exclamations"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•‣]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    df = df.withColumn("windows", _windows("hashes", window)).drop("hashes")
    df = df.withColumn("width", F.length(F.bin(F.size("windows"))))
    df = df.withColumn("packed", _packed("windows"))
    df = df.withColumn("at", _repeated("windows", "packed")).drop("windows", "packed", "width")
    # a repeated window covers its words up to the next repeated window
    df = df.withColumn(
        "n_repeat_words",
        F.expr(
            f"CASE WHEN size(at) = 0 THEN 0L ELSE aggregate(at, struct(0L AS total, -{window} AS last), (s, p) -> "
            f"struct(s.total + CAST(least({window}, p - s.last) AS BIGINT) AS total, p AS last), s -> s.total) END"
        ),
    ).drop("at")
    return df.select(
        "*",
        _ratio("word_chars", "n_words").alias("mean_word_chars"),
        _ratio("n_symbols", "n_words").alias("symbol_ratio"),
        _ratio("n_exclamations", "n_words").alias("exclamation_ratio"),
        _ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        _ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        _ratio("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
        _ratio("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
    )


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row with its counts, the rules it fails, base_failed and kept.

    Returns (row, counts..., failed array<string>, base_failed, kept). Null and empty texts have no
    word and fail the base; repeated rows are judged alike, each on its own; an empty table gives an
    empty table; other columns of docs stay inside `row`, so no name clashes.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = measured(docs, text).withColumn("failed", compile_rules(rules)).withColumn("base_failed", base)
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs' rows that the rules keep, in docs' columns.

    The test on the row number is always true; as it isn't deterministic, the optimizer leaves the
    filter above the metrics and doesn't copy their expressions into it.
    """
    judged = judge(docs, text, rules)
    return judged.select("row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("kept")).filter("kept").select("row.*")
