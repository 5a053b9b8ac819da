"""Quality rules as one Spark projection.

A threshold table (:data:`RULES`) of length, symbol, stop-word and line ratios is
compiled into Boolean columns over a handful of per-document counts.  Everything
is built-in SQL expressions: no user function, no shuffle, no second pass, so the
cost is linear in the bytes read and a hot source or a long text changes nothing
but its own row.

Defined results
---------------
* null text: no words, every count 0, ``base_failed`` true.
* empty text: as null.
* ties, repeated rows: rows are judged alone, so copies get equal verdicts.
* extra columns: left out unless named in ``keep``; the counts are computed from
  a renamed copy of the text, so no input name can clash.
* empty table: empty result with the same schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "for", "it", "was", "on", "are", "as", "by",
    "der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "ein", "eine", "nicht", "des", "im", "auf",
    "le", "la", "les", "de", "du", "et", "un", "une", "est", "que", "dans", "pour", "en", "par", "sur", "au",
    "el", "los", "las", "del", "y", "por", "con", "para", "una", "se", "su", "no",
)


@dataclass(frozen=True)
class Rule:
    """A document passes while ``low * per <= scale * metric`` and
    ``scale * metric <= high * per``; whole numbers, so every engine agrees.
    ``per`` is a count column or 1; a missing bound is not checked."""

    name: str
    metric: str
    per: str | None = None
    low: int | None = None
    high: int | None = None
    scale: int = 1


#: Production thresholds.  Lengths in words, ratios in hundredths.
RULES = (
    Rule("length", "n_words", low=50, high=10_000_000),
    Rule("mean_word_length", "word_chars", per="n_words", low=2, high=20),
    Rule("symbols", "n_symbols", per="n_words", high=10, scale=100),
    Rule("exclamations", "n_exclamations", per="n_words", high=20, scale=100),
    Rule("stop_words", "n_stop_words", low=1),
    Rule("duplicate_lines", "n_dup_lines", per="n_lines", high=40, scale=100),
    Rule("repeated_words", "n_repeat_words", per="n_words", high=50, scale=100),
)


def compile_rule(rule: Rule) -> Column:
    """The rule as a Boolean column, true where the document passes."""
    value = F.col(rule.metric) * F.lit(rule.scale)
    unit = F.col(rule.per) if rule.per else F.lit(1)
    checks = []
    if rule.low is not None:
        checks.append(value >= unit * F.lit(rule.low))
    if rule.high is not None:
        checks.append(value <= unit * F.lit(rule.high))
    if not checks:
        return F.lit(True)
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def _sql_text(chars: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04X}" if ord(c) < 33 else c for c in chars) + "'"


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts that rules refer to, one row per input row.

    ``n_repeat_words`` counts the words under three-word windows that occur twice
    or more in the text.  Windows are keyed by a hash with the window's place in
    its low bits and sorted as plain longs; only windows whose hash has a
    neighbour are then compared by their words, so the count is exact.
    """
    stops = sorted({f for s in STOP_WORDS for f in (s, s.capitalize())})
    quoted = ", ".join(f"'{s}'" for s in stops)
    base = df.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("t"))
    words = base.select("*", F.expr(rf"split(trim(BOTH {_sql_text(SPACES)} FROM t), '[\\x20\\x09-\\x0D]+', -1)").alias("w0"), F.expr(r"split(t, '\n', -1)").alias("ls"))
    words = words.select("*", F.expr("if(get(w0, 0) = '', cast(array() as array<string>), w0)").alias("w"))
    # b bits hold a window's place
    keyed = words.withColumn("b", F.expr("length(bin(size(w)))")).withColumn(
        "h",
        F.expr(
            """if(size(w) >= 3,
                  sort_array(transform(sequence(0, size(w) - 3),
                    i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b) | i)),
                  cast(array() as array<bigint>))"""
        ),
    )
    near = keyed.withColumn(
        "ks", F.expr("if(size(h) >= 2, filter(sequence(0, size(h) - 2), k -> shiftright(get(h, k) ^ get(h, k + 1), b) = 0), cast(array() as array<int>))")
    ).withColumn(
        "c", F.expr("array_distinct(transform(concat(ks, transform(ks, k -> k + 1)), k -> cast(get(h, k) & (shiftleft(1L, b) - 1) as int)))")
    )
    same = near.withColumn(
        "e", F.expr("sort_array(transform(c, i -> struct(concat_ws(' ', slice(w, i + 1, 3)) as g, i as i)))")
    ).withColumn(
        "p",
        F.expr(
            """sort_array(transform(
                 filter(e, (x, k) -> coalesce(x.g = get(e, k + 1).g, false) or coalesce(x.g = get(e, k - 1).g, false)),
                 x -> x.i))"""
        ),
    )
    lines = r"filter(ls, x -> x rlike '[^\\x20\\x09-\\x0D]')"
    out = same.withColumn("lw", F.expr(lines)).select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr(r"cast(length(t) - regexp_count(t, '[\\x20\\x09-\\x0D]') as bigint)").alias("word_chars"),
        F.expr(f"cast(regexp_count(t, '[{SYMBOLS}]') as bigint)").alias("n_symbols"),
        F.expr("cast(length(t) - length(replace(t, '!', '')) as bigint)").alias("n_exclamations"),
        F.expr(f"cast(size(array_intersect(w, array({quoted}))) as bigint)").alias("n_stop_words"),
        F.expr("cast(size(lw) as bigint)").alias("n_lines"),
        F.expr("cast(size(lw) - size(array_distinct(lw)) as bigint)").alias("n_dup_lines"),
        F.expr("cast(aggregate(p, struct(0 as n, -3 as last), (a, x) -> struct(a.n + least(3, x - a.last) as n, x as last), a -> a.n) as bigint)").alias("n_repeat_words"),
    )
    return out


def quality_rules(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, one Boolean column ``pass_<rule>`` per rule, ``base_failed`` and
    ``kept`` (no base failure and all rules passed)."""
    m = measures(df, text, keep)
    m = m.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    m = m.select("*", *[compile_rule(r).alias(f"pass_{r.name}") for r in rules])
    kept = ~F.col("base_failed")
    for r in rules:
        kept = kept & F.col(f"pass_{r.name}")
    return m.withColumn("kept", kept)
