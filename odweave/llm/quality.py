"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a window; a window found twice makes all its words repeated ones.
_WINDOW = 5
# Frequent function words of the languages whose texts are expected.
STOP_WORDS = (
    "the of and to in is that it for with was on as by be this are or from an at not "
    "de la que el en y los las un una por con del se no lo su para "
    "le les des et une du est dans qui au pour sur pas par ce il "
    "der die und das den von zu mit sich dem nicht ein eine auf ist im für als auch"
).split()
# Characters that are no letter or mark of another script than Latin. Nothing up to U+024F is one, which most texts show at a glance.
_LATIN_END = "\u024F"
_NOT_OTHER = rf"[\x00-{_LATIN_END}\p{{IsLatin}}\p{{IsInherited}}[^\p{{L}}\p{{M}}]]+"


@dataclass(frozen=True)
class Rule:
    """``low`` <= 100 * part / whole <= ``high``, where the whole is at least ``at_least``; smaller wholes always pass.

    With ``where`` (part, whole, high) the rule judges only texts with 100 * part / whole <= high, and passes all others.
    """

    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    at_least: int = 1
    where: tuple[str, str, int] | None = None


#: Mean word length; symbols and capitals against letters; repeated lines against lines; function words against words, in texts
#: that are half or more in Latin letters, as all of the function words are. The text alone decides, never a label.
RULES = (
    Rule("word_chars", "n_words", low=200, high=1400),
    Rule("n_symbols", "word_chars", high=5),
    Rule("n_capitals", "word_chars", high=50, at_least=40),
    Rule("n_dup_lines", "n_lines", high=50, at_least=4),
    Rule("n_stop_words", "n_words", low=1, at_least=150, where=("n_other_letters", "word_chars", 50)),
)
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines", "n_stop_words", "n_other_letters"]


def _repeated(words: Column, hashes: Column) -> Column:
    """Words in windows found twice or more. Equal windows meet by sorting; most texts show by their hashes to have none."""
    last = F.size(words) - _WINDOW
    window = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.get(hashes, i).alias("h"), F.array_join(F.slice(words, i + 1, _WINDOW), " ").alias("s"), i.alias("i")),
    )

    def starts(found: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            return F.coalesce(x["s"] == F.get(found, j - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get(found, j + 1)["s"], F.lit(False))

        return F.sort_array(F.transform(F.filter(found, twice), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(_WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(_WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # A transform over an array of one element names its value for the expressions inside.
    sorted_starts = F.get(F.transform(F.array(F.sort_array(window)), starts), 0)
    return F.get(F.transform(F.array(sorted_starts), covered), 0)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``__m`` of the counts of the text."""
    text = F.coalesce(docs["text"], F.lit(""))
    step = docs.withColumn("__w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    w = F.col("__w")
    hashes = F.when(F.size(w) < _WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - _WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(_WINDOW))))
    )
    step = step.withColumn("__h", hashes).withColumn("__l", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    h, lines = F.col("__h"), F.col("__l")
    counts = [
        F.size(w), F.length(F.array_join(w, "")), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        F.size(lines) - F.size(F.array_distinct(lines)),
        F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_repeated(w, h)),
        F.length(F.regexp_replace(text, r"[^A-ZÀ-ÖØ-Þ]+", "")), F.size(lines),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        F.when(text.rlike(rf"[^\x00-{_LATIN_END}]"), F.length(F.regexp_replace(text, _NOT_OTHER, ""))).otherwise(F.lit(0)),
    ]
    named = [c.cast("bigint").alias(n) for n, c in zip(_COUNTS, counts, strict=True)]
    return step.withColumn("__m", F.struct(*named)).drop("__w", "__h", "__l")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Does a text pass the base rules and the table of thresholds?"""
    passed = ~base_failed(m)
    for r in rules:
        part, whole, ok = 100 * m[r.part], m[r.whole], F.lit(True)
        if r.low is not None:
            ok = ok & (part >= r.low * whole)
        if r.high is not None:
            ok = ok & (part <= r.high * whole)
        if r.where is not None:
            ok = ok | (100 * m[r.where[0]] > r.where[2] * m[r.where[1]])
        passed = passed & (ok | (whole < r.at_least))
    return passed


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, base_failed, kept.

    A missing text has no words and fails; a missing doc_id stays missing; repeated rows are judged one by one; an empty
    table gives no rows; other columns, labels too, are not read.
    """
    m = F.col("__m")
    rows = measured(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))).select("doc_id", "__m")
    return rows.select("doc_id", *(m[c].alias(c) for c in _COUNTS), base_failed(m).alias("base_failed"), verdict(m, rules).alias("kept"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names.

    The counts go through a generator of one row: a filter right above them would be pushed below, each count worked out
    again wherever the verdict names it.
    """
    rows = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"))
    counted = measured(rows).select("row", F.explode(F.array("__m")).alias("m"))
    return counted.filter(verdict(F.col("m"), rules)).select("row.*")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """What ``assess`` gives for the table documents (with unique doc_ids), in DuckDB's SQL."""
    checks = ["not base_failed"]
    for r in rules:
        parts = [f"100 * {r.part} >= {r.low} * {r.whole}"] * (r.low is not None) + [f"100 * {r.part} <= {r.high} * {r.whole}"] * (r.high is not None)
        beyond = f" or 100 * {r.where[0]} > {r.where[2]} * {r.where[1]}" if r.where else ""
        checks.append(f"(({' and '.join(parts)}) or {r.whole} < {r.at_least}{beyond})")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    other = r"[\x00-\x{24F}\p{Latin}\p{Inherited}]|[^\p{L}\p{M}]"
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '{WORD}') as ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from t),
v as (select doc_id, i, array_to_string(ws[i:i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from w)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from v) where n > 1),
c as (select doc_id, sum(least(5, gap)) as n from
  (select doc_id, coalesce(lead(i) over (partition by doc_id order by i) - i, 5) as gap from r) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words, length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::bigint as n_capitals,
  len(ls)::bigint as n_lines, len(list_filter(ws, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
  length(regexp_replace(text, '{other}', '', 'g'))::bigint as n_other_letters
  from w left join c on c.doc_id = w.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select *, {' and '.join(checks)} as kept from b"""
