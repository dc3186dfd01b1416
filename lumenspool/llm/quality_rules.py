"""Line-first quality rules, DataFrame functions only.

Each line of a text is judged by itself: navigation (separator tokens between words), boilerplate
(symbols stuck to words, shouted lines, stock phrases, a line seen before) and punctuation (a short
line that no sentence mark ends). Failing lines go; a document that keeps too small a share of its
characters is rejected, as is one that fails the base rules.

Defined cases: null text counts as empty; an empty text or one of blanks only has no words, fails
the base (too few words) and is not kept; ties and repeated rows are judged row by row; an empty
table gives an empty table. Extra columns of the input stay untouched in ``filter_documents`` and
are dropped by ``quality_report``; every working column has a ``_q_`` prefix and input columns that
clash with it are refused. Texts are read whole whatever their length; the work for a text of n
words is O(n log n).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Sentence marks that end a short line.
ENDINGS = ".!?:;,…\"'”’»)"
#: Stock phrases of web boilerplate, lower case.
PHRASES = (
    "accept all cookies",
    "all rights reserved",
    "click here to",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "privacy policy",
    "read more",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
)
_SPLIT = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class LineRules:
    """Production thresholds of the line rules."""

    min_words: int = 50  # base: fewer words fail
    max_repeat_percent: int = 50  # base: a larger share of repeated 3-word windows fails
    nav_separator_share: float = 0.2  # separators among a line's words
    symbol_share: float = 0.3  # symbols by words of a line
    shout_share: float = 0.3  # '!!' by words of a line
    phrase_words: int = 30  # stock phrases count in lines of at most so many words
    unended_words: int = 4  # lines of fewer words must end in a sentence mark
    max_lost: float = 0.5  # share of its lines' characters a document may lose


def _bind(value: Column, body) -> Column:
    """Evaluates value once and hands it to body as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _line_fails(line: Column, rules: LineRules) -> Column:
    # Bound once each: the trimmed line, its length in words (blanks plus one), its marks. Each of
    # the three rules on marks needs at least the lowest share of them, so most lines stop there.
    least = min(rules.nav_separator_share, rules.symbol_share, rules.shout_share)

    def judge(s: Column, n: Column, marks: Column) -> Column:
        navigation = F.regexp_count(s, F.lit(r"(?<= )[|>»·•](?= )")) >= n * rules.nav_separator_share
        symbols = F.regexp_count(s, F.lit(r"[#*$%&|<>]")) >= n * rules.symbol_share
        shouting = (n >= 3) & (F.regexp_count(s, F.lit("!!")) >= n * rules.shout_share)
        phrase = (n <= rules.phrase_words) & F.lower(s).rlike("|".join(PHRASES))
        unended = (n < rules.unended_words) & ~F.right(s, F.lit(1)).isin(*ENDINGS)
        return ((marks >= n * least) & (navigation | symbols | shouting)) | phrase | unended

    return _bind(F.btrim(line, F.lit(BLANKS)), lambda s: _bind(
        F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1, lambda n: _bind(
            F.regexp_count(s, F.lit(r"[#*$%&|<>»·•]|!!")), lambda marks: judge(s, n, marks))))


def _lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def _total_length(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s).cast("long"))


def measure(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with the columns _q_words, _q_word_chars, _q_symbols, _q_dup_lines, _q_repeat_words, _q_base_failed, _q_lost, _q_kept."""
    clash = [c for c in docs.columns if c.startswith("_q_")]
    if clash:
        raise ValueError(f"columns with the reserved prefix _q_: {clash}")
    df = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_q_trim", F.btrim("_q_text", F.lit(BLANKS)))
    df = df.withColumn("_q_w", F.when(F.col("_q_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_q_trim", _SPLIT)))
    df = df.withColumn("_q_n", F.size("_q_w"))
    # Sort keys of the 3-word windows: the hash above, the position in just the low bits it needs.
    df = df.withColumn("_q_high", F.expr("-shiftleft(1L, length(bin(_q_n)))"))
    df = df.withColumn("_q_key", F.expr("transform(slice(_q_w, 1, greatest(_q_n - 2, 0)), (w, i) -> (xxhash64(w, _q_w[i + 1], _q_w[i + 2]) & _q_high) | i)"))
    df = df.withColumn("_q_sorted", F.sort_array("_q_key"))
    # Neighbours in the sorted keys with equal hash bits; then their windows are compared word by word.
    df = df.withColumn("_q_pairs", F.expr("filter(sequence(0, _q_n - 4), j -> ((_q_sorted[j] ^ _q_sorted[j + 1]) & _q_high) = 0)"))
    df = df.withColumn("_q_pairs", F.when(F.col("_q_n") > 3, F.col("_q_pairs")).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_q_found", F.expr("transform(_q_pairs, j -> struct(cast(_q_sorted[j] & ~_q_high as int) as p, cast(_q_sorted[j + 1] & ~_q_high as int) as o))"))
    df = df.withColumn("_q_found", F.expr("filter(_q_found, f -> _q_w[f.p] = _q_w[f.o] and _q_w[f.p + 1] = _q_w[f.o + 1] and _q_w[f.p + 2] = _q_w[f.o + 2])"))
    df = df.withColumn("_q_at", F.expr("array_distinct(flatten(array(_q_found.p, _q_found.o)))"))
    df = df.withColumn("_q_repeat_words", F.expr("size(array_distinct(flatten(array(_q_at, transform(_q_at, p -> p + 1), transform(_q_at, p -> p + 2)))))").cast("long"))
    df = df.withColumn("_q_lines", _lines(F.col("_q_text")))
    df = df.withColumn("_q_once", F.array_distinct("_q_lines"))
    df = df.withColumns({
        "_q_length": _total_length(F.col("_q_lines")),
        "_q_kept_length": _total_length(F.filter("_q_once", lambda s: ~_line_fails(s, rules))),
        "_q_words": F.col("_q_n").cast("long"),
        "_q_word_chars": F.length(F.array_join("_q_w", "")).cast("long"),
        "_q_symbols": F.regexp_count("_q_text", F.lit(f"[{SYMBOLS}]")).cast("long"),
        "_q_dup_lines": (F.size("_q_lines") - F.size("_q_once")).cast("long"),
    })
    df = df.withColumn("_q_base_failed", (F.col("_q_words") < rules.min_words) | (100 * F.col("_q_repeat_words") > rules.max_repeat_percent * F.col("_q_words")))
    df = df.withColumn("_q_lost", F.when(F.col("_q_length") > 0, 1 - F.col("_q_kept_length") / F.col("_q_length")).otherwise(1.0))
    df = df.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_lost") <= rules.max_lost))
    # The measures pass through a generator: filters on them must not be pushed below the projections,
    # which would copy their expressions into one another many times over.
    names = ("words", "word_chars", "symbols", "dup_lines", "repeat_words", "base_failed", "lost", "kept")
    out = df.withColumn("_q_all", F.explode(F.array(F.struct(*[F.col(f"_q_{n}").alias(n) for n in names]))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"_q_all.{n}").alias(f"_q_{n}") for n in names])


def quality_report(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """One row per document: doc_id, measures, base_failed, kept, lost_share."""
    m = measure(docs.select("doc_id", "text"), rules)
    return m.select(
        "doc_id", F.col("_q_words").alias("n_words"), F.col("_q_word_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"), F.col("_q_repeat_words").alias("n_repeat_words"), F.col("_q_base_failed").alias("base_failed"),
        F.col("_q_kept").alias("kept"), F.round("_q_lost", 6).alias("lost_share"))


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with a column clean_text: the lines that pass, in order, first of repeated lines only."""
    lines = F.array_distinct(_lines(F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumn("clean_text", F.array_join(F.filter(lines, lambda s: ~_line_fails(s, rules)), "\n"))


def filter_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with the input's own columns."""
    return measure(docs, rules).where("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
