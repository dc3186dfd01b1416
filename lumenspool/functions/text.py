"""Text columns: precedence of wordings, token rules, labels and escaping. Built-in expressions; nulls give nulls unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenspool.functions import columns as C
from lumenspool.functions import unicode as U

#: Token rules, one a name. Letters and digits of any script; case does not matter.
ADDRESS = r"https?://\S+"
MAILBOX = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
LOOSE_MAILBOX = r"\b\S+@\S+\.\S+\b"
OPTION = r"--?[A-Za-z][\p{L}\p{N}_-]*"
DRIVE_PATH = r"[A-Za-z]:[\\/]\S+"
ANY_PATH = r"(?:[A-Za-z]:[\\/]|/)\S+"
BACKSLASH_PATH = r"(?:[A-Za-z]:\\|/)\S+"
PATH_AFTER_BLANK = r"(?:^|(?<=\s))/\S+"
MARK = r"[^\p{L}\p{N}_\s]"
#: Units that belong to a number, by use.
AUDIT_UNITS = ("%", "mg", "kg", "ml", "gb", "mb", "px", "ms", "s")
REBUILD_UNITS = ("%", "mg", "kg", "cm", "mm", "ml", "gb", "mb", "kb")


def number(units: tuple[str, ...]) -> str:
    """Digits in groups, with a unit or none, between word bounds."""
    return rf"\b[0-9]+(?:[.,:][0-9]+)*(?:{'|'.join(units)})?\b"


def word(units: tuple[str, ...]) -> str:
    """Letters and digits with inner apostrophes, then groups of digits and a unit."""
    return rf"[\p{{L}}\p{{N}}]+(?:['’][\p{{L}}\p{{N}}]+)*(?:[.,:][0-9]+)*(?:{'|'.join(units)})?"


AUDIT_RULES = (number(AUDIT_UNITS), ADDRESS, LOOSE_MAILBOX, OPTION, BACKSLASH_PATH)
REBUILD_RULES = (ADDRESS, MAILBOX, ANY_PATH, OPTION, number(REBUILD_UNITS))
ORDERED_RULES = (ADDRESS, DRIVE_PATH, PATH_AFTER_BLANK, OPTION, word(REBUILD_UNITS), MARK)


#: A piece without one of these characters has no match of the rules for numbers, addresses, mailboxes, options and paths.
_TELLING = r"[0-9@/\\-]"


def matches(text: Column, rules: tuple[str, ...]) -> Column:
    """All matches in order; where two rules match at a place the earlier wins."""
    return F.regexp_extract_all(text, F.lit("(?i)" + "|".join(rules)), F.lit(0))


def telling_matches(text: Column, rules: tuple[str, ...]) -> Column:
    """The same for rules that match within a run without blanks and need a telling character there.

    Runs are looked at one by one, and mailboxes only in those with an @: a mailbox rule may try each start in a run
    against each end, which must not happen over a whole text.
    """
    plain = tuple(r for r in rules if r not in (MAILBOX, LOOSE_MAILBOX))
    runs = F.filter(F.split(text, r"\s+"), lambda p: p.rlike(_TELLING))
    return F.flatten(F.transform(runs, lambda p: F.when(F.contains(p, F.lit("@")), matches(p, rules)).otherwise(matches(p, plain))))


def audit_high_impact(text: Column) -> Column:
    """Numbers with units, addresses, mailboxes, options and paths, as written."""
    return telling_matches(text, AUDIT_RULES)


def rebuild_high_impact(text: Column) -> Column:
    """The same kinds by the reconstruction's rules; marks that end a sentence are trimmed."""
    return F.transform(telling_matches(text, REBUILD_RULES), lambda x: F.regexp_replace(x, "[.,;!?]+$", ""))


def ordered_tokens(text: Column, case_sensitive: bool = False, marks: bool = False) -> Column:
    """Tokens in order with addresses, paths, options and decimals whole; bare marks only if asked for."""
    found = matches(text, ORDERED_RULES)
    if not marks:
        found = F.filter(found, lambda x: x.rlike(r"[\p{L}\p{N}]") | x.startswith("/") | x.startswith("-"))
    return found if case_sensitive else F.transform(found, F.lower)


def first_given(*wordings: Column) -> Column:
    """The first that is not null, an empty one too; empty if there is none."""
    return F.coalesce(*wordings, F.lit(""))


def first_filled(*wordings: Column) -> Column:
    """The first that is not empty."""
    return F.coalesce(*[F.nullif(w, F.lit("")) for w in wordings], F.lit(""))


def first_visible(*wordings: Column) -> Column:
    """The first that has more than blanks, trimmed."""
    strip = lambda w: F.regexp_replace(w, r"^\s+|\s+$", "")
    return F.coalesce(*[F.nullif(strip(w), F.lit("")) for w in wordings], F.lit(""))


def recognized_text(text: Column) -> Column:
    """Characters composed, line ends unified, blanks of each line collapsed, empty lines gone."""
    lines = F.split(F.regexp_replace(U.composed(text), "\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "^ | $", "")), lambda x: x != ""), "\n")


def comparable(text: Column) -> Column:
    """Blanks collapsed, trimmed; null is empty."""
    return C.collapse(F.coalesce(text, F.lit("")))


def normalized_token(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def track_authorship(*tags: Column) -> Column:
    """struct(source_type, authorship) by words in a track's title, handler and comment."""
    said = F.concat_ws(" ", *tags)
    machine, human = said.rlike(r"(?i)\b(auto|automatic|generated|speech[- ]to[- ]text)\b"), said.rlike(r"(?i)\b(human|manual|official|creator)\b")
    return F.struct(F.when(machine, "automatic_caption").otherwise("embedded_human_subtitle").alias("source_type"),
                    F.when(machine, "auto_generated").when(human, "human").otherwise("unknown").alias("authorship"))


def track_label(text: Column) -> Column:
    """Lower-case letters, digits and single hyphens, 40 at most; 'track' if nothing is left."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40), F.lit("")), F.lit("track"))


def yaml_scalar(value: Column) -> Column:
    """A double-quoted scalar on one line; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\r", " "), ("\n", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def evidence_text(text: Column) -> Column:
    """Markup escaped, marks that begin a block or a link too."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    safe = F.regexp_replace(safe, r"(?m)^(\s{0,3})([#>-]|\d+[.)])", r"$1\\$2")
    return F.replace(F.replace(safe, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def fenced_block(text: Column, language: str = "text") -> Column:
    return F.concat(C.fence(text), F.lit(language + "\n"), text, F.lit("\n"), C.fence(text))


def duration_class(seconds: Column) -> Column:
    return F.when(seconds <= 180, "short").when(seconds <= 1800, "medium").otherwise("long")


def voice(text: Column) -> Column:
    """The name in a voice tag at the start of a cue."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?i)^\s*<v\s+([^>]+)>", 1)), F.lit(""))


def without_cue_tags(text: Column) -> Column:
    """Cue tags gone, character references decoded."""
    return U.unescaped(F.regexp_replace(text, r"(?i)</?(?:c(?:\.[^ >]+)?|v(?:\s+[^>]*)?|lang(?:\s+[^>]*)?|ruby|rt|b|i|u)>", ""))
