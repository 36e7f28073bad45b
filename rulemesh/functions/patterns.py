"""Rule patterns and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_template(template: Column) -> Column:
    """Replacement template for ``regexp_replace``.

    ``$`` and one digit is a group; any further digit is text, so ``$101`` is
    group 1 followed by ``01``. Everything else is taken literally.
    """
    literal_backslash = F.regexp_replace(template, r"\\", r"\\\\")
    literal_dollar = F.regexp_replace(literal_backslash, r"\$(?!\d)", r"\\\$")
    return F.regexp_replace(literal_dollar, r"(\$\d)(?=\d)", r"$1\\")


def pattern_compiles(pattern: Column) -> Column:
    """Whether the JVM accepts the pattern, without failing the job if not."""
    compiled = F.try_reflect(
        F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern
    )
    return compiled.isNotNull()


def template_fits(pattern: Column, java_to: Column) -> Column:
    """Whether every group named by the template exists in the pattern.

    An empty first alternative makes the pattern match the empty text, so the
    template is expanded once and a missing group shows.
    """
    expanded = F.try_reflect(
        F.lit("org.apache.commons.lang3.RegExUtils"),
        F.lit("replaceAll"),
        F.lit(""),
        F.concat(F.lit("|"), pattern),
        java_to,
    )
    return expanded.isNotNull()


def _count(pattern: Column, regex: str) -> Column:
    return F.regexp_count(pattern, F.lit(regex))


def question_marks(pattern: Column) -> Column:
    return _count(pattern, r"\?")


def needed_tests_rule(pattern: Column) -> Column:
    """Tests a rule needs. Every ``?`` counts once for and once against, so
    quantified optionals ask for none; group openers count against."""
    return (
        F.lit(1)
        + _count(pattern, r"[+*?|]")
        - _count(pattern, r"\(\?:")
        - _count(pattern, r"\(\?!")
        - _count(pattern, r"\(\?=")
        - question_marks(pattern)
    ).cast("int")


def needed_tests_exclusion(pattern: Column, taken_off: Column) -> Column:
    """Tests an exclusion needs; ``taken_off`` question marks are not counted."""
    return (
        F.lit(1) + _count(pattern, r"[+*?|]") - _count(pattern, r"\(\?:") - taken_off
    ).cast("int")


# Characters with a meaning of their own in patterns, and private characters that stand
# for them while a pattern is taken apart; the last two mark what is not literal.
SPECIAL = "\\.()[]{}*+?|^$"
STANDS_FOR = "".join(chr(0xE000 + i) for i in range(len(SPECIAL)))
GAP = "\ue0ff"
# What is not taken apart: flags and look-arounds, quoting, characters by number or class name,
# references, nested classes, and private characters.
HARD = r"\(\?(?!:)|\\[QExucNpPkXR0-9]|\[[^\]]*\[|\[\^?\]|[\uE000-\uE0FF]"
# Groups within groups that are followed; a pattern with more has no literal.
NESTING = 4


def necessary_literal(pattern: Column) -> Column:
    """A text that every match of the pattern holds, the longest found; empty if none is certain.

    Classes, groups, alternatives, optional and repeated parts and anchors are gaps; the literal is the longest
    run of characters between them. Whatever is not understood for certain gives the empty text, which
    every URL holds.
    """
    text = pattern
    for mark, own in zip(STANDS_FOR, SPECIAL, strict=True):  # the backslash itself first
        text = F.replace(text, F.lit("\\" + own), F.lit(mark))
    text = F.regexp_replace(text, r"""\\([/\-:=&%"'#_@!,;~<> ])""", "$1")
    text = F.regexp_replace(text, r"\\.", GAP)
    text = F.regexp_replace(text, r"\[[^\[\]]*\]", GAP)
    for _ in range(NESTING):
        text = F.regexp_replace(text, r"\([^()]*\)", GAP)
    text = F.regexp_replace(text, r"(.)\+[?+]?", f"$1{GAP}")
    text = F.regexp_replace(text, r".(?:[*?]|\{[^}]*\})[?+]?", GAP)
    open_ended = F.rlike(text, F.lit(r"[()\[\]{}|*+?\\]"))
    parts = F.split(F.regexp_replace(text, r"[.^$]", GAP), GAP)
    longest = F.aggregate(
        parts, F.lit(""), lambda best, part: F.when(F.length(part) > F.length(best), part).otherwise(best)
    )
    literal = F.translate(longest, STANDS_FOR, SPECIAL)
    unsure = F.rlike(pattern, F.lit(HARD)) | open_ended | pattern.isNull()
    return F.when(unsure, F.lit("")).otherwise(literal)
