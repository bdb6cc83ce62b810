"""Scalar functions on text, time and boxes as column expressions.

Every table carries ``run_id`` and ``pos`` (the place of a row in its list); functions take columns and return columns,
stay in the JVM, and give null for null unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)"  # \w, \s and \b over all of Unicode


def mmss(seconds: Column) -> Column:
    """``mm:ss``, from an hour on ``h:mm:ss``; fractions are cut off, null and negative times are ``00:00``."""
    s = F.floor(F.greatest(F.coalesce(seconds.cast("double"), F.lit(0.0)), F.lit(0.0)))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def parse_time(value: Column) -> Column:
    """Seconds from ``[[HH:]MM:]SS[.,fff]``, optionally in square brackets, or an ISO ``PT1H2M3S``; null otherwise."""
    t = F.trim(F.regexp_replace(F.trim(value), r"^\[+|\]+$", ""))
    clock = r"^(?:(\d{1,2}):)?(?:(\d{1,2}):)?(\d{1,2}(?:[.,]\d+)?)$"
    iso = r"(?i)^PT(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?$"

    def part(pattern: str, i: int) -> Column:
        return F.replace(F.regexp_extract(t, pattern, i), F.lit(","), F.lit(".")).try_cast("double")

    a, b, s = part(clock, 1), part(clock, 2), part(clock, 3)
    by_clock = F.coalesce(F.when(b.isNotNull(), a * 3600 + b * 60), a * 60, F.lit(0.0)) + s
    by_iso = sum((F.coalesce(part(iso, i + 1), F.lit(0.0)) * u for i, u in enumerate((3600, 60, 1))), F.lit(0.0))
    return F.when(t.rlike(iso), by_iso).when(t.rlike(clock), by_clock)


def squeezed(text: Column) -> Column:
    """Trimmed, white space runs as one space."""
    return F.trim(F.regexp_replace(text, WORD + r"\s+", " "))


def norm(text: Column) -> Column:
    """The key that rows are folded by: squeezed and case-folded; null counts as empty. Sharp s and the other letters
    that fold to several are replaced first, the rest folds by ``lower``."""
    t = squeezed(F.coalesce(text, F.lit("")))
    for letter, folded in (("ß", "ss"), ("ẞ", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ς", "σ")):
        t = F.replace(t, F.lit(letter), F.lit(folded))
    return F.lower(t)


def fold(term: Column) -> Column:
    """Lower case without white space and hyphens."""
    return F.lower(F.regexp_replace(term, WORD + r"[\s-]+", ""))


def singular(folded: Column) -> Column:
    n = F.length(folded)
    return (
        F.when(folded.endswith("ies") & (n > 4), F.concat(F.left(folded, n - 3), F.lit("y")))
        .when(folded.rlike("(?:ses|xes|shes|ches)$"), F.left(folded, n - 2))
        .when(folded.endswith("s") & ~folded.endswith("ss"), F.left(folded, n - 1))
        .otherwise(folded)
    )


def quoted(text: Column) -> Column:
    """The text as a literal inside a regular expression."""
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1")


def term_pattern(term: Column, plural: bool = True) -> Column:
    """A pattern for whole-word mentions of a term: any case, white space or hyphens between its words, a plural ending
    allowed on the last; a hyphen counts as a word character. Null for a blank term."""
    words = F.filter(F.split(term, WORD + r"[\s-]+"), lambda w: w != "")
    body = F.array_join(F.transform(words, quoted), r"[\s-]+")
    end = r"(?:s|es)?" if plural else ""
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?iU)(?<![\w-])"), body, F.lit(end + r"(?![\w-])")))


def mentions(term: Column, text: Column, plural: bool = True) -> Column:
    """Whether the text mentions the term; false for a blank term or a null text."""
    return F.coalesce(F.regexp_like(text, term_pattern(term, plural)), F.lit(False))


#: Words that a term and a text meet by at most.
MENTION_WORDS = 3


def mention_key(term: Column) -> Column:
    """What a text must hold among its ``mention_grams`` to mention the term: its first words, three at most, up to one
    that isn't all letters and digits. '' stands for any text, where the term starts with no word."""
    first = F.regexp_extract(F.lower(F.trim(term)), WORD + rf"^\w+(?:[\s-]+\w+){{0,{MENTION_WORDS - 1}}}(?=[\s-]|$)", 0)
    return F.regexp_replace(first, WORD + r"[\s-]+", " ")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + r"\w+"), F.lit(0))


def _bare(word: Column) -> Column:
    """The word, also without a plural ending."""
    forms = F.array(word, F.when(word.endswith("s"), F.left(word, F.length(word) - 1)), F.when(word.endswith("es"), F.left(word, F.length(word) - 2)))
    return F.array_compact(forms)


def mention_keys(text: Column) -> Column:
    """The words of a text, also without a plural ending, and ''."""
    words = _words(text)
    bare = F.transform(F.filter(words, lambda w: w.endswith("s")), lambda w: F.left(w, F.length(w) - 1))
    barer = F.transform(F.filter(words, lambda w: w.endswith("es")), lambda w: F.left(w, F.length(w) - 2))
    return F.array_distinct(F.concat(words, bare, barer, F.array(F.lit(""))))


def mention_grams(text: Column, hits: Column) -> Column:
    """Up to three words of a text from each that is among ``hits`` on, those of ``mention_keys`` that some term starts
    with; of each run of words the last also without a plural ending. '' if it is a hit."""
    words = _words(text)

    none = F.array().cast("array<string>")

    def after(lead: Column, word: Column) -> Column:
        return F.when(word.isNotNull(), F.transform(_bare(word), lambda x: F.concat(lead, F.lit(" "), x))).otherwise(none)

    def runs(w: Column, i: Column) -> Column:
        lead = [F.concat_ws(" ", w, *(F.get(words, i + j) for j in range(1, k))) for k in range(1, MENTION_WORDS)]
        longer = [after(x, F.get(words, i + k + 1)) for k, x in enumerate(lead)]
        return F.when(F.arrays_overlap(_bare(w), hits), F.concat(_bare(w), *longer)).otherwise(none)

    any_text = F.when(F.array_contains(hits, ""), F.array(F.lit(""))).otherwise(none)
    return F.array_distinct(F.concat(F.flatten(F.transform(words, runs)), any_text))


def phrase_pattern(phrase: str) -> str:
    """For a phrase known when the plan is made: the engine compiles a literal pattern once."""
    import re

    return r"(?iU)(?<![\w-])" + r"\s+".join(re.sub(r"([^\w])", r"\\\1", w) for w in phrase.split()) + r"(?![\w-])"


def matches_all(text: Column, groups: Column) -> Column:
    """Conjunctive normal form: every group has an alternative, ``a|b``, that the text contains in any case."""
    low = F.lower(text)
    hit = lambda g: F.exists(F.split(g, r"\|"), lambda a: (F.trim(a) != "") & F.contains(low, F.lower(F.trim(a))))
    return F.coalesce(F.forall(groups, hit), F.lit(False))


def natural_key(name: Column) -> Column:
    """Sorts digit runs as numbers and before letters."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    numeric = lambda p: p.rlike(r"^\d+$")
    return F.transform(
        parts, lambda p: F.struct((~numeric(p)).alias("letters"), F.when(numeric(p), p.try_cast("decimal(38,0)")).alias("n"), F.when(~numeric(p), p).alias("s"))
    )


def trailing_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("bigint")


def html(text: Column, quotes: bool = True) -> Column:
    t = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def table_cell(text: Column) -> Column:
    """For a Markdown table."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def slug(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), "-")


def cut(text: Column, most: int = 250) -> Column:
    """At most so many characters on one line, ending with an ellipsis where something is cut off."""
    t = squeezed(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(most - 1))), F.lit("\u2026")))


def yes_no(value: Column) -> Column:
    return F.when(value.isNull(), "Unknown").when(value, "Yes").otherwise("No")


def frame_label(index: Column, seconds: Column) -> Column:
    """``frame 3 @ 00:12``; null without a frame."""
    return F.when(index.isNotNull(), F.concat(F.lit("frame "), index.cast("string"), F.lit(" @ "), mmss(seconds)))


def answer_status(text: Column) -> Column:
    """Free text to ``answered``, ``not needed``, ``open`` or null."""
    t = F.lower(F.regexp_replace(squeezed(text), "[-_]", " "))
    return (
        F.when(t.isin("answered", "done", "closed", "resolved"), "answered")
        .when(t.isin("not needed", "notneeded", "n/a", "na", "not required", "skip"), "not needed")
        .when(t == "open", "open")
    )


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes held as longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of any length in hex, 16 digits at a time from the right."""
    def lanes(h: Column) -> Column:
        n = F.ceil(F.length(h) / 16) * 16
        padded = F.lpad(h, n, "0")
        return F.transform(F.sequence(F.lit(0), (n / 16 - 1).cast("int")), lambda i: F.conv(F.substring(padded, i * 16 + 1, F.lit(16)), 16, -10).cast("bigint"))

    return F.aggregate(F.zip_with(lanes(a), lanes(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def whole_screen(w: Column, h: Column, fraction: Column, width: Column, height: Column) -> Column:
    share = F.when((width > 0) & (height > 0), w * h / (width * height)).otherwise(1.0)
    return (fraction > 0.6) | (share > 0.5)


def region_name(x: Column, y: Column, w: Column, h: Column, fraction: Column, width: Column, height: Column) -> Column:
    """Where a box's centre lies in a grid of nine."""
    third = lambda at, size: F.when(size > 0, F.least(F.lit(2), F.floor(3 * at / size))).otherwise(1)
    col, row = third(x + w / 2, width), third(y + h / 2, height)
    names = lambda n, a, b, c: F.when(n == 0, a).when(n == 1, b).otherwise(c)
    place = F.concat_ws(" ", names(row, "top", "middle", "lower"), names(col, "left", "centre", "right"))
    return F.when(whole_screen(w, h, fraction, width, height), "the whole screen").when((row == 1) & (col == 1), "centre").otherwise(place)


def crop_wanted(w: Column, h: Column, fraction: Column, width: Column, height: Column) -> Column:
    """Whether a change is real but small enough for a close-up."""
    return F.coalesce((fraction >= 0.002) & (width > 0) & (height > 0) & (w * h / (width * height) < 0.35), F.lit(False))


#: Characters and pixels to a token.
def text_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("bigint")


def image_tokens(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(width * height / 750)).cast("bigint")


def storage_key(path: Column, prefix: str = "answers:") -> Column:
    """What a report in that folder keeps its answers under in a browser: sixteen digits of the path's digest."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(path, 256), 1, 16))


def fingerprint(*parts: Column) -> Column:
    """A key of contents: SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
