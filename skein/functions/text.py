"""Text expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH_ALTERNATIVES = "|".join([f"{m}|{m[:3]}\\.?" if m != "September" else "September|Sept\\.?|Sep\\.?" for m in MONTHS])

# Words that make no search phrase by themselves.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could
    couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her
    here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor
    not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's
    the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we
    we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll
    you're you've your yours yourself yourselves tell show find give describe explain summarize list report results findings information data benchmark benchmarks""".split()
)


def strip(c: Column) -> Column:
    """Without white space (also tabs and line breaks) at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(c, 256), 1, 12)


def document_key(c: Column) -> Column:
    return F.concat(F.lit("doc_"), content_hash(c))


def portable(c: Column) -> Column:
    """Lower case, with every other letter or digit than an ASCII one as Z and every other foreign character as a space."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "Z")


def tokens(c: Column) -> Column:
    """Search tokens: ASCII letters, digits, _ and - between word boundaries; words with other letters in them give none.  Empty for null."""
    return F.coalesce(F.regexp_extract_all(portable(c), F.lit(r"(\b[a-z0-9_-]+\b)"), 1), F.array().cast("array<string>"))


def remove_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def normalize_text(c: Column) -> Column:
    """Extracted text as it is stored: no control characters, words joined over line ends, month names written out beside their abbreviation, at most one blank line in a row."""
    # The patterns of what is joined, moved and written out.
    s = remove_control(c)
    s = F.regexp_replace(s, r"(\b[A-Za-z]{2,})-\s*\n\s*([a-z]{2,}\b)", "$1$2")
    # a year that a page layout has put two paragraphs below its day
    s = F.regexp_replace(s, r"(\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s*\d{1,2}),?\s*\n\n([^\n]+(?:\n[^\n]+)?)\n\n(20\d\d)\b", "$1, $3\n\n$2")
    plain = s
    for m in MONTHS:
        if m != "May":
            short = "(Sept|Sep)" if m == "September" else f"({m[:3]})"
            s = F.regexp_replace(s, rf"(?i)\b{short}\b\.?\s*(\d{{1,2}}),?\s*((?:19|20)\d\d)\b", f"{m} $2, $3 ($1. $2, $3)")
    # few texts have an abbreviated month; the others skip its eleven patterns
    s = F.when(plain.rlike(r"(?i)\b(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\b\.?\s*\d"), s).otherwise(plain)
    return strip(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda x: F.length(x) > 0)


def heading(p: Column) -> Column:
    """The title if a one-line paragraph is a heading: after #, in capitals, or after a section number; else null."""
    one = ~F.contains(p, F.lit("\n"))
    marked = F.regexp_extract(p, r"^#{1,6}\s+(.+)$", 1)
    plain = F.regexp_extract(p, r"^(?=.*[A-Za-z])([A-Z0-9\s\-_:]{3,50}:?|[0-9]+\.[0-9]*\s+[A-Z].*)$", 1)
    return F.when(one & (marked != ""), strip(marked)).when(one & (plain != ""), strip(plain))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda x: F.length(x) > 0)


def units(p: Column, size: int) -> Column:
    """A paragraph in units: whole if it fits, else its lines if all fit, else its sentences."""
    lines = F.filter(F.transform(F.split(p, "\n"), strip), lambda x: F.length(x) > 0)
    fit = (F.size(lines) > 1) & F.forall(lines, lambda x: F.length(x) <= size)
    return F.when(F.length(p) <= size, F.array(p)).when(fit, lines).otherwise(sentences(p))


def hard_slices(c: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, `overlap` of them shared, up to the text's end."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / step)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(c, i * step + 1, F.lit(size)))), lambda x: F.length(x) > 0)


def word_count(c: Column) -> Column:
    return F.when(F.length(strip(c)) == 0, 0).otherwise(F.size(F.split(strip(c), r"\s+"))).cast("long")


def redact(c: Column) -> Column:
    """API keys out of messages; the pattern is a fixed value."""
    return F.regexp_replace(c, r"AIza[0-9A-Za-z\-_]{35}", "[REDACTED_API_KEY]")


def normalize_date(c: Column) -> Column:
    """The first date written with a month's name, as "Month d, yyyy"; the text itself if there is none."""
    pat = rf"(?i)\b({_MONTH_ALTERNATIVES})\s*(\d{{1,2}}),?\s*(\d{{4}})"
    short = F.lower(F.substring(F.regexp_extract(c, pat, 1), 1, 3))
    month = F.lit(None).cast("string")
    for m in MONTHS:
        month = F.when(short == m[:3].lower(), m).otherwise(month)
    day = F.try_to_number(F.regexp_extract(c, pat, 2), F.lit("99")).cast("int").cast("string")
    return F.when(F.regexp_extract(c, pat, 0) != "", F.concat(month, F.lit(" "), day, F.lit(", "), F.regexp_extract(c, pat, 3))).otherwise(c)


def canonicalize(name: Column, entity_type: Column) -> Column:
    """A mention in canonical form: without quotes, brackets or a leading article, dates and the prefixes US, EU and UK written out; '' for blank."""
    s = strip(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), r"""^['"`’“”()\[\]{}]+|['"`’“”()\[\]{}]+$""", ""))
    s = F.regexp_replace(s, r"\s+", " ")
    t = F.ltrim(F.regexp_replace(s, r"(?is)^(?:the|an|a) (?=.{3})", ""))
    for pattern, full in ((r"(?i)^(?:u\.s\.a\.|usa|u\.s\.|u\.s\b|us\b)\s*", "United States "), (r"(?i)^(?:e\.u\.|eu\b)\s*", "European Union "), (r"(?i)^(?:u\.k\.|uk\b)\s*", "United Kingdom ")):
        t = strip(F.regexp_replace(t, pattern, full))
    return F.when(F.upper(entity_type) == "DATE", normalize_date(s)).otherwise(t)
