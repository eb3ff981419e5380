"""Text expressions: Column in, Column out; all stay in generated code or built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are never terms.
STOPWORDS = ("all", "also", "and", "are", "can", "code", "data", "file", "for", "from", "function", "functions", "image", "implementation", "into", "its", "key", "keys", "main", "method", "methods", "model", "models", "module", "modules", "our", "paper", "repo", "repository", "system", "that", "the", "their", "these", "this", "those", "use", "uses", "using", "with")
#: Words that are never topics.
TOPIC_STOPWORDS = ("a", "an", "and", "approach", "analysis", "as", "at", "based", "by", "for", "from", "in", "into", "is", "method", "model", "models", "new", "of", "on", "paper", "study", "system", "systems", "the", "their", "this", "to", "toward", "using", "via", "with")
#: Keywords that mark a domain, as substrings.
DOMAINS = {
    "deep-learning": ("transformer", "attention", "llm", "bert", "gpt", "diffusion", "neural", "cnn"),
    "compilers": ("compiler", "llvm", "bytecode", "parser", "interpreter"),
    "rl-control": ("reinforcement", "rl", "reward", "policy", "environment", "gym", "agent", "trajectory", "control"),
}
#: Patterns of personal data and what replaces them, in order.
PII = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"), (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "<CARD>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"))
#: Lines that are headings whatever their letters.
HEADINGS = ("abstract", "introduction", "references", "acknowledgements", "acknowledgments", "appendix", "conclusion", "conclusions", "discussion", "results", "method", "methods", "related work", "experiments")
SPACE = r"[ \t\n\r\f\x0B]+"


def empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of ASCII white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def collapse_unicode(text: Column) -> Column:
    """As ``collapse``, for all white space of Unicode."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def terms(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased terms in order: words split at case changes and at ._/-+, without short ones, numbers and stopwords."""
    spaced = F.regexp_replace(empty(text), r"([a-z0-9])([A-Z])", "$1 $2")
    words = F.regexp_extract_all(spaced, F.lit(r"[A-Za-z][A-Za-z0-9_./+-]{2,}"), F.lit(0))
    # One pass over all words: pieces are runs of three or more, a letter among them.
    pieces = F.regexp_extract_all(F.lower(F.array_join(words, " ")), F.lit(r"(?=[0-9]*[a-z])[a-z0-9]{3,}"), F.lit(0))
    return F.filter(pieces, lambda p: ~p.isin(*stopwords))


def words(text: Column) -> Column:
    """Lower-cased runs between ASCII white space."""
    return F.filter(F.split(F.lower(empty(text)), SPACE), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Trimmed sentences, cut after . ! or ? before white space."""
    return F.filter(F.transform(F.split(empty(text), r"(?<=[.!?])[ \t\n\r\f]+"), F.trim), lambda s: s != "")


def lines(text: Column) -> Column:
    return F.split(empty(text), "\n")


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (offset, chunk) of at most ``size`` characters, ``overlap`` shared; none for empty text, all of it for size 0."""
    text = empty(text)
    if size <= 0:
        return F.when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("offset"), text.alias("chunk"))))
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda o: F.struct(o.alias("offset"), F.substring(text, o + 1, F.lit(size)).alias("chunk")))


def scrub_pii(text: Column) -> Column:
    for pattern, mark in PII:
        text = F.regexp_replace(text, pattern, mark)
    return text


def domains(text: Column, keywords: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    """Names of the domains of which a keyword occurs, in order."""
    low = F.lower(empty(text))

    def any_of(some: tuple[str, ...]) -> Column:
        out = low.contains(some[0])
        for k in some[1:]:
            out = out | low.contains(k)
        return out

    return F.array_compact(F.array(*[F.when(any_of(ks), F.lit(d)) for d, ks in keywords.items()]))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "['\"]", ""), "[^a-z0-9]+", "_"), F.lit("_"))


def canonical_id(raw: Column) -> Column:
    return F.regexp_replace(raw, r"v[0-9]+$", "")


def version_number(raw: Column) -> Column:
    """The number after v, 0 without one."""
    return F.coalesce(F.regexp_extract(empty(raw), "v([0-9]+)", 1).try_cast("int"), F.lit(0))


#: Fixed value: what no heading holds.
NO_HEADING = r"[-=]{2,}|\\|/|[∑∫√≤≥≠≈±]"


def heading(line: Column) -> Column:
    """Whether a line looks like a heading."""
    s = collapse(empty(line))
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    upper = F.regexp_count(s, F.lit(r"\p{Lu}"))
    no = (F.length(s) > 120) | (letters < 3) | s.rlike(NO_HEADING) | s.rlike(r"\b[A-Za-z]\s*[=<>]\s*[-+0-9A-Za-z]") | (F.regexp_count(s, F.lit("-")) >= 3)
    known = F.rtrim(F.lower(s), F.lit(".:")).isin(*HEADINGS)
    numbered = s.rlike(r"^[0-9]+(\.[0-9]+)*\s+[A-Z]") | s.rlike(r"^(Appendix|Section)\b")
    shout = (upper > 0.72 * letters) & (F.size(F.split(s, " ")) <= 8)
    return ~no & (known | numbered | shout)


def markup_text(html: Column) -> Column:
    """Text of markup: scripts, styles, comments and tags become blanks, white space is collapsed."""
    out = F.regexp_replace(empty(html), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return collapse(F.regexp_replace(out, r"<[^>]*>", " "))


def unit_interval(text: Column) -> Column:
    """A number from 0 to 1 that depends on the text only."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12 - 1))


def sha1_bucket(text: Column, n: int) -> Column:
    return (F.conv(F.substring(F.sha1(text), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
