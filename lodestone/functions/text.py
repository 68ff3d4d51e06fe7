"""Text expressions: normalisers, tokenizers, predicates on strings. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in the overlap metric (fixed list).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does",
    "for", "from", "how", "in", "is", "of", "on", "the", "to", "was",
    "were", "what", "when", "where", "which", "who", "why", "with",
    "und", "oder", "der", "die", "das", "dem", "den", "des", "ein", "eine",
    "einen", "einem", "eines", "ist", "sind", "war", "wurden", "wird",
    "werden", "hat", "haben", "hatte", "hatten", "wurde", "auch",
    "als", "auf", "mit", "für", "von", "bei", "aus", "nach", "zu",
    "im", "am", "es", "er", "sie", "wir", "ihr", "wie",
    "wenn", "ob", "da", "hier", "so", "nicht", "noch", "aber", "nur",
    "kann", "muss", "soll", "über",
)
#: Answers that count as abstaining (fixed list).
ABSTENTIONS = (
    "unknown", "not found", "n/a", "na", "cannot determine", "can't determine", "insufficient information",
    "unbekannt", "nicht gefunden", "nicht verfügbar", "nicht bekannt", "keine information",
    "kann nicht bestimmt werden", "nicht bestimmbar", "keine angabe", "k.a.",
)
#: Month names and abbreviations (fixed list).
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5,
    "june": 6, "jun": 6, "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
}
#: White space as in Unicode, with the four separators that only some tools count.
SPACE = r"(?U)[\s\x1C-\x1F]+"


def collapse(text: Column) -> Column:
    """White space runs become one space, the ends none; null stays null."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalize_text(text: Column) -> Column:
    """Collapsed and lower-cased, ß as ss; null and blank give null."""
    return F.nullif(F.replace(F.lower(collapse(text)), F.lit("ß"), F.lit("ss")), F.lit(""))


def optional_string(text: Column) -> Column:
    """Collapsed; null if blank."""
    return F.nullif(collapse(text), F.lit(""))


def safe_int(value: Column) -> Column:
    """An integer written as such, else null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)


def _german_stop_words() -> tuple[str, ...]:
    """Articles, pronouns and their endings by rule; conjunctions, prepositions, auxiliaries and particles as a list."""
    endings = ("", "e", "em", "en", "er", "es")
    stems = [s + e for s in ("ein", "kein", "mein", "dein", "sein", "ihr", "unser", "eur") for e in endings if s + e != "eur"]
    stems += [s + e for s in ("dies", "jed", "jen", "manch", "solch", "welch", "all", "ander", "einig", "derselb", "dieselb", "dasselb") for e in endings[1:]]
    rest = (
        "aber als also am an auch auf aus bei bin bis bist da damit dann das dass daß dazu dein dem den denn der des dich die dir doch dort du durch er es etwas euch euer für gegen gewesen hab habe haben hat hatte "
        "hatten hier hin hinter ich ihm ihn ihnen im in indem ins ist jetzt kann können könnte machen man mich mir mit muss musste nach nicht nichts noch nun nur ob oder ohne sehr selbst sich sie sind so sondern sonst "
        "soll sollte über um und uns unter viel vom von vor während war waren warst was weg weil weiter wenn werde werden wie wieder will wir wird wirst wo wollen wollte würde würden zu zum zur zwar zwischen"
    )
    return tuple(sorted({*stems, *rest.split()}))


GERMAN_STOP_WORDS = _german_stop_words()


def german_stem(word: Column) -> Column:
    """Light stemming of a lower-cased German word: umlauts folded, then the endings of nouns and of comparison cut from words that are long enough."""
    w = F.regexp_replace(F.translate(word, "äàáâöòóôüùúûïìíî", "aaaaoooouuuuiiii"), "ß", "ss")
    n = F.length
    cut = lambda x, k: F.substring(x, F.lit(1), n(x) - k)

    def endings(x: Column) -> Column:
        return (
            F.when((n(x) > 5) & x.endswith("ern"), cut(x, 3))
            .when((n(x) > 4) & x.rlike("e[mnrs]$"), cut(x, 2))
            .when((n(x) > 3) & x.endswith("e"), cut(x, 1))
            .when((n(x) > 3) & x.rlike("[bdfghklmnt]s$"), cut(x, 1))
            .otherwise(x)
        )

    def comparison(x: Column) -> Column:
        return F.when((n(x) > 5) & x.endswith("est"), cut(x, 3)).when((n(x) > 4) & x.rlike("e[rn]$"), cut(x, 2)).when((n(x) > 4) & x.rlike("[bdfghklmnt]st$"), cut(x, 2)).otherwise(x)

    return F.transform(F.transform(F.array(w), endings), comparison)[0]


def german_tokens(text: Column) -> Column:
    """Search tokens without German stop words, stemmed."""
    return F.transform(F.filter(search_tokens(text), lambda t: ~t.isin(*GERMAN_STOP_WORDS)), german_stem)


def content_tokens(text: Column) -> Column:
    """Distinct lower-cased content words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zA-ZäöüßÄÖÜ0-9]+"), 0)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def source_id(value: Column) -> Column:
    """The file name behind a path or a chunk reference, lower-cased."""
    name = F.substring_index(F.regexp_replace(F.regexp_replace(collapse(F.coalesce(value, F.lit(""))), r"\\", "/"), "/+$", ""), "/", -1)
    return F.replace(F.lower(F.regexp_replace(name, r"(?i)^(.*?\.(?:txt|md))(?:_chunk_|::chunk_|#chunk=).*$", "$1")), F.lit("ß"), F.lit("ss"))


def is_abstention(text: Column, patterns: tuple[str, ...] = ABSTENTIONS) -> Column:
    plain = F.lower(collapse(F.coalesce(text, F.lit(""))))
    return (plain == "") | F.btrim(plain, F.lit(" .!?:;")).isin([p.strip(" .!?:;") for p in patterns])


def lexical_f1(question: Column, answer: Column) -> Column:
    """Twice the shared content words by the number of both; 0 if either has none."""
    q, a = content_tokens(question), content_tokens(answer)
    return F.when((F.size(q) == 0) | (F.size(a) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(q, a)) / (F.size(q) + F.size(a)))


def query_years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(?:19[3-9]\d|20[0-2]\d|2030)\b"), 0), lambda y: y.cast("int"))))


def query_fiscal_years(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b(?:fiscal\s+year|fy)\s*(19[3-9]\d|20[0-2]\d|2030)\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def query_months(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    names = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
    lookup = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    named = F.transform(F.regexp_extract_all(lowered, F.lit(rf"\b({names})\.?\b"), 1), lambda m: lookup[m])
    numbered = F.transform(F.regexp_extract_all(lowered, F.lit(r"\b(?:month|mo\.?)\s*(?:no\.?\s*)?(0?[1-9]|1[0-2])\b"), 1), lambda m: m.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(named, numbered)))


def query_quarters(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    digits = F.transform(F.regexp_extract_all(lowered, F.lit(r"\bq([1-4])\b"), 1), lambda q: F.concat(F.lit("q"), q))
    words = F.create_map(*[F.lit(x) for pair in (("first", "q1"), ("second", "q2"), ("third", "q3"), ("fourth", "q4")) for x in pair])
    named = F.transform(F.regexp_extract_all(lowered, F.lit(r"\b(first|second|third|fourth)\s+quarter\b"), 1), lambda q: words[q])
    return F.array_sort(F.array_distinct(F.concat(digits, named)))
