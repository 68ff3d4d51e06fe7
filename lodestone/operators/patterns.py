"""Many passages looked for at once: an Aho-Corasick automaton goes over each text once."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_text

#: Characters of patterns in one automaton, which each task builds; larger dictionaries are cut, and texts read once for each part.
MOST_CHARS = 4_000_000
#: Characters of a pattern that the automaton holds; what comes after is compared where they are found.
HEAD = 48


class Matcher:
    """Finds all of a set of strings, not empty ones, in a text."""

    def __init__(self, patterns: list[str]) -> None:
        import ahocorasick

        heads: dict[str, list[str]] = defaultdict(list)
        for p in dict.fromkeys(patterns):
            if p:
                heads[p[:HEAD]].append(p)
        self.automaton = ahocorasick.Automaton()
        for head, whole in heads.items():
            self.automaton.add_word(head, (len(head), whole))
        if heads:
            self.automaton.make_automaton()
        self.empty = not heads

    def find(self, text: str) -> dict[str, tuple[int, int]]:
        """How often each pattern that is found stands in the text, overlaps included, and where first."""
        out: dict[str, tuple[int, int]] = {}
        if self.empty:
            return out
        for end, (size, whole) in self.automaton.iter(text):
            at = end + 1 - size
            for p in whole:
                if len(p) <= size or text.startswith(p, at):
                    n, first = out.get(p, (0, at))
                    out[p] = (n + 1, first)
        return out


def find_patterns(texts: DataFrame, patterns: DataFrame, most_chars: int | None = None) -> DataFrame:
    """``(text_id, pattern_id, n, first)`` of the ``texts(text_id, text)`` that contain a pattern of ``patterns(pattern_id, pattern)`` character for character.

    ``n`` counts the places, which may overlap; ``first`` is the first of them.
    Null and empty patterns are found nowhere, nor is anything in a null text.
    Patterns may repeat. Dictionaries of more than ``most_chars`` characters are
    cut, in their order, into parts of that size; each is sent to the tasks by
    itself and goes over the texts once. One pattern is never cut.
    """
    source = texts.select("text_id", "text").where("text is not null")
    kind = f"text_id {texts.schema['text_id'].dataType.simpleString()}, pattern string, n long, first long"
    # in order, so that the patterns of one part share their beginnings
    strings = patterns.where(F.length("pattern") > 0).select("pattern").distinct().orderBy("pattern")
    found, held, chars = None, [], 0
    for r in strings.toLocalIterator():  # the driver holds one part at a time
        held.append(r["pattern"])
        chars += len(r["pattern"])
        if chars >= (most_chars or MOST_CHARS):
            found = _matched(source, held, kind) if found is None else found.unionByName(_matched(source, held, kind))
            held, chars = [], 0
    if held or found is None:
        found = _matched(source, held, kind) if found is None else found.unionByName(_matched(source, held, kind))
    return found.join(patterns.select("pattern_id", "pattern"), "pattern").select("text_id", "pattern_id", "n", "first")


def _matched(source: DataFrame, patterns: list[str], kind: str) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(patterns)  # bounded: MOST_CHARS

    def run(batches):
        matcher = Matcher(shared.value)
        for batch in batches:
            at, names, counts, firsts = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                for p, (n, first) in matcher.find(text.as_py()).items():
                    at.append(i)
                    names.append(p)
                    counts.append(n)
                    firsts.append(first)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["text_id", "pattern", "n", "first"])

    return source.mapInArrow(run, kind)


def containing(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """``(text_id, passage_id)`` of the ``texts(text_id, text)`` that contain a passage of ``passages(passage_id, passage)`` character for character; see ``find_patterns``."""
    found = find_patterns(texts, passages.select(F.col("passage_id").alias("pattern_id"), F.col("passage").alias("pattern")))
    return found.select("text_id", F.col("pattern_id").alias("passage_id"))


def mentioned_values(queries: DataFrame, values: DataFrame) -> DataFrame:
    """``(query_id, mentioned)``: the known ``values(value)`` that a question contains, both normalised; an empty array without any."""
    known = values.select(normalize_text(F.col("value")).alias("pattern")).where("pattern is not null").distinct()
    asked = queries.select(F.col("query_id").alias("text_id"), normalize_text(F.col("question")).alias("text"))
    found = find_patterns(asked, known.select(F.col("pattern").alias("pattern_id"), "pattern"))
    listed = found.groupBy(F.col("text_id").alias("query_id")).agg(F.array_sort(F.collect_set("pattern_id")).alias("mentioned"))
    none = F.array().cast("array<string>")
    return queries.select("query_id").distinct().join(listed, "query_id", "left").select("query_id", F.coalesce("mentioned", none).alias("mentioned"))


def forbidden_terms(texts: DataFrame, terms: list[str]) -> DataFrame:
    """``(text_id, term, n)`` of the stated terms that stand in ``texts(text_id, text)``, in upper or lower case."""
    known = texts.sparkSession.createDataFrame([(t, t.lower()) for t in terms], "pattern_id string, pattern string")
    return find_patterns(texts.select("text_id", F.lower("text").alias("text")), known).select("text_id", F.col("pattern_id").alias("term"), "n")
