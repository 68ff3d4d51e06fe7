"""Model interfaces: deterministic offline defaults, and what injected models plug into."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-zA-ZäöüßÄÖÜ0-9]+")


@lru_cache(maxsize=200_000)
def _slot(token: str, dimensions: int, model: str) -> tuple[int, float]:
    digest = hashlib.blake2b(f"{model}:{token}".encode(), digest_size=8).digest()
    return int.from_bytes(digest[:4], "big") % dimensions, 1.0 - 2.0 * (digest[7] % 2)


def hash_embed(text: str | None, dimensions: int = 256, model: str = "hashing-bow-v1") -> np.ndarray:
    """Signed bag of hashed words."""
    out = np.zeros(dimensions)
    for token in TOKEN.findall((text or "").lower()):
        slot, sign = _slot(token, dimensions, model)
        out[slot] += sign
    return out


def embedder(encode: Callable[[list[str]], list], kind: str = "array<double>"):
    """A pandas UDF from a function of texts to vectors; vectors must be finite."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = [np.asarray(v, float) for v in encode(texts.fillna("").tolist())]
            if not all(np.isfinite(v).all() for v in vectors):
                raise ValueError("an embedder gave a vector that isn't finite")
            yield pd.Series([v.tolist() for v in vectors])

    return run


def hash_embedding(dimensions: int = 256):
    return embedder(lambda texts: [hash_embed(t, dimensions) for t in texts])


def pair_scorer(score: Callable[[list[str], list[str]], list[float]]):
    """A pandas UDF from a function of (questions, texts): rerankers, answer similarity."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(score(questions.fillna("").tolist(), texts.fillna("").tolist()), dtype=float)

    return run


def with_retries(call: Callable[[str], str], tries: int = 3, wait: float = 0.0) -> Callable[[str], tuple[str | None, str | None, int]]:
    """``(answer, error, tries)`` of a call that may fail; waits double."""
    import time

    def run(prompt: str) -> tuple[str | None, str | None, int]:
        error = None
        for n in range(1, tries + 1):
            try:
                return call(prompt), None, n
            except Exception as e:  # the row carries what went wrong
                error = f"{type(e).__name__}: {e}"
                if wait and n < tries:
                    time.sleep(wait * 2 ** (n - 1))
        return None, error, tries

    return run


def first_sentence(prompt: str) -> str:
    """The offline generator: the first sentence of the last context."""
    return re.split(r"(?<=[.!?])\s", prompt.strip().rsplit("\n", 1)[-1], maxsplit=1)[0]


def generate(prompts: DataFrame, call: Callable[[str], str] = first_sentence, tries: int = 3) -> DataFrame:
    """``prompts(query_id, prompt)`` to answers; a failing prompt gives a row with its error, and the others go on."""
    ask = with_retries(call, tries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [ask(p or "") for p in rows["prompt"]]
            yield rows.assign(answer=[m[0] for m in made], error=[m[1] for m in made], tries=[m[2] for m in made])[["query_id", "answer", "error", "tries"]]

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {prompts.schema['query_id'].dataType.simpleString()}, answer string, error string, tries int")


def parse_judgement(response):
    """Judge scores of 0 to 5 from a response: what stands between the first and the last brace, seven fields, whole numbers."""
    body = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    kinds = "correctness double, faithfulness double, completeness double, hallucination double, context_relevance double, overall_score double, reasoning string"
    parsed = F.from_json(body, kinds)
    scores = ("correctness", "faithfulness", "completeness", "hallucination", "context_relevance")
    ok = parsed["reasoning"].isNotNull() & parsed["overall_score"].isNotNull()
    for s in scores:
        ok = ok & parsed[s].between(0, 5)
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(*[F.when(ok, parsed[s].cast("int")).alias(s) for s in scores], F.when(ok, parsed["reasoning"]).alias("reasoning"), ok.alias("success"))


def token_scorer(embed: Callable[[list[str]], list] | None = None):
    """A pandas UDF of (candidate, reference) to ``precision, recall, f1`` by greedy matching of token embeddings: each token counts by its most similar one of the other text. Blank texts have 0."""
    encode = embed or (lambda tokens: [hash_embed(t) for t in tokens])

    @F.pandas_udf("precision double, recall double, f1 double")
    def run(candidates: pd.Series, references: pd.Series) -> pd.DataFrame:
        out = []
        for c, r in zip(candidates.fillna(""), references.fillna(""), strict=True):
            a, b = TOKEN.findall(c.lower()), TOKEN.findall(r.lower())
            if not a or not b:
                out.append((0.0, 0.0, 0.0))
                continue
            x, y = (np.array(encode(t), float) for t in (a, b))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None] for m in (x, y))
            near = x @ y.T
            p, q = float(near.max(1).mean()), float(near.max(0).mean())
            out.append((p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0))
        return pd.DataFrame(out, columns=["precision", "recall", "f1"])

    return run


def token_counter(encode: Callable[[str], list] | None = None):
    """A pandas UDF of a text to its number of tokens; without an encoder, of words between white space."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: len(encode(t) if encode else t.split())).astype("int64")

    return run


def token_truncator(most: int, encode: Callable[[str], list] | None = None, decode: Callable[[list], str] | None = None):
    """A pandas UDF of a text to its first ``most`` tokens and whether anything was cut; without an encoder, of words."""

    @F.pandas_udf("text string, truncated boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts.fillna(""):
            ids = encode(t) if encode else t.split()
            cut = len(ids) > most
            out.append(((decode(ids[:most]) if decode else " ".join(ids[:most])) if cut else t, cut))
        return pd.DataFrame(out, columns=["text", "truncated"])

    return run


def estimated_cost(tokens_in, tokens_out, price_in: float, price_out: float):
    """Cost of a call at prices for a thousand tokens."""
    return (F.coalesce(tokens_in, F.lit(0)) * price_in + F.coalesce(tokens_out, F.lit(0)) * price_out) / 1000.0


#: Fields that a reply about a question's category must not have, as they answer it (fixed names).
ANSWER_FIELDS = ("answer", "generated_answer", "final_answer", "response")


def parse_orchestration(reply, question):
    """``cleaned_question, detected_category, error`` of a model's reply: what stands between the first and the last brace; a reply that answers, or has no object, is an error."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    fields = F.from_json(body, "map<string,string>")
    answers = F.exists(F.map_keys(fields), lambda k: k.isin(*ANSWER_FIELDS))
    error = F.when((body == "") | fields.isNull(), "no object").when(answers, "answers the question")
    given = lambda k: F.nullif(F.trim(fields[k]), F.lit(""))
    return F.struct(
        F.coalesce(F.when(error.isNull(), given("cleaned_question")), question).alias("cleaned_question"),
        F.when(error.isNull(), given("detected_category")).alias("detected_category"),
        error.alias("error"),
    )


def judge_prompt(question, answer, contexts, gold, most_chars: int = 12_000):
    """The judge's prompt with numbered contexts up to ``most_chars``, and whether they were cut."""
    numbered = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n\n")
    cut = F.length(numbered) > most_chars
    parts = [F.lit("Question:"), F.coalesce(question, F.lit("")), F.lit("Contexts:"), F.substring(numbered, 1, most_chars), F.lit("Answer:"), F.coalesce(answer, F.lit("")), F.lit("Reference answer:"), F.coalesce(gold, F.lit("")), F.lit("Reply with one JSON object of scores from 0 to 5 and a reasoning.")]
    return F.struct(F.concat_ws("\n", *parts).alias("prompt"), cut.alias("truncated"))


def fill_json(template: str, values: dict):
    """A template with each ``{{name_json}}`` replaced by its column as JSON."""
    out = F.lit(template)
    for name, column in values.items():
        text = F.get_json_object(F.to_json(F.struct(column.alias("v"))), "$.v")
        whole = F.regexp_replace(F.to_json(F.struct(column.alias("v"))), r'^\{"v":|\}$', "")
        out = F.replace(out, F.lit("{{" + name + "_json}}"), F.coalesce(whole, text, F.lit("null")))
    return out


class SemanticMetric:
    """A metric that an outside model computes: a name, and a function of rows that gives a number or none for each. NaN becomes null, and the status says which it was."""

    registry: dict[str, SemanticMetric] = {}

    def __init__(self, name: str, compute: Callable[[pd.DataFrame], list], needs: tuple[str, ...] = ("question", "answer", "contexts", "gold_answer")) -> None:
        self.name, self.compute, self.needs = name, compute, needs
        SemanticMetric.registry[name] = self

    def apply(self, rows: DataFrame, key: str = "question_id") -> DataFrame:
        """``(key, name, name_status)``; a batch that fails gives rows that say so, and the others go on."""
        name, compute = self.name, self.compute

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                try:
                    made = [None if v is None or v != v else float(v) for v in compute(part)]
                    status = ["ok" if v is not None else "nan" for v in made]
                except Exception as e:  # the rows carry what went wrong
                    made, status = [None] * len(part), [f"failed: {type(e).__name__}"] * len(part)
                yield pd.DataFrame({key: part[key], name: pd.Series(made, dtype="float64", index=part.index), f"{name}_status": status})

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, *[c for c in self.needs if c in rows.columns]).mapInPandas(run, f"{key} {kind}, {name} double, {name}_status string")
