"""Indexing and retrieval: feature hashing, lexical, exact vector and hybrid.

Searches are frames: a postings table joined with the query's terms, or a
cosine over the candidates of one configuration, both ended by a top-k.  A
query is a short list of words or one vector; it enters as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers, text
from .relational import top

WIDTH = 512
RRF_K = 60


def features(word: Column) -> Column:
    """A word and its letter trigrams, marked by kind; what stands for a text
    without words, if the word is empty."""
    marked = F.concat(F.array(F.concat(F.lit("w:"), word)), F.transform(text.trigrams(word), lambda g: F.concat(F.lit("c3:"), g)))
    return F.when(word == "", F.array(F.lit("<empty>"))).otherwise(marked)


def hashed_buckets(df: DataFrame, key: str, words: Column, width: int = WIDTH, empty: bool = True) -> DataFrame:
    """(key, bucket, weight): the sparse signed counts of each text.  Texts are
    dealt by key once; then the words of a text are counted, and the features of
    its distinct words hashed and summed, without another shuffle.  A text without
    words has the feature that stands for it, or (without ``empty``) no rows."""
    dealt = df.select(key, words.alias("w")).repartition(key)
    some = F.when(F.size("w") == 0, F.array(F.lit(""))).otherwise(F.col("w")) if empty else F.col("w")
    each = dealt.select(key, F.explode(some).alias("w"))
    counted = each.groupBy(key, "w").agg(F.count("*").alias("n"))
    weighed = counted.select(key, "n", F.explode(features(F.col("w"))).alias("f")).select(key, numbers.bucket(F.col("f"), width).alias("bucket"), (F.col("n") * numbers.sign(F.col("f"))).alias("w"))
    return weighed.groupBy(key, "bucket").agg(F.sum("w").cast("long").alias("weight"))


def embedded(df: DataFrame, key: str, words: Column, width: int = WIDTH) -> DataFrame:
    """(key, embedding): dense, with length 1.  The length is summed with the
    entries; each entry then follows the zeros between it and the one before."""
    weight = F.col("weight")
    g = hashed_buckets(df, key, words, width).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bucket", weight.cast("double").alias("w")))).alias("s"), F.sqrt(F.sum(weight * weight)).alias("norm"))
    norm, zero = F.col("norm"), F.lit(0.0)

    def piece(e: Column, i: Column) -> Column:
        after = F.when(i == 0, 0).otherwise(F.get("s", i - 1)["bucket"] + 1)
        return F.concat(F.array_repeat(zero, e["bucket"] - after), F.array(F.when(norm > 0, e["w"] / norm).otherwise(e["w"])))

    tail = F.array_repeat(zero, F.lit(width - 1) - F.element_at("s", -1)["bucket"])
    return g.select(key, F.concat(F.flatten(F.transform("s", piece)), tail).alias("embedding"))


def with_embeddings(pending: DataFrame, text_col: str, embed: Callable[[list[str]], list[list[float]]], width: int, batch: int = 64) -> DataFrame:
    """Embeddings of an outside model, asked for in batches; each answer is
    checked for number, width and finite values."""
    schema = T.StructType([*pending.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = frame[text_col].tolist()
            for a in range(0, len(texts), batch):
                answer = embed(texts[a : a + batch])
                if len(answer) != len(texts[a : a + batch]) or any(len(v) != width or any(x != x or abs(x) == float("inf") for x in v) for v in answer):
                    raise ValueError("the model's answer has another shape")
                vectors += answer
            yield frame.assign(embedding=vectors)

    return pending.mapInPandas(run, schema)


def pending(current: DataFrame, stored: DataFrame, keys: Sequence[str], config: str) -> DataFrame:
    """Chunks to embed: new, changed, without a vector or of another configuration."""
    old = stored.select(*keys, F.col("text").alias("_text"), F.col("embedding").isNotNull().alias("_has"), F.col("config_hash").alias("_config"))
    j = current.join(old, list(keys), "left")
    return j.where(F.col("_text").isNull() | (F.col("_text") != F.col("text")) | ~F.col("_has") | (F.col("_config") != config)).drop("_text", "_has", "_config")


def postings(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, tf)"""
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lexical(index: DataFrame, key: str, terms: Sequence[str], k: int) -> DataFrame:
    """Texts with all terms; if there is none, with any.  Ranked by how many
    terms they hold, then how often, then by key."""
    wanted = list(dict.fromkeys(terms))
    hits = index.where(F.col("term").isin(wanted)).groupBy(key).agg(F.count("*").alias("covered"), F.sum("tf").alias("occurrences"))
    best = hits.agg(F.max("covered").alias("best"))
    strict = hits.join(F.broadcast(best), (F.col("best") < len(wanted)) | (F.col("covered") == len(wanted)))
    return top(strict.drop("best"), [F.col("covered").desc(), F.col("occurrences").desc(), F.col(key)], k, most=50)


def nearest(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int, floor: float = 0.0) -> DataFrame:
    """Exact top-k by cosine; the floor is applied before the limit."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(numbers.cosine(F.col(vector), q), 6).alias("similarity")).where(F.col("similarity") >= floor)
    return top(scored, [F.col("similarity").desc(), F.col(key)], k, most=200)


def fused(first: DataFrame, second: DataFrame, key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of two lists (key, position)."""
    a, b = first.select(key, F.col("position").alias("p1")), second.select(key, F.col("position").alias("p2"))
    both = a.join(b, key, "full_outer")
    return top(both.select(key, F.round(numbers.rrf(F.col("p1"), F.col("p2"), k=RRF_K), 9).alias("score")), [F.col("score").desc(), F.col(key)], k, most=200)


def candidate_limit(k: int) -> int:
    return min(50, max(4 * k, 20))


def configurations(chunks: DataFrame, current: str) -> DataFrame:
    """Embedding configurations in use, and whether each is the current one."""
    return chunks.where("embedding is not null").groupBy("config_hash").agg(F.count("*").alias("n")).withColumn("current", F.col("config_hash") == current)


def without_hostile(hits: DataFrame, findings: DataFrame) -> DataFrame:
    """Hits whose document has no open or accepted directive finding."""
    flagged = findings.where("rule_id = 'PROMPT_INJECTION_ATTEMPT' and status in ('OPEN', 'ACCEPTED')").select(F.explode("document_ids").alias("document_id")).distinct()
    return hits.join(flagged, "document_id", "left_anti")


def neighbours(cells: DataFrame, at: DataFrame, reach: int = 3) -> DataFrame:
    """Cells around the rows (document_id, sheet, row) of a locator."""
    a = at.select("document_id", "sheet", F.col("row").alias("_row"))
    return cells.join(a, ["document_id", "sheet"]).where(F.abs(F.col("row") - F.col("_row")) <= reach).drop("_row")


def spanish_postings(df: DataFrame, key: str, words_col: str) -> DataFrame:
    """(key, term, tf) of a Spanish text index: words that aren't stop words, in lower
    case, by their stems.  Each distinct word is stemmed once, and the stem joined to
    its postings."""
    from pyspark.ml.feature import StopWordsRemover

    from ..functions.spanish import stem

    stops = F.array(*[F.lit(w) for w in StopWordsRemover.loadDefaultStopWords("spanish")])

    def stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(stem)

    kept = F.filter(F.transform(F.col(words_col), F.lower), lambda w: ~F.array_contains(stops, w))
    of_word = postings(df, key, kept).withColumnRenamed("term", "word")
    vocabulary = of_word.select("word").distinct().withColumn("term", F.pandas_udf(stems, "string")("word"))
    return of_word.join(vocabulary, "word").groupBy(key, "term").agg(F.sum("tf").alias("tf"))


# One question for each rule, and three that always help.
RULE_QUESTIONS = {
    "PERSONNEL_COST_MISMATCH": "¿Qué dice la memoria sobre el gasto de personal?",
    "EXTERNAL_COST_MISMATCH": "¿Qué facturas soportan las colaboraciones externas?",
    "CLAIMED_TOTAL_MISMATCH": "¿Qué importe total declara la memoria técnica?",
    "DUPLICATE_INVOICE_NUMBER": "¿Qué facturas comparten número y qué conceptos tienen?",
    "EXPENSE_OUTSIDE_ELIGIBLE_PERIOD": "¿Qué periodo elegible publica la convocatoria?",
    "PERSONNEL_RATE_MISMATCH": "¿Qué costes horarios aparecen en la memoria?",
    "UNKNOWN_PERSON": "¿Qué personas figuran con dedicación al proyecto?",
    "PERSON_OUTSIDE_CONTRACT": "¿Qué dice la memoria sobre las fechas de dedicación?",
    "HOURS_ABOVE_MONTHLY_CEILING": "¿Cómo se acreditan las horas imputadas?",
    "NEGATIVE_HOURS": "¿Cómo se acreditan las horas imputadas?",
    "MISSING_PROJECT_CODE": "¿Qué facturas citan la referencia del proyecto?",
    "INSUFFICIENT_EVIDENCE": "¿Qué documentos se han aportado y qué acredita cada uno?",
    "LOW_OCR_CONFIDENCE": "¿Qué justificantes se han leído por OCR?",
    "CORRUPT_DOCUMENT": "¿Qué documentos no se pudieron leer?",
    "UNSUPPORTED_DOCUMENT": "¿Qué documentos no se pudieron leer?",
    "DUPLICATE_DOCUMENT": "¿Qué documentos se han entregado más de una vez?",
    "CLAIM_ABOVE_CALL_MAXIMUM": "¿Qué importe máximo financiable publica la convocatoria?",
    "PROMPT_INJECTION_ATTEMPT": "¿Qué documento contiene instrucciones dirigidas a un sistema?",
}
ALWAYS = ("¿Qué periodo de ejecución declara la memoria?", "¿Qué conceptos de gasto declara la memoria y por qué importe?", "¿Qué entidad emite las facturas del expediente?")


def suggested(rule_ids: Column, most: int = 5, questions: Mapping[str, str] = RULE_QUESTIONS, always: Sequence[str] = ALWAYS) -> Column:
    """Questions for the rules that fired, then those that always help."""
    known = F.create_map(*[F.lit(x) for kv in questions.items() for x in kv])
    asked = F.filter(F.transform(F.array_distinct(rule_ids), lambda r: F.try_element_at(known, r)), lambda q: q.isNotNull())
    fallback = F.array_except(F.array(*[F.lit(q) for q in always]), asked)
    return F.slice(F.concat(asked, fallback), 1, most)


def grounded_answer(hits: DataFrame, question: str, generate: Callable[[str, list[tuple[str, str]]], tuple[str, list[str]]] | None, calls_left: int, most: int = 8, budget: int = 6000) -> dict:
    """A cited answer over the first hits (chunk_id, text, position): stops
    without budget, screens passages, bounds the context, and refuses answers
    that cite what wasn't given.  ``most`` bounds what comes to the driver."""
    if calls_left <= 0:
        return {"status": "BUDGET_EXHAUSTED", "answer": None, "citations": []}
    clean = hits.where(~text.screened(F.col("text"))).orderBy("position").limit(most).select("chunk_id", "text").collect()
    used, room = [], budget
    for r in clean:
        if room > 0:
            used.append((r["chunk_id"], r["text"][:room]))
            room -= len(r["text"])
    if not used:
        return {"status": "NO_EVIDENCE", "answer": None, "citations": []}
    if generate is None:
        return {"status": "DISABLED", "answer": None, "citations": [c for c, _ in used]}
    answer, cited = generate(question, used)
    cited = list(dict.fromkeys(cited))
    if not cited or set(cited) - {c for c, _ in used}:
        return {"status": "UNSUPPORTED", "answer": None, "citations": []}
    return {"status": "ANSWERED", "answer": answer, "citations": cited}
