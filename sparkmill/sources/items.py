"""Question sets as one kind of item: id, question, choices, answer, and what a set has besides. Rows come from local exports of the sets."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparkmill.functions import text as T

# The subjects of the medical part of the set.
MMLU_SUBJECTS = ["anatomy", "clinical_knowledge", "college_medicine", "medical_genetics", "professional_medicine", "virology"]


def _text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _letter(place: Column, other: Column) -> Column:
    """The letter of a place from 0 to 3, else what other says."""
    return F.when((place >= 0) & (place <= 3), F.char(65 + place)).otherwise(other)


def medqa(rows: DataFrame) -> DataFrame:
    """rows: id, sent1, sent2, ending0 to ending3, label. A second sentence follows on a line of its own."""
    question = F.when(_text("sent2") != "", F.trim(F.concat(_text("sent1"), F.lit("\n"), _text("sent2")))).otherwise(_text("sent1"))
    choices = F.array(*[F.coalesce(F.col(f"ending{i}").cast("string"), F.lit("")) for i in range(4)])
    label = F.col("label").cast("string")
    return rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), question.alias("question"), choices.alias("choices"), _letter(label.try_cast("int"), F.coalesce(label, F.lit("None"))).alias("answer"))


def medmcqa(rows: DataFrame) -> DataFrame:
    """rows: id, question, opa to opd, cop (0 to 3), answer; the answer counts where cop is not a place."""
    choices = F.array(*[F.col(c).cast("string") for c in ("opa", "opb", "opc", "opd")])
    answer = F.col("answer").cast("string") if "answer" in rows.columns else F.lit("")
    return rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), _text("question").alias("question"), choices.alias("choices"), _letter(F.col("cop").cast("string").try_cast("int"), T.gold_letter(answer)).alias("answer"))


def pubmedqa(rows: DataFrame) -> DataFrame:
    """rows: pubid, question, context, long_answer, final_decision; rows whose label is neither yes, no nor maybe go."""
    label = T.yes_no_maybe(F.col("final_decision").cast("string"))
    items = rows.select(
        F.col("pubid").cast("string").alias("id"), _text("question").alias("question"), flatten_contexts(_text("context")).alias("context"), _text("context").alias("context_stored"),
        _text("long_answer").alias("long_answer"), label.alias("answer"),
    )
    return items.where("answer <> ''")


def mmlu(rows: DataFrame, subjects: list[str] | None = None) -> DataFrame:
    """rows: subject, position, question, choices, answer (a place or a letter). The id is the subject and the row's number in its subject, by position."""
    number = F.row_number().over(Window.partitionBy("subject").orderBy("position")) - 1  # subjects are sets of a few hundred rows
    answer = F.trim(F.col("answer").cast("string"))
    place = F.coalesce(answer.try_cast("int"), F.when(F.length(answer) == 1, F.ascii(F.upper(answer)) - 65))
    some = rows.where(F.col("subject").isin(subjects or MMLU_SUBJECTS)).withColumn("_n", number)
    return some.select(F.concat_ws("_", "subject", F.col("_n").cast("string")).alias("id"), "subject", _text("question").alias("question"), F.col("choices").cast("array<string>").alias("choices"), _letter(place, answer).alias("answer"))


def flatten_contexts(text: Column | str) -> Column:
    """Contexts joined by blank lines of a text that is a Python dict with a list `contexts`; any other text, a broken dict among them, is itself."""

    def flat(raw: str | None) -> str:
        raw = (raw or "").strip()
        if not (raw.startswith("{") and "contexts" in raw):
            return raw
        try:
            found = ast.literal_eval(raw)
            parts = found.get("contexts") if isinstance(found, dict) else None
        except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
            return raw
        return "\n\n".join(str(p).strip() for p in parts if p) if isinstance(parts, list) and parts else raw

    @pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(flat)

    return each(text)


def retrieval_query(question: Column, context: Column | None = None, chars: int = 4000) -> Column:
    """The question alone, or with so many characters of its abstract (500 at least, 12,000 at most)."""
    q = F.trim(F.coalesce(question, F.lit("")))
    if context is None:
        return q
    c = F.substring(F.trim(F.coalesce(context, F.lit(""))), 1, max(500, min(12_000, chars)))
    return F.when(c == "", q).when(q == "", c).otherwise(F.concat(q, F.lit("\n\n"), c))


def query_with_choices(question: Column, choices: Column, chars: int = 3500) -> Column:
    """The question and so many characters of its choices, a JSON list or object; the question alone where there are none."""
    q, lines = F.trim(F.coalesce(question, F.lit(""))), T.option_lines(choices)
    listed = F.when(F.trim(choices).startswith("["), F.transform(lines, lambda x: F.trim(F.substr(x, F.lit(4))))).otherwise(lines)
    blob = F.substring(F.array_join(listed, " "), 1, chars)
    return F.when((q == "") | (F.coalesce(blob, F.lit("")) == ""), q).otherwise(F.concat(q, F.lit("\n\nAnswer choices:\n"), blob))
