"""User functions over tables: recognisers and correctors run in Arrow batches, a failing row never ends the run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import scores
from folioscope.functions.text import normalize_math_latex
from folioscope.operators import filters
from folioscope.sources.scratch import stored

Predict = Callable[[str], str | None]
#: Rows that a backend gets at once.
BATCH = 64


class Backend(Protocol):
    """What make gives: answers to a list of inputs, in order, and an end. A plain function of one input will do as well."""

    def predict(self, values: list) -> list[str | None]: ...

    def unload(self) -> None: ...


def _answers(backend, values: list) -> list[str]:
    """Predictions of a batch. If the batch fails or has the wrong length, its rows are taken one by one; failures and None are ''."""
    one = backend if not hasattr(backend, "predict") else lambda v: backend.predict([v])[0]
    if hasattr(backend, "predict"):
        try:
            said = list(backend.predict(values))
            if len(said) == len(values):
                return [x or "" for x in said]
        except Exception:  # noqa: BLE001  a user's function may fail in any way
            pass
    out = []
    for v in values:
        try:
            out.append(one(v) or "")
        except Exception:  # noqa: BLE001
            out.append("")
    return out


def _recognised(df: DataFrame, make: Callable[[], Backend | Predict], input_col: str, out: str, size: int, error: str | None) -> DataFrame:
    """error: the column that tells why set-up failed in a row's task; None: set-up must work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend, why = None, None
        try:
            backend = make()
        except Exception as e:  # noqa: BLE001
            if error is None:
                raise
            why = str(e)
        try:
            for b in batches:
                values = b.column(input_col).to_pylist()
                said = [""] * len(values) if why is not None else [x for at in range(0, len(values), size) for x in _answers(backend, values[at : at + size])]
                b = b.append_column(out, pa.array(said, pa.string()))
                yield b if error is None else b.append_column(error, pa.array([why] * len(values), pa.string()))
        finally:
            if hasattr(backend, "unload"):
                backend.unload()

    added = [T.StructField(c, T.StringType()) for c in (out, error) if c is not None]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def recognize(df: DataFrame, make: Callable[[], Backend | Predict], input_col: str, out: str = "pred", size: int = BATCH) -> DataFrame:
    """df with a column of predictions. make is called once a task, unload at its end, whether it ends well or not; a failure or None on a row gives ''."""
    return _recognised(df, make, input_col, out, size, None)


def run_backends(df: DataFrame, makers: dict[str, Callable[[], Backend | Predict]], input_col: str, size: int = BATCH) -> DataFrame:
    """All backends over the same rows, with backend, pred and error. Set-up is on executors only, and each row is predicted once.

    A backend whose set-up fails in every task gives one error row; if it fails in some tasks, their rows have the error and an empty pred.
    """
    parts = [_recognised(df, make, input_col, "pred", size, "error").withColumn("backend", F.lit(name)) for name, make in makers.items()]
    rows = stored(reduce(DataFrame.unionByName, parts), "predictions")
    broken = rows.groupBy("backend").agg(F.count_if(F.col("error").isNull()).alias("_n"), F.min("error").alias("error")).where("_n = 0").drop("_n")  # a row a backend
    none = [F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
    failed = broken.select(*none, F.lit("").alias("pred"), "error", "backend")
    return rows.join(F.broadcast(broken.select("backend")), "backend", "left_anti").select(*rows.columns).unionByName(failed)


def score_tracks(df: DataFrame, filter_first: bool = True) -> DataFrame:
    """Rows of (.., gt, pred) twice: track raw as predicted, track post without garbage and normalised, with the four scores.

    filter_first: garbage is judged before normalising (as an evaluator does), else after.
    """
    pred, gt = F.col("pred"), F.col("gt")
    norm = normalize_math_latex(pred)
    post = F.when(filters.is_garbage_latex(pred if filter_first else norm), "").otherwise(norm)
    df = df.withColumn("_post", post)
    both = df.withColumn("_t", F.explode(F.array(F.struct(F.lit("raw").alias("track"), pred.alias("hyp")), F.struct(F.lit("post").alias("track"), F.col("_post").alias("hyp")))))
    both = both.select(*(c for c in df.columns if c != "_post"), "_t.track", "_t.hyp")
    h = F.col("hyp")
    return both.withColumns({"exp_rate": scores.exp_rate(h, gt), "cer": scores.cer(h, gt), "bleu": scores.bleu(h, gt), "edit": F.levenshtein(h, gt)})


def correct_fragments(df: DataFrame, make: Callable[[], Callable[[list[dict]], list[dict]]], key: str = "slide", most: float = 0.30) -> DataFrame:
    """Regions with corrected line_texts and text: the lines of a slide that aren't blank go in one call, as idx and text.

    A line missing from the answer, or changed beyond the edit ratio, keeps its text; other than text rows are never sent.
    """
    lines = df.where("type = 'text'").select(key, "region", F.posexplode("line_texts").alias("line", "old"))
    calls = lines.where(F.trim("old") != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("region", "line", F.col("old").alias("text")))).alias("ls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        correct = make()
        for b in batches:
            rows: list[tuple] = []
            for k, ls in zip(b.column(key).to_pylist(), b.column("ls").to_pylist()):
                try:
                    said = {x["idx"]: x["text"] for x in correct([{"idx": i, "text": x["text"]} for i, x in enumerate(ls)]) or []}
                except Exception:  # noqa: BLE001
                    said = {}
                rows += [(k, x["region"], x["line"], said.get(i)) for i, x in enumerate(ls)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, (b.schema.field(key), *_LINE))], [key, "region", "line", "said"])

    kind = dict(df.dtypes)[key]
    answers = calls.mapInArrow(run, f"{key} {kind}, region long, line int, said string")
    fixed = lines.join(answers, [key, "region", "line"], "left")
    new = F.when(F.col("said").isNull(), F.col("old")).otherwise(scores.edit_ratio_guard(F.col("old"), F.col("said"), most))
    joined = fixed.groupBy(key, "region").agg(F.array_sort(F.collect_list(F.struct("line", new.alias("t")))).alias("ls"))
    joined = joined.select(key, "region", F.transform("ls", lambda x: x["t"]).alias("_new"))
    out = df.join(joined, [key, "region"], "left").withColumn("line_texts", F.coalesce("_new", "line_texts"))
    return out.withColumn("text", F.when(F.col("_new").isNotNull(), F.array_join("_new", "\n")).otherwise(F.col("text"))).select(*df.columns)


_LINE = [pa.field("region", pa.int64()), pa.field("line", pa.int32()), pa.field("said", pa.string())]
