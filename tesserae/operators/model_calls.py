"""Calls of a model in batches, from Spark's tasks: retries, answers by id, single calls, error rows.

A client is a function of a list of items ``{"id", "text"}``; a function that makes one is sent to
the tasks, and each makes its own.  It answers in one of three shapes: an object with the list as
an attribute, a dict with it under that key, or such a dict as JSON.  A task that runs again, as
after a lost executor, calls again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Client = Callable[[list[dict]], Any]

#: Fixed values of the calls that users' results were made with: rows of a batch, retries after
#: the first call, and seconds before the first of them, doubled each time.
BATCH, RETRIES, DELAY = 3, 3, 2.0


def answer_list(response: Any, key: str) -> list:
    """The list of answers in any of the three shapes; anything else is an error."""
    if isinstance(response, str):
        response = json.loads(response)
    found = response.get(key) if isinstance(response, dict) else getattr(response, key, None)
    if not isinstance(found, (list, tuple)):
        raise ValueError(f"the response has no list {key!r}")
    return list(found)


def ask(client: Client, items: list[dict], key: str, retries: int, delay: float) -> tuple[list, int]:
    """The answers to a call and the number of calls that it took; the last error if all fail."""
    for n in range(retries + 1):
        try:
            return answer_list(client(items), key), n + 1
        except Exception:  # noqa: BLE001  (a client may fail in any way)
            if n == retries:
                raise
            time.sleep(delay * 2**n)
    raise AssertionError


def _fields(answer: Any) -> dict:
    if isinstance(answer, dict):
        return answer
    return {k: v for k, v in vars(answer).items() if not k.startswith("_")}


def answers(client: Client, texts: list[str], key: str, retries: int, delay: float) -> list[tuple[dict | None, str | None, int]]:
    """For each text its answer, else an error, and the calls of its batch or its own.

    Items go by their place in the batch as id, so that ids which repeat can't be mixed up.  A batch
    that fails, and answers that it leaves out, are made up for by one call a text, unless the batch
    was that text alone.
    """
    items = [{"id": str(i), "text": t} for i, t in enumerate(texts)]
    found: dict[str, dict] = {}
    calls, failure = retries + 1, "no answer"
    try:
        told, calls = ask(client, items, key, retries, delay)
        for answer in map(_fields, told):
            if str(answer.get("id")) in {x["id"] for x in items}:
                found.setdefault(str(answer["id"]), answer)
    except Exception as e:  # noqa: BLE001
        failure = f"{type(e).__name__}: {e}"
    out: list[tuple[dict | None, str | None, int]] = []
    for item in items:
        own, error, n = found.get(item["id"]), None, calls
        if own is None and len(items) == 1:
            error = failure
        elif own is None:
            n += 1
            try:
                told, _ = ask(client, [item], key, 0, delay)
                own = next((a for a in map(_fields, told) if str(a.get("id", item["id"])) == item["id"]), None)
                error = None if own is not None else "no answer"
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
        out.append((own and {k: v for k, v in own.items() if k != "id"}, error, n))
    return out


def call_in_batches(rows: DataFrame, make_client: Callable[[], Client], result: str, key: str = "results", size: int = BATCH, retries: int = RETRIES, delay: float = DELAY) -> DataFrame:
    """``id, result, error, calls`` of ``id, text``: one row for each row, whatever the client does.

    ``result`` is the struct type of an answer; fields that an answer lacks are null.  A row without
    an answer has a null result and an error.  A null text is an error without a call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client: Client | None = None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            asked = [i for i, t in enumerate(texts) if t is not None]
            told: list[tuple] = [(None, "no text", 0)] * len(texts)
            for at in range(0, len(asked), size):
                some = asked[at : at + size]
                client = client or make_client()
                for i, found in zip(some, answers(client, [texts[i] for i in some], key, retries, delay)):
                    told[i] = found
            columns = [pa.array([None if x[0] is None else json.dumps(x[0]) for x in told], pa.string()), pa.array([x[1] for x in told], pa.string()), pa.array([x[2] for x in told], pa.int32())]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "result", "error", "calls"])

    slim = rows.select(F.col("id").alias("id"), F.col("text").cast("string").alias("text"))
    told = slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, result string, error string, calls int")
    return told.withColumn("result", F.from_json("result", result))


def chunks_from_model(docs: DataFrame, make_client: Callable[[], Client], key: str = "chunks", retries: int = RETRIES, delay: float = DELAY) -> DataFrame:
    """``document_id, chunks, error, calls`` of ``document_id, text``: a call per text, whose answer is the
    list of its chunks; when all calls fail, no chunks and the last error.  A blank text isn't sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client: Client | None = None
        for batch in batches:
            told: list[tuple[list[str], str | None, int]] = []
            for text in batch.column(1).to_pylist():
                if not (text or "").strip():
                    told.append(([], None, 0))
                    continue
                client = client or make_client()
                try:
                    found, calls = ask(client, [{"id": "0", "text": text}], key, retries, delay)
                    told.append(([str(c) for c in found], None, calls))
                except Exception as e:  # noqa: BLE001
                    told.append(([], f"{type(e).__name__}: {e}", retries + 1))
            columns = [pa.array([x[0] for x in told], pa.list_(pa.string())), pa.array([x[1] for x in told], pa.string()), pa.array([x[2] for x in told], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["document_id", "chunks", "error", "calls"])

    slim = docs.select(F.col("document_id").alias("document_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"document_id {slim.schema['document_id'].dataType.simpleString()}, chunks array<string>, error string, calls int")


def verified_duplicates(candidates: DataFrame, make_client: Callable[[], Client] | None, certain: float, **how) -> DataFrame:
    """Candidates ``id, new_text, old_id, old_text, similarity`` with ``is_duplicate, duplicate_of, confidence,
    rationale``: from ``certain`` on without a call, else as the model says.

    A pair that the model gives no answer for is no duplicate, and without a client only certain
    ones are.
    """
    sure = candidates.filter(F.col("similarity") >= certain).select("id", "old_id", F.lit(True).alias("is_duplicate"), F.col("similarity").alias("confidence"), F.lit("similarity").alias("rationale"))
    rest = candidates.filter(F.col("similarity") < certain)
    if make_client is None:
        told = rest.select("id", "old_id", F.lit(False).alias("is_duplicate"), F.lit(None).cast("double").alias("confidence"), F.lit("not checked").alias("rationale"))
    else:
        pair = F.to_json(F.struct(F.col("new_text").alias("new"), F.col("old_text").alias("old"), "similarity"))
        asked = rest.select(F.struct("id", "old_id").alias("id"), pair.alias("text"))
        said = call_in_batches(asked, make_client, "is_duplicate boolean, confidence double, rationale string", **how)
        yes = F.coalesce("result.is_duplicate", F.lit(False))
        told = said.select("id.id", "id.old_id", yes.alias("is_duplicate"), F.col("result.confidence").alias("confidence"), F.coalesce("error", "result.rationale").alias("rationale"))
    return sure.unionByName(told).withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("old_id"))).drop("old_id")
