"""Model calls as table work.

The model is an injected function ``call_fn(payload: str) -> dict`` with the keys ``content`` (a list of
``{"type", "text"}`` blocks), ``tokens_in`` and ``tokens_out``. Around it everything is a plan: rows are
packed into request rows, the request text is built by expressions, only that text crosses to Python, and
the answer is parsed and matched to its rows by expressions again. Results are written before they are
used, so no later action pays for a call twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import DEFAULT_PRICE
from ..functions.text import first_text_block, json_text, parse_model_json, truncate_text
from ..storage import in_slices, materialise, new_folder, spread
from .positions import HASH_SHIFT, ORDINAL_SHIFT
from .sampling import budget_gate
from .spend import price_table, with_call_cost

CallFn = Callable[[str], dict]

BUCKET_ROWS = 4096

RESPONSE = (
    "content array<struct<type:string,text:string>>, tokens_in bigint, tokens_out bigint, "
    "latency_s double, ts string, call_error string"
)


@dataclass(frozen=True)
class Caller:
    """How a model is called: the function, its name, retries, calls in flight per task, and the spend limits of a run.

    With more than one call in flight ``call_fn`` is run by several threads of a task at once.
    """

    call_fn: CallFn
    model: str
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    default_price: tuple[float, float] = DEFAULT_PRICE
    tries: int = 3
    wait_s: float = 3.0
    cap_usd: float | None = None
    spent_usd: float = 0.0
    est_call_usd: float = 0.0
    in_flight: int = 4


def request_column(caller: Caller) -> Callable[[Column], Column]:
    """The call as a column function over request texts. A failing call yields an error text, not a failed job.

    A task keeps ``in_flight`` calls going at a time, since a call waits for its answer far longer than it computes; responses come in the
    order of the requests. Retries wait in their own place, so one slow request does not hold up the others.
    """
    call_fn, tries, wait_s, in_flight = caller.call_fn, caller.tries, caller.wait_s, caller.in_flight

    def answered(payload: str) -> tuple:
        started, answer, error = time.time(), None, None
        for attempt in range(tries):
            try:
                answer, error = call_fn(payload), None
                break
            except Exception as problem:  # noqa: BLE001 - whatever a client raises is recorded
                error = (str(problem) or type(problem).__name__)[:200]
                if attempt + 1 < tries:
                    time.sleep(wait_s)
        answer = answer or {}
        return (
            answer.get("content"),
            answer.get("tokens_in"),
            answer.get("tokens_out"),
            round(time.time() - started, 2),
            time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(started)),
            error,
        )

    @F.pandas_udf(RESPONSE)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight, thread_name_prefix="call") as pool:
            for payloads in in_slices(batches):
                out = list(pool.map(answered, payloads))
                names = ["content", "tokens_in", "tokens_out", "latency_s", "ts", "call_error"]
                frame = pd.DataFrame(out, columns=names)
                yield frame.astype({"tokens_in": "Int64", "tokens_out": "Int64"})

    return call.asNondeterministic()


def pack(rows: DataFrame, id_column: str, size: int) -> DataFrame:
    """Request rows with up to ``size`` input rows each, in an array ``rows``.

    Ids must be unique. Rows are dealt by id to buckets of about ``BUCKET_ROWS`` rows and numbered inside a bucket,
    so no global sort is needed and a rerun packs the same rows together. Single-row requests need no
    shuffle, unless they come in fewer files than there are cores.
    """
    row = F.struct(*[F.col(c) for c in rows.columns])
    if size == 1:
        request = F.xxhash64(id_column)
        return spread(rows).select(request.alias("request"), F.array(row).alias("rows"))
    buckets = rows.agg(F.greatest(F.ceil(F.count("*") / BUCKET_ROWS), F.lit(1))).scalar()
    in_bucket = Window.partitionBy("_bucket").orderBy("_id")
    numbered = rows.select(
        row.alias("row"), F.col(id_column).alias("_id"), F.pmod(F.xxhash64(id_column), buckets).alias("_bucket")
    ).withColumn("_batch", F.floor((F.row_number().over(in_bucket) - 1) / size))
    packed = numbered.groupBy("_bucket", "_batch").agg(F.array_sort(F.collect_list(F.struct("_id", "row"))).alias("_rows"))
    request = F.col("_batch") * buckets + F.col("_bucket")
    return packed.select(request.cast("bigint").alias("request"), F.col("_rows.row").alias("rows"))


def batch_payload(id_column: str, text_column: str, length: int | None = None) -> Callable[[Column], Column]:
    """Request text of a batch: a JSON array of {id, text}."""
    def build(rows: Column) -> Column:
        def item(row: Column) -> Column:
            text = row[text_column] if length is None else truncate_text(row[text_column], length)
            return F.struct(row[id_column].cast("string").alias("id"), text.alias("text"))

        return json_text(F.transform(rows, item))

    return build


def infer_batches(
    rows: DataFrame,
    caller: Caller,
    id_column: str,
    payload: Callable[[Column], Column],
    size: int,
    purpose: str,
    partitions: int | None = None,
    path: str | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Call the model once per request and store every response with the rows it was asked for.

    ``payload`` builds the request text from the array of rows. ``partitions`` spreads the requests; how
    many run at once is the cluster's slots times ``Caller.in_flight``, and a lost executor repeats only its own small partition. With a
    spend cap, requests beyond the budget are stored as ``deferred`` and never sent. ``keep`` names the columns of the rows that are
    stored with a response (default: all). The request text is built where the call is made, so it is neither shuffled nor written.
    """
    requests = pack(rows, id_column, size)
    if partitions is None and size > 1:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if partitions:
        requests = requests.repartition(partitions, "request")
    response = request_column(caller)(payload(F.col("rows")))
    if caller.cap_usd is None:
        called = requests.withColumn("response", response).withColumn("admission", F.lit("admit"))
    else:
        # the gate reads its input twice, so the requests are fixed first
        fixed = materialise(requests, name=f"{purpose}-requests")
        cost = F.lit(caller.est_call_usd).cast("decimal(18,6)")
        shift = HASH_SHIFT if size == 1 else ORDINAL_SHIFT
        gated = budget_gate(
            fixed.withColumn("_cost", cost), "request", "_cost", caller.cap_usd, caller.spent_usd, shift=shift
        )
        go = gated.where(F.col("admission") == "admit").withColumn("response", response)
        wait = gated.where(F.col("admission") != "admit").withColumn("response", F.lit(None).cast(f"struct<{_types()}>"))
        called = go.unionByName(wait).drop("_cost")
    answered = called.withColumn("purpose", F.lit(purpose)).withColumn("model", F.lit(caller.model))
    target = path or new_folder(rows.sparkSession, f"{purpose}-responses")
    if keep is not None:
        answered = answered.withColumn("rows", F.transform("rows", lambda row: F.struct(*[row[c].alias(c) for c in keep])))
    return materialise(answered, target)


def _types() -> str:
    parts = RESPONSE.replace("struct<type:string,text:string>", "S").split(", ")
    return ",".join(p.replace(" ", ":", 1) for p in parts).replace("S", "struct<type:string,text:string>")


def call_error() -> Column:
    deferred = F.when(F.col("admission") != "admit", "deferred: spend cap reached")
    return F.coalesce(F.col("response.call_error"), deferred)


def answers_by_id(
    responses: DataFrame, schema: str, items: str, id_column: str, missing: str = "missing from response"
) -> DataFrame:
    """Every requested row with the answer that names its id, else an error.

    Matching happens inside a request row, so nothing is shuffled. Answers nobody asked for are ignored; of two answers
    for one id the last counts.
    """
    parsed = parse_model_json(first_text_block(F.col("response.content")), schema)[items]
    # parsed once per request, before its rows are spread out
    requests = responses.select("rows", parsed.alias("items"), call_error().alias("call_error"))
    flat = requests.select(F.explode("rows").alias("row"), "items", "call_error")
    mine = F.filter("items", lambda item: item["id"].cast("string") == F.col("row")[id_column].cast("string"))
    answer = F.try_element_at(mine, F.lit(-1))
    error = F.coalesce(
        F.col("call_error"),
        F.when(F.col("items").isNull(), "malformed response").when(F.col("answer").isNull(), missing),
    )
    return flat.withColumn("answer", answer).select("row.*", "answer", error.alias("error"))


def single_answers(responses: DataFrame, schema: str, needed: str, usage: bool = False) -> DataFrame:
    """Every row of a one-row request with its parsed answer; ``needed`` names a field that must be there.

    With ``usage`` the tokens of its call come as ``tin`` and ``tout``.
    """
    parsed = parse_model_json(first_text_block(F.col("response.content")), schema)
    used = [F.coalesce(F.col(f"response.tokens_{way}"), F.lit(0)).alias(f"t{way}") for way in ("in", "out")] if usage else []
    flat = responses.select(F.get("rows", F.lit(0)).alias("row"), parsed.alias("answer"), call_error().alias("call_error"), *used)
    bad = F.col("answer").isNull() | F.col("answer")[needed].isNull()
    error = F.coalesce(F.col("call_error"), F.when(bad, "malformed response"))
    return flat.select("row.*", "answer", error.alias("error"), *(["tin", "tout"] if usage else []))


def call_ledger(responses: DataFrame, caller: Caller, prompt_version: str) -> DataFrame:
    """One ledger row per call that got an answer: tokens, latency and cost."""
    calls = responses.where(F.col("response.content").isNotNull()).select(
        F.col("response.ts").alias("ts"),
        "purpose",
        F.lit(prompt_version).alias("prompt_version"),
        "model",
        F.coalesce(F.col("response.tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.col("response.tokens_out"), F.lit(0)).alias("tokens_out"),
        F.col("response.latency_s").alias("latency_s"),
    )
    prices = price_table(responses.sparkSession, caller.prices)
    return with_call_cost(calls, prices, caller.default_price).withColumn("cost_usd", F.col("cost_usd").cast("double")).select(
        "ts", "purpose", "prompt_version", "model", "tokens_in", "tokens_out", "latency_s", "cost_usd"
    )
