"""The exchange with a model. Only cleared texts reach it, through a transport that the caller brings;
the mock transports are column functions."""

from __future__ import annotations

import http.client
import json
import re
import socket
import ssl
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.config import Options
from cloakframe.functions import model_api, tokens
from cloakframe.functions.text import let
from cloakframe.sources import scratch

#: Takes a request body, returns (HTTP status, body). Built on each worker by a factory.
Transport = Callable[[str], tuple[int, str]]


def http_transport(url: str, key: str, timeout: float) -> Callable[[], Transport]:
    """A factory of transports that post over HTTP, TLS verified."""

    def make() -> Transport:
        context = ssl.create_default_context()

        def post(body: str) -> tuple[int, str]:
            headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
            request = urllib.request.Request(url, body.encode(), headers)
            try:
                with urllib.request.urlopen(request, timeout=timeout, context=context) as answer:
                    return answer.status, answer.read().decode("utf-8", "replace")
            except urllib.error.HTTPError as e:
                return e.code, e.read().decode("utf-8", "replace")[: model_api.ERROR_CHARS]

        return post

    return make


def failure(error: Exception) -> str:
    """Why nothing came back. The library wraps what happens while it connects, so the cause is unwrapped first."""
    while isinstance(error, urllib.error.URLError) and isinstance(error.reason, Exception):
        error = error.reason
    kinds = ((TimeoutError, "timeout"), (ssl.SSLError, "TLS"), (ConnectionRefusedError, "nothing listens there"), (socket.gaierror, "unknown host"), ((ConnectionResetError, http.client.HTTPException), "broken response"))
    return next((name for kind, name in kinds if isinstance(error, kind)), f"unreachable: {type(error).__name__}")


#: Failures after which a request is tried again, within the task.
AGAIN = ("timeout", "broken response", "nothing listens there")
AGAIN_STATUS = (429, 500, 502, 503, 504)
LEDGER = "digest string, status int, answer string, reason string, seconds double"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def recorded(spark: SparkSession, ledger: str) -> DataFrame:
    """What a ledger has, one row for each digest: a good answer if there is one."""
    good = F.col("status").between(200, 299).cast("int")
    rows = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    row = F.struct(good.alias("good"), "seconds", "status", "answer", "reason")
    return rows.groupBy("digest").agg(F.max(row).alias("r")).select("digest", F.col("r.status").alias("status"), F.col("r.answer").alias("answer"), F.col("r.reason").alias("reason"), F.col("r.seconds").alias("seconds"))


def send(requests: DataFrame, factory: Callable[[], Transport], ledger: str, threads: int = 4, tries: int = 3, wait: float = 0.5, batch: int = 64) -> None:
    """Post the bodies of requests (digest, body) that the ledger has no good answer to, and write the answers to the ledger.

    Requests are dealt by digest, so an attempt of a task has the requests of the attempt before it: it reads what that one wrote
    under the partition's number, and goes on from there. Each batch is a file that is renamed when it is whole. `threads` requests of
    a task are open at once; what may pass is tried again after a pause."""
    spark = requests.sparkSession
    store, at = filesystem(ledger)
    store.create_dir(at, recursive=True)
    done = recorded(spark, ledger).where(F.col("status").between(200, 299)).select("digest")
    run_id = uuid.uuid4().hex[:12]
    todo = requests.join(done, "digest", "left_anti").select("digest", "body").repartition("digest")

    def one(transport: Transport, body: str) -> tuple[int, str, str | None, float]:
        began, status, answer, reason = time.monotonic(), 0, "", None
        for k in range(tries):
            if k:
                time.sleep(wait * 2 ** (k - 1))
            try:
                status, answer = transport(body)
                reason = None
            except (OSError, http.client.HTTPException) as e:
                status, answer, reason = 0, "", failure(e)
            if reason not in AGAIN and status not in AGAIN_STATUS:
                break
        return status, answer, reason, round(time.monotonic() - began, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(ledger)
        folder = f"{at}/{run_id}/{TaskContext.get().partitionId()}"
        store.create_dir(folder, recursive=True)
        known: set[str] = set()
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.path.endswith(".parquet"):
                known |= set(pq.read_table(info.path, columns=["digest"], filesystem=store).column(0).to_pylist())
        transport, n = factory(), 0
        with ThreadPoolExecutor(threads) as pool:
            for rows in batches:
                for start in range(0, len(rows), batch):
                    some = [(d, b) for d, b in zip(*(c.to_pylist() for c in rows.slice(start, batch).columns), strict=True) if d not in known]
                    if some:
                        made = list(pool.map(lambda x: one(transport, x[1]), some))
                        columns = [pa.array([d for d, _ in some]), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True))]
                        name = uuid.uuid4().hex
                        pq.write_table(pa.table(columns, [c.split()[0] for c in LEDGER.split(", ")]), f"{folder}/_{name}", filesystem=store)
                        store.move(f"{folder}/_{name}", f"{folder}/{name}.parquet")
                        n += len(some)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    todo.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number; the answers are in the ledger


def exchange(cleared: DataFrame, key: str, text: str, options: Options, factory: Callable[[], Transport], ledger: str | None = None, **how: float) -> DataFrame:
    """(key, text, sent, reason, seconds): answers to the texts. A failed row has a null text and its reason.

    Equal texts are one request, and no request is repeated to which the ledger, a folder that all workers reach, has a good
    answer: neither by a task that is tried again nor by a later run. Without a folder, one is made in the shared folder."""
    why = options.unset()
    if why:
        return cleared.select(key, F.lit(None).cast("string").alias("text"), F.lit(False).alias("sent"), F.lit(why).alias("reason"), F.lit(None).cast("double").alias("seconds"))
    spark = cleared.sparkSession
    ledger = ledger or f"{scratch.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    body = model_api.request_body(F.col(text), options.endpoint().model, options.max_tokens)
    asked = cleared.select(key, body.alias("body")).withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    send(asked.groupBy("digest").agg(F.first("body").alias("body")), factory, ledger, **how)
    answers = asked.drop("body").join(recorded(spark, ledger), "digest", "left")
    content = F.when(F.col("status").between(200, 299), model_api.response_text(F.col("answer")))
    unread = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.when(F.trim("answer") == "", "no text in the response").otherwise(F.concat(F.lit("no text in the response: "), model_api.excerpt(F.col("answer")))))
    reason = F.coalesce("reason", F.when(F.col("status").between(200, 299), unread).otherwise(model_api.http_cause(F.col("status"), F.col("answer"))))
    out = answers.select(key, F.when(reason.isNull(), content).alias("text"), F.lit(True).alias("sent"), reason.alias("reason"), "seconds")
    out._ledger = ledger
    return out


# --- mock transports, as columns ----------------------------------------------------------------


def echo(text: Column) -> Column:
    return text


def mangle(text: Column) -> Column:
    """The first placeholder in lower case and the second without delimiters, one occurrence each."""

    def first(source: Column, what: Column, by: Column) -> Column:
        at = F.locate(what, source) if isinstance(what, str) else F.position(what, source)
        return F.when(at > 0, F.concat(F.substring(source, F.lit(1), at - 1), by, F.substring(source, at + F.length(what), F.length(source)))).otherwise(source)

    def both(found: Column) -> Column:
        one, two = F.get(found, F.lit(0)), F.get(found, F.lit(1))
        lowered = F.when(one.isNotNull(), first(text, one, F.lower(one))).otherwise(text)
        return let(lowered, lambda once: F.when(two.isNotNull(), first(once, two, F.regexp_replace(two, "^<<|>>$", ""))).otherwise(once))

    return let(tokens.tokens(text), both)


def drop(text: Column) -> Column:
    """Without the first placeholder's occurrences."""
    one = F.get(tokens.tokens(text), F.lit(0))
    return F.when(one.isNotNull(), F.replace(text, one, F.lit(""))).otherwise(text)


def mock_transport(kind: str, seconds: float = 0.0) -> Callable[[], Transport]:
    """A factory of transports that answer in place of a server: echo, native, slow (echo after `seconds`),
    missing-model, badauth."""

    def make() -> Transport:
        def post(body: str) -> tuple[int, str]:
            user = next(m["content"] for m in json.loads(body)["messages"] if m["role"] == "user")
            if kind == "slow":
                time.sleep(seconds)
            if kind == "missing-model":
                return 404, '{"error": {"message": "model not found"}}'
            if kind == "badauth":
                return 401, '{"error": {"message": "invalid token"}}'
            if kind == "native":
                return 200, json.dumps({"message": {"role": "assistant", "content": user}, "done": True})
            return 200, json.dumps({"choices": [{"message": {"role": "assistant", "content": user}}]})

        return post

    return make
