"""Logged model calls: replies put together from their event streams, and what is done after a failed attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.passages import error_kind

# Answers that are worth another try, the first pause and the longest, in seconds.
RETRIED = (408, 429, 500, 502, 503, 504)
FIRST_PAUSE, LONGEST_PAUSE = 5.0, 120.0
EVENT = "id string, model string, code string, message string, error struct<code:string,type:string,message:string>, choices array<struct<delta:struct<content:string,reasoning_content:string>,message:struct<content:string,reasoning_content:string>,finish_reason:string>>, usage string"


def assemble(lines: DataFrame) -> DataFrame:
    """(reply, content, reasoning, finish_reason, usage, id, model, events, outcome) of streams (reply, seq, line).

    Events are ``data:`` lines up to ``[DONE]``; other lines are passed by. The first id and model and the last usage and
    finish reason count. The stream ends at what can't be read or reports an error: outcome is ``complete`` if a finish
    reason came before that, else ``broken``, or ``account`` or ``request`` by the error's kind. A reply's own text is the
    unit that is gathered.
    """
    data = F.trim(F.substring(F.trim("line"), F.lit(6), F.char_length("line")))
    events = lines.filter(F.trim("line").startswith("data:")).select("reply", "seq", data.alias("data"))
    ends = events.groupBy("reply").agg(F.min(F.when(F.col("data") == "[DONE]", F.col("seq"))).alias("done"))
    ev = F.col("e")
    read = events.join(ends, "reply").filter(F.col("done").isNull() | (F.col("seq") < F.col("done"))).withColumn("ok", F.try_parse_json("data").isNotNull()).withColumn("e", F.from_json("data", EVENT))
    own = F.when(ev["error"].isNotNull(), F.concat_ws(": ", F.coalesce(ev["error"]["code"], ev["error"]["type"]), ev["error"]["message"]))
    error = F.coalesce(own, F.when((ev["code"] != "") & (ev["message"] != "") & ev["choices"].isNull(), F.concat_ws(": ", ev["code"], ev["message"])))
    read = read.select("reply", "seq", "ok", "e", F.when(~F.col("ok"), "unreadable").otherwise(error).alias("error"))
    stop = read.groupBy("reply").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("seq", "ok", "error"))).alias("stop"))
    good = read.join(stop, "reply").filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop.seq")))
    said = lambda field: F.array_join(F.transform(F.coalesce(ev["choices"], F.array().cast(_choices())), lambda c: F.coalesce(F.coalesce(c["delta"], c["message"])[field], F.lit(""))), "")
    finish = F.array_compact(F.transform(ev["choices"], lambda c: F.when(c["finish_reason"] != "", c["finish_reason"])))
    rows = good.select("reply", "seq", said("content").alias("content"), said("reasoning_content").alias("reasoning"), F.try_element_at(finish, F.lit(-1)).alias("finish"), F.when(~ev["usage"].isin("", "{}", "null"), ev["usage"]).alias("usage"), F.when(ev["id"] != "", ev["id"]).alias("id"), F.when(ev["model"] != "", ev["model"]).alias("model"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), "")
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    made = rows.groupBy("reply").agg(
        joined("content").alias("content"), joined("reasoning").alias("reasoning"), F.max_by("finish", known("finish")).alias("finish_reason"), F.max_by("usage", known("usage")).alias("usage"),
        F.min_by("id", known("id")).alias("id"), F.min_by("model", known("model")).alias("model"), F.count("*").alias("events"),
    )
    whole = lines.select("reply").distinct().join(stop, "reply", "left").join(made, "reply", "left")
    kind = F.when(F.col("stop.ok"), error_kind(F.col("stop.error"))).otherwise("")
    outcome = F.when(kind.isin("account", "request"), kind).when(F.col("finish_reason").isNotNull(), "complete").otherwise("broken")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return whole.select("reply", empty("content"), empty("reasoning"), "finish_reason", "usage", empty("id"), empty("model"), F.coalesce("events", F.lit(0)).alias("events"), outcome.alias("outcome"))


def _choices() -> str:
    return "array<struct<delta:struct<content:string,reasoning_content:string>,message:struct<content:string,reasoning_content:string>,finish_reason:string>>"


def pause(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait after an attempt (from 1): what the answer asks for, else twice as long each time; 0 to LONGEST_PAUSE."""
    doubled = FIRST_PAUSE * F.pow(F.lit(2.0), F.least(attempt, F.lit(1000)) - 1)
    return F.greatest(F.lit(0.0), F.least(F.lit(LONGEST_PAUSE), F.coalesce(retry_after.try_cast("double"), doubled)))


def decisions(attempts: DataFrame, *, retries: int = 6) -> DataFrame:
    """``attempts`` (attempt, http, message, retry_after, ...) with kind, action and pause of each failed attempt.

    An error of the account or the request stops the call, whatever its code; a passing one, or a code in RETRIED, is
    tried again up to ``retries`` times and then given up; what is none of these fails.
    """
    kind = error_kind(F.col("message"))
    busy = F.coalesce(F.col("http").isin(*RETRIED), F.lit(False)) | (kind == "passing")
    action = F.when(kind.isin("account", "request"), F.concat(F.lit("stop: "), kind)).when(busy & (F.col("attempt") <= retries), "retry").when(busy, "give up").otherwise("fail")
    made = attempts.withColumn("kind", kind).withColumn("action", action)
    return made.withColumn("pause", F.when(F.col("action") == "retry", pause(F.col("attempt"), F.col("retry_after"))))
