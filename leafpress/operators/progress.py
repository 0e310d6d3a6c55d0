"""Progress events: parsing lines, tokens, durations, rates."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafpress.functions import charclass as C

#: The weight of the newest rate, and the least time between two counts.
ALPHA, LEAST_SECONDS = 0.35, 1e-6


def int_token(text: Column) -> Column:
    """A whole number, after commas and semicolons, then percent signs, at its end are cut; else null."""
    t = F.regexp_replace(F.regexp_replace(C.strip(text), "[,;]++$", ""), "%++$", "")
    return F.when(t.rlike("^-?[0-9]+$"), t.try_cast("int"))


def parse(line: Column) -> Column:
    """struct(percent, stage) of a progress line, JSON or text; null if it is neither."""
    raw = F.from_json(C.strip(line), "struct<percent:string,stage:string>", {"mode": "PERMISSIVE"})
    as_text = F.get_json_object(C.strip(line), "$.percent")
    quoted = line.rlike('"percent"[\\x09\\x0a\\x0d ]*:[\\x09\\x0a\\x0d ]*"')
    whole = F.coalesce(F.when(as_text.rlike("^-?[0-9]+$"), as_text.try_cast("int")), F.when(~quoted & as_text.rlike("^-?[0-9.eE+-]+$"), as_text.try_cast("double").try_cast("int")), F.when(quoted, int_token(as_text)))
    named = line.rlike('"stage"[\\x09\\x0a\\x0d ]*:[\\x09\\x0a\\x0d ]*"') & (C.strip(raw["stage"]) != "")
    from_json = F.when(F.startswith(C.strip(line), F.lit("{")) & named & whole.isNotNull(), F.struct(whole.alias("percent"), raw["stage"].alias("stage")))
    at = F.regexp_extract(line, "(?i)^progress:\\s*([0-9]+%?)\\s+(.*)$", 0)
    percent = int_token(F.regexp_extract(line, "(?i)^progress:\\s*([0-9]+%?)\\s+(.*)$", 1))
    from_text = F.when((at != "") & percent.isNotNull(), F.struct(percent.alias("percent"), F.regexp_extract(line, "(?i)^progress:\\s*([0-9]+%?)\\s+(.*)$", 2).alias("stage")))
    return F.coalesce(from_json, from_text)


def stage_tokens(stage: Column) -> Column:
    """struct(label, tokens): words without an equals sign, and the others as a map; of a repeated key the last counts."""
    words = F.filter(F.split(stage, f"[{C.SPACE}]+"), lambda w: w != "")
    label = F.array_join(F.filter(words, lambda w: ~F.contains(w, F.lit("="))), " ")
    pairs = F.filter(F.transform(words, lambda w: F.struct(F.lower(F.substring_index(w, "=", 1)).alias("k"), F.regexp_replace(F.regexp_replace(w, "^[^=]*=", ""), "[,;]++$", "").alias("v"), F.contains(w, F.lit("=")).alias("is"))), lambda p: p["is"] & (p["k"] != ""))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.struct(F.when(label == "", C.strip(stage)).otherwise(label).alias("label"), last.alias("tokens"))


def event(percent: Column, stage: Column) -> Column:
    return F.struct(F.least(F.lit(100), F.greatest(F.lit(0), percent)).alias("percent"), stage.alias("stage"))


@F.pandas_udf(T.StringType())
def ascii_json(text: pd.Series) -> pd.Series:
    """JSON with its keys in order and everything outside ASCII escaped."""
    return text.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=True, separators=(",", ":"), sort_keys=True))


def event_line(percent: Column, stage: Column, jsonl: bool = False) -> Column:
    e = event(percent, stage)
    return ascii_json(F.to_json(e)) if jsonl else F.format_string("Progress: %d%% %s", e["percent"], e["stage"])


def duration(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; negative durations count as none."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))


def percentage(ratio: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", ratio * 100), F.lit("n/a")) if ratio is not None else F.lit("n/a")


def ewma(events: DataFrame, keys: list[str], ts: str = "seconds", counter: str = "counter") -> DataFrame:
    """keys, ts, counter, rate: the smoothed rate after each event, by key, in order of time.

    A rate is updated where the counter grows beyond its largest value so far at least LEAST_SECONDS after the last
    growth; the first rate seeds it. A fold over a key's events, in time and memory in proportion to them.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(ts).cast("double").alias("s"), F.col(counter).cast("double").alias("c"))))
    out = events.groupBy(*keys).agg(rows.alias("rows"))
    rates = smoothed(F.transform("rows", lambda x: x.s), F.transform("rows", lambda x: x.c))
    zipped = F.zip_with("rows", rates, lambda x, r: F.struct(x.s.alias("s"), x.c.alias("c"), r.alias("rate")))
    return out.select(*keys, F.explode(zipped).alias("x")).select(*keys, F.col("x.s").alias(ts), F.col("x.c").alias(counter), F.col("x.rate").alias("rate"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def smoothed(seconds: pd.Series, counters: pd.Series) -> pd.Series:
    """The smoothed rate after each event, of arrays in order of time; null until there is one."""

    def one(s, c) -> list[float | None]:
        at, most, rate, out = None, None, None, []
        for x, n in zip(s, c, strict=True):
            n = None if n is None or n != n else n
            if most is None:
                at, most = x, n
            elif n is not None and n > most:
                if x - at >= LEAST_SECONDS:
                    now = (n - most) / (x - at)
                    rate = now if rate is None else ALPHA * now + (1 - ALPHA) * rate
                at, most = x, n
            out.append(rate)
        return out

    return pd.Series([one(s, c) for s, c in zip(seconds, counters, strict=True)])


def eta(events: DataFrame) -> DataFrame:
    """events (run_id, seconds, percent) with elapsed and eta: the time that the rest takes at the mean pace, null at 0 %."""
    elapsed = F.col("seconds") - F.min("seconds").over(W.partitionBy("run_id"))
    return events.withColumn("elapsed", elapsed).withColumn("eta", F.when(F.col("percent") > 0, F.col("elapsed") * (100 - F.col("percent")) / F.col("percent")))


def stage_timings(events: DataFrame) -> DataFrame:
    """(run_id, seconds, pages, pages_per_second): 0 where no rate can be computed. events: run_id, seconds, pages."""
    out = events.groupBy("run_id").agg((F.max("seconds") - F.min("seconds")).alias("seconds"), F.max("pages").alias("pages"))
    return out.withColumn("pages_per_second", F.coalesce(F.when(F.col("seconds") > 0, F.col("pages") / F.col("seconds")), F.lit(0.0)))


def batch_outcome(results: DataFrame) -> DataFrame:
    """(failed, exit_code): a single document's code, or 1 if any of several failed. results: doc_id, exit_code."""
    return results.agg(F.count_if(F.col("exit_code") != 0).alias("failed"), F.when(F.count(F.lit(1)) == 1, F.max("exit_code")).otherwise((F.count_if(F.col("exit_code") != 0) > 0).cast("int")).alias("exit_code"))
