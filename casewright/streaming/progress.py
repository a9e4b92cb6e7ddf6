"""Progress of solver runs from their output lines, as a stream with one keyed state a run.

Lines are recognised by column expressions, and only recognised ones reach the state. The state of a run is a few numbers: the family of
markers that it counts (the first one seen, locked from then on), the largest announced total, what is done, the latest index, the
phase, and the cases of a batch solver. A run's lines are taken by line number within a micro-batch and batch by batch, so an
announcement split over batches, a restart from the checkpoint, or any number of runs give the same state. A run that says nothing for a stated
time is reported once more with silent = true.

Defined cases: blank and unrecognised lines change nothing; a run without a recognised line isn't reported; a null run_id is a run of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casewright.operators.network import shared_path

#: The forms of the solver's lines. Announced totals; families of lines that stand for one finished contingency, in the
#: order in which they are tried; the end of solving; and the lines of the batch solver.
TOTALS = (r"(?i)(?:total|number)\b[^\d\n]*?(?:contingenc(?:y|ies)|tasks|events)[^\d\n]*?(\d+)", r"(?i)(?:contingenc(?:y|ies)|tasks|events)[^\d\n]*?(?:total|count)[^\d\n]*?(\d+)", r"(?i)(?<![\w-])(\d+)\s+contingencies\b")
INDEXED = (r"(?i)contingency:?\s*(\d+)\s+success", r"(?i)(?:processing|solving|running|completed|finished|starting)\s+contingency\s*#?\s*(\d+)", r"(?i)\bcontingency\s*#?\s*(\d+)\b")
CONTROLLER, SOLVE = r"(?i)\bcontroller\s+iteration\s*=\s*0*1\b", r"(?i)\bpower\s+flow\s+(?:converged|did\s+not\s+converge)"
POST = r"(?i)\b(writing|write)\b.*\b(output|results|files|success)\b|\bpost[- ]?process"
CLASSIFIED = r"\[gpu-batch p\d+\]\s+classified (\d+) cases in \S+ s: (\d+) GPU, (\d+) CPU"
CHUNK, PATHS = r"\[gpu-batch p\d+\]\s+GPU chunk of (\d+) cases", r"\[gpu-batch p\d+\]\s+paths: (\d+) reported from the GPU, (\d+) on the CPU path"

#: Keys of the state that runs share.
BUCKETS = 1024
_SAID = ("classified", "to_batch", "chunk", "by_batch", "by_rest", "indexed", "controller", "solve", "announced", "post")
_STATE = "runs string"  # JSON: a run's number to its state, as in _FIRST
_RESULT = "run_id long, family string, phase string, completed long, total long, latest_index long, batch_cases long, batch_solved long, silent boolean"
_FIRST = (None, "starting", 0, None, None, None, 0)


def _number(pattern: str, group: int = 1):
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit("")).try_cast("bigint")


def marks(lines: DataFrame) -> DataFrame:
    """run_id, line_no and what each recognised line says. Works alike on a batch and on a stream."""
    said = {
        "classified": _number(CLASSIFIED), "to_batch": _number(CLASSIFIED, 2), "chunk": _number(CHUNK), "by_batch": _number(PATHS), "by_rest": _number(PATHS, 2),
        "indexed": F.coalesce(*map(_number, INDEXED)), "controller": F.col("line").rlike(CONTROLLER), "solve": F.col("line").rlike(SOLVE),
        "announced": F.coalesce(*map(_number, TOTALS)), "post": F.col("line").rlike(POST)}
    hit = lambda x: F.coalesce(*(x[c] for c in ("classified", "chunk", "by_batch", "indexed", "announced"))).isNotNull() | x["controller"] | x["solve"] | x["post"]
    # an array of one: a filter on columns would be pushed below them and match every pattern twice
    one = F.array(F.struct(*(c.alias(n) for n, c in said.items())))
    return lines.select("run_id", "line_no", F.explode(F.filter(one, hit)).alias("x")).select("run_id", "line_no", "x.*")


def _fold(state: tuple, classified, to_batch, chunk, by_batch, by_rest, indexed, controller, solve, announced, post) -> tuple:
    """The state after one more line of its run; numbers that a line doesn't say are None or NaN."""
    family, phase, done, total, latest, cases, solved = state
    known = lambda x: x == x and x is not None
    if known(classified):
        return family, "solving", 0, int(classified), None, int(to_batch), 0
    if cases is not None and known(chunk):
        return family, phase, done, total, latest, cases, min(cases, solved + int(chunk))
    if cases is not None and known(by_batch):
        return family, "postprocessing", max(total or 0, int(by_batch) + int(by_rest)), total, latest, cases, solved
    found = None
    if cases is None:
        for n, hit in (("indexed", known(indexed)), ("controller", controller), ("solve", solve)):
            if hit and family in (None, n):
                found = n
                break
    if found:
        return found, "solving", done + 1, total, int(indexed) if found == "indexed" else latest, cases, solved
    if known(announced) and announced > 0 and phase != "postprocessing":
        return family, phase, done, max(total or 0, int(announced)), latest, cases, solved
    if phase == "solving" and post:
        return family, "postprocessing", done, total, latest, cases, solved
    return state


def _update(silence: int | None):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        quiet = state.hasTimedOut
        runs = {r: tuple(x) for r, x in json.loads(state.get[0]).items()} if state.exists else {}
        told = dict.fromkeys(runs) if quiet else {}
        if not quiet:
            lines = pd.concat(list(parts)).sort_values("line_no", kind="stable")
            for r, *said in zip(lines["run"].tolist(), *(lines[c].tolist() for c in _SAID)):
                runs[r] = _fold(runs.get(r, _FIRST), *said)
                told[r] = None
        state.update((json.dumps(runs),))  # without a timer once it has run out
        if silence and not quiet:
            state.setTimeoutDuration(silence)
        names = [f.split()[0] for f in _RESULT.split(", ")]
        rows = [(int(r) if r else None, *runs[r], quiet) for r in told]
        yield pd.DataFrame(dict(zip(names, (pd.array(x, "Int64") if f.endswith("long") else pd.Series(x, dtype=object) for x, f in zip(zip(*rows), _RESULT.split(", "))))))
    return run


def running(lines: DataFrame, silence: int | None = None) -> DataFrame:
    """A stream of run_id, line_no and line to a row for each run that a micro-batch says something of. With silence (milliseconds), a run
    that nothing was said of for so long gets a row more; such a stream never ends by itself.

    Calling Python for a key costs as much as some thousand lines, so the states of many runs are kept under one of BUCKETS keys. A timer
    belongs to one key, so with silence each run has its own."""
    timer = GroupStateTimeout.ProcessingTimeTimeout if silence else GroupStateTimeout.NoTimeout
    run = F.coalesce(F.col("run_id").cast("long").cast("string"), F.lit(""))
    own = run if silence else F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("string")
    said = marks(lines).select(own.alias("own"), run.alias("run"), "line_no", *_SAID)
    return said.groupBy("own").applyInPandasWithState(_update(silence), _RESULT, _STATE, "update", timer)


def follow(spark: SparkSession, source: str, out: str, files: int = 4) -> DataFrame:
    """Follow Parquet files of lines below source until all are read, writing each batch's changes below out; calling it again goes on
    where it stopped. Returns the latest row of each run."""
    schema = spark.read.parquet(source).schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/batch={number}")

    stream = running(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source))
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return latest(spark, out)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The latest row of each run of those that follow() wrote."""
    rows = spark.read.schema(f"{_RESULT}, batch long").parquet(f"{out}/changes")
    names = [f.split()[0] for f in _RESULT.split(", ")[1:]]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*names), "batch").alias("last")).select("run_id", "last.*")


def summary(spark: SparkSession, lines: DataFrame, parts: int = 3) -> DataFrame:
    """The progress of all runs of a table of lines, replayed as a stream: the files of earlier lines come first, and a run's lines of one part
    lie in one file, so a run's lines arrive in their order and in several batches. A batch takes as many files as a part may have: there are
    some `parts` batches, however many lines and files."""
    source = shared_path(spark, "lines")
    ends = lines.agg(F.min("line_no"), F.max("line_no")).first()
    low, step = ends[0] or 0, ((ends[1] or 0) - (ends[0] or 0)) // parts + 1
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(parts):
        own = F.floor((F.col("line_no") - low) / step) == i
        lines.where(own).select("run_id", "line_no", "line").repartition(files, "run_id").write.mode("append").parquet(source)
    return follow(spark, source, shared_path(spark, "progress"), files)
