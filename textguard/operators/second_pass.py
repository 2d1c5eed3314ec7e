"""Second pass: a model's verdict on the texts the rules left alone.

Texts are scored once per distinct text. What is counted, compared and joined is their hash; a
text itself only moves where its hash occurs more than once. The scorer is the library's only
Python code that runs in tasks; everything around it is column work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import inbound, model
from textguard.operators.bounded import Overlapped, Scorer, ScorerUnavailable
from textguard.session import conf_for, ship_package, written

__all__ = ["Scorer", "ScorerUnavailable"]

VERDICT_SCHEMA = "text_hash string, verdict string, status string"
#: Bits of the sieve of repeated hashes, 64 to a row; it is broadcast and has no more rows.
SIEVE = 1 << 26
#: Rows of a batch that are Python objects at once, and rows handed back at once.
ROWS = 256
#: Bytes after which Spark ends a batch of texts. A task holds two batches, and a scorer's process for
#: as long as it lives the one that it was forked beside.
BYTES = 1 << 20


def text_hash(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def _hash(text: Column, enabled: Column | None, model_name: str | None) -> Column:
    """The hash of a text that a model is asked about, else NULL."""
    wanted = inbound.open_for_model(text)
    wanted = wanted if enabled is None else wanted & enabled
    whole = text
    if model_name:
        whole = F.concat(F.coalesce(F.col(model_name), F.lit("")), F.lit("\0"), text)
    return F.when(wanted, text_hash(whole))


def hashed(
    frame: DataFrame,
    sanitized: str,
    enabled: Column | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """Add ``text_hash`` where it is not there yet; NULL for a text no model is asked about.

    ``model_name`` names a column: the hash then stands for a text and the model asked about it.
    """
    if "text_hash" in frame.columns:
        return frame
    return frame.withColumn("text_hash", _hash(F.col(sanitized), enabled, model_name))


def asked(
    frame: DataFrame,
    sanitized: str,
    enabled: Column | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """The frame with ``text_hash``, written, so that what made the texts runs once for each row."""
    return written(hashed(frame, sanitized, enabled, model_name), "asked")


def parted(frame: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` is surely none of ``keys``, and those whose key may be one.

    Each of the keys sets a bit in a sieve of fixed size, which is broadcast. A row whose bit is not
    set has none of them, nor has one whose key is NULL; a bit may also be set by chance. The frame
    is read for each of the two, so pass a table.
    """
    at = F.pmod(F.xxhash64(key), F.lit(SIEVE // 64))
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({key}), 40), 64) as int))")
    sieve = keys.select(at.alias("__at"), bit.alias("__bit")).groupBy("__at").agg(F.bit_or("__bit").alias("__bits"))
    marked = frame.withColumns({"__at": at, "__bit": bit}).join(F.broadcast(sieve), "__at", "left")
    maybe = F.col(key).isNotNull() & F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return tuple(marked.filter(m).drop("__at", "__bit", "__bits") for m in (~maybe, maybe))


def candidates(
    frame: DataFrame,
    sanitized: str,
    enabled: Column | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """The distinct texts to score: ``text_hash``, ``prompt``, ``copies``.

    With ``model_name``, a column, they are distinct by text and model, which comes along. The
    frame is read three times: pass a table, best the result of ``asked``.

    Hashes alone are counted first. Those that repeat set a bit each in a sieve of fixed size. A
    row whose bit is not set holds the only copy of its text, which is scored where it lies; only
    the others are brought together, counted before the shuffle, so a text that fills a third of
    the table arrives as one row per input partition. A bit that is set by chance costs one move.
    """
    rows = hashed(frame, sanitized, enabled, model_name).filter("text_hash IS NOT NULL")
    repeats = rows.groupBy("text_hash").count().filter("count > 1")
    alone, repeated = parted(rows, "text_hash", repeats)
    named = [model_name] if model_name else []
    keys = [*named, "text_hash", sanitized]
    alone = alone.select(*keys, F.lit(1).cast("long").alias("copies"))
    together = repeated.groupBy(*keys).agg(F.count("*").alias("copies"))
    return alone.unionByName(together).select(
        *named, "text_hash", model.prompt(sanitized).alias("prompt"), "copies"
    )


def score(
    prompts: DataFrame,
    make_scorer: Callable[[str], Scorer],
    model_name: str,
    batch_rows: int = 64,
    tasks: int | None = None,
    seconds: float = 5.0,
) -> DataFrame:
    """Run one model over ``prompts`` and write the verdict table; see ``score_by_model``."""
    named = prompts.withColumn("model_name", F.lit(model_name))
    return score_by_model(named, make_scorer, batch_rows, tasks, seconds).drop("model_name")


def score_by_model(
    prompts: DataFrame,
    make_scorer: Callable[[str], Scorer],
    batch_rows: int = 64,
    tasks: int | None = None,
    seconds: float = 5.0,
) -> DataFrame:
    """Run over each prompt the model that its ``model_name`` names; write the verdict table.

    ``make_scorer(model_name)`` is called once per task and model, in a process of its own, and
    gives a function from a series of prompts to a series of answers (None for no answer). A
    call gets ``seconds`` for each of its texts; one that takes longer is ended, whatever it
    waits for. One that takes an eighth of that no longer holds up the next, which is made in
    another process of the same maker, up to ``bounded.OPEN`` of them. Where a call is ended or
    raises ``ScorerUnavailable``, its texts are asked about one by one, and only those that fail
    alone have no verdict, so ``batch_rows`` does not change the result; any other error fails the
    job. ``tasks`` spreads few prompts over more tasks than their size asks for, which pays where
    a model is slow.

    Spark hands over ``BYTES`` of texts at a time, or one text that is longer, and only ``ROWS``
    of them at once become Python's, besides the ``batch_rows`` at most that wait for a call to
    each model. So what a task's Python holds does not grow with the rows of its partition.
    """
    ship_package(prompts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, Overlapped] = {}
        lots: dict[str, list] = {}
        rows: list[tuple] = []
        kinds = pa.schema([(c, pa.string()) for c in ("model_name", "text_hash", "verdict", "status")])

        def add(name: str, answers: Iterator[tuple]) -> None:
            rows.extend((name, h, a, "unavailable" if a is None else "ok") for h, a in answers)

        def made() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(kinds)
            found = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=kinds)
            rows.clear()
            return found

        try:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    for name, text_hash, prompt in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                        lot = lots.setdefault(name, [])
                        lot.append((text_hash, prompt))
                        if len(lot) == batch_rows:
                            model = models.setdefault(name, Overlapped(make_scorer, name, seconds))
                            add(name, model.ask(lots.pop(name)))
                    if len(rows) >= ROWS:
                        yield made()
            for name, lot in lots.items():
                model = models.setdefault(name, Overlapped(make_scorer, name, seconds))
                add(name, model.ask(lot))
            for name, model in models.items():
                add(name, model.rest())
            yield made()
        finally:
            for model in models.values():
                model.close()

    prompts = prompts.select("model_name", "text_hash", "prompt")
    if tasks:
        prompts = prompts.repartition(tasks, "text_hash")
    scored = prompts.mapInArrow(run, f"model_name string, {VERDICT_SCHEMA}")
    with conf_for(prompts.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=BYTES):
        return written(scored, "verdicts")  # a later join would otherwise score again


def condemned(verdicts: DataFrame) -> DataFrame:
    """Hashes of the malicious texts, each once. No other verdict changes a text."""
    return (
        verdicts.filter(model.is_malicious("verdict"))
        .groupBy("text_hash").agg(F.lit(True).alias("malicious"))
    )


def apply_verdicts(
    frame: DataFrame,
    verdicts: DataFrame,
    sanitized: str,
    enabled: Column | None = None,
) -> DataFrame:
    """Replace condemned texts; a text without a verdict is left alone.

    ``malicious`` says whether the text was replaced. Only rows that may hold a condemned text meet
    the condemned hashes; the others, and those no model was asked about, stay where they lie.
    The frame is read twice: pass a table, best the result of ``asked``.
    """
    bad = written(condemned(verdicts), "condemned")
    clear, maybe = parted(hashed(frame, sanitized), "text_hash", bad)
    clear = clear.withColumn("malicious", F.lit(False))
    joined = clear.unionByName(maybe.join(bad, "text_hash", "left"))
    replaced = F.coalesce("malicious", F.lit(False)) & inbound.open_for_model(sanitized)
    if enabled is not None:
        replaced = replaced & enabled
    judged = joined.withColumn("malicious", replaced).withColumn(
        sanitized, model.apply_verdict(sanitized, "malicious")
    )
    return judged.select(*(c for c in frame.columns if c != "text_hash"), "malicious")
