"""Coding as micro-batches, and numbering that remembers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coding import code
from ..plans.language import Rule
from ..sources.conllu import SEPARATOR, graphs


def stream_blocks(spark: SparkSession, path: str, files_per_batch: int = 8, large: bool = False) -> DataFrame:
    """A stream of sentences (block) from a folder that gets CoNLL-U files.

    Blank lines (also with spaces) part sentences, as in batch. Files are split among tasks at empty lines, each piece
    at its other blank lines; only a file without any empty line is read whole. large: sentences are parted by
    exactly one empty line.
    """
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("lineSep", "\n\n").text(path)
    if not large:
        #: What is left of blank lines at the ends of a piece.
        piece = F.regexp_replace("value", r"^\s+|(?:\n[ \t\r]*)+\z", "")
        raw = raw.select(F.explode(F.split(piece, SEPARATOR)).alias("value"))
    return raw.filter(F.length(F.trim("value")) > 0).withColumnRenamed("value", "block")


def code_stream(blocks: DataFrame, rules: list[Rule], sink: Callable[[DataFrame, int], None], checkpoint: str, first: bool = True, once: bool = True, code_node: bool = False):
    """Codes each micro-batch and gives it to sink(graphs, batch number); no pattern crosses a sentence, so batches need no state."""

    def each(df: DataFrame, n: int) -> None:
        sink(code(graphs(df), rules, first, code_node=code_node), n)

    w = blocks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def number_stream(utterances: DataFrame, key: str = "file") -> DataFrame:
    """A stream of utterances (file, pid, session, block, utterance) with running numbers that go on from batch to batch.

    As in batch: within a file numbers run on while the PID stays, also where a session has none, and
    start anew when it changes. The state of a file is its last PID and number; its utterances come in
    order of session and block, batch after batch.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else ("", 0)
        got = pd.concat(list(batches)).sort_values(["session", "block"], kind="stable")
        pids, numbers = [], []
        for pid in got["pid"]:
            own = last if pid is None or pid != pid else pid
            n = n + 1 if own == last else 1
            last = own
            pids.append(own)
            numbers.append(n)
        got["pid"], got["utt_nr"] = pids, numbers
        got["utt_id"] = [f"{p}_u{i}" for p, i in zip(pids, numbers, strict=True)]
        state.update((last, n))
        yield got[[key, "pid", "session", "block", "utterance", "utt_nr", "utt_id"]]

    schema = f"{key} string, pid string, session long, block long, utterance string, utt_nr long, utt_id string"
    return utterances.groupBy(key).applyInPandasWithState(run, schema, "pid string, n long", "append", "NoTimeout")
