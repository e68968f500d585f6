"""Frames and votes that keep arriving."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline.operators.survey import explode_answers

Annotator = Callable[[list[Any], list[Any]], list[str]]

#: Where a stream's state lies that is kept value by value.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which states with several values for a key need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Pairing(StatefulProcessor):
    """Holds the frames of an episode that a neighbour still needs: by position, the item and whether its action is out."""

    def __init__(self, annotator: Annotator, key: Sequence[str], idx: str, item: str, kind: str, batch: int, patience_ms: int | None):
        self.annotator, self.key, self.idx, self.item, self.kind = annotator, list(key), idx, item, kind
        self.batch, self.patience_ms = batch, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "idx long", f"item {self.kind}, told boolean")

    def _tell(self, key: tuple, told: list[tuple[int, Any, Any]]) -> pd.DataFrame:
        """Rows of (position, item, item before or None), annotated a batch at a time."""
        actions: list[str | None] = [None] * len(told)
        pairs = [i for i, t in enumerate(told) if t[2] is not None]
        for at in range(0, len(pairs), self.batch):
            some = pairs[at : at + self.batch]
            for i, a in zip(some, self.annotator([told[i][2][0] for i in some], [told[i][1] for i in some])):
                actions[i] = a
        out = pd.DataFrame({c: [v] * len(told) for c, v in zip(self.key, key)})
        out[self.idx], out[self.item] = [t[0] for t in told], [t[1] for t in told]
        out["action"] = pd.Series(actions, dtype=object)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:  # one chunk at a time, in whatever order they come
            fresh = {int(i): v for i, v in zip(pdf[self.idx].tolist(), pdf[self.item].tolist())}
            near: dict[int, tuple | None] = {}

            def at(i: int) -> tuple | None:
                """(item, told) of a position that has arrived and is still held."""
                if i not in near:
                    near[i] = (fresh[i], False) if i in fresh else self.held.getValue((i,)) if self.held.containsKey((i,)) else None
                return near[i]

            told = []
            for i in sorted({j for i in fresh for j in (i, i + 1)}):
                now = at(i)
                if now is not None and not now[1] and (i == 0 or at(i - 1) is not None):
                    told.append((i, now[0], (at(i - 1)[0],) if i else None))
                    near[i] = (now[0], True)
            for i in sorted({j for i in fresh for j in (i - 1, i, i + 1)}):
                now = at(i)
                if now is None:
                    continue
                # a frame goes when its action and that of its successor are out
                after = at(i + 1)
                if now[1] and after is not None and after[1]:
                    if i not in fresh:
                        self.held.removeKey((i,))
                else:
                    self.held.updateValue((i,), now)
            if told:
                yield self._tell(key, told)
        if self.patience_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Patience is over: frames that still wait are paired with the nearest one before them."""
        last, told, items = None, [], sorted((k[0], v[0], v[1]) for k, v in self.held.iterator())
        for i, item, done in items:
            if not done:
                told.append((i, item, None if last is None else (last,)))
            last = item
        for i, item, _ in items[:-1]:
            self.held.removeKey((i,))
        for i, item, _ in items[-1:]:
            self.held.updateValue((i,), (item, True))
        if told:
            yield self._tell(key, told)

    def close(self) -> None:
        pass


def stream_actions(frames: DataFrame, annotator: Annotator, key: Sequence[str] = ("source", "split", "episode_id"),
                   idx: str = "frame_idx", item: str = "item", batch: int = 500, patience_ms: int | None = None) -> DataFrame:
    """The action between each frame and the one before it, as frames arrive in any order.

    Positions count from 0; frame 0 has no action. A frame waits for its predecessor, which may come in any
    later batch. State per episode: the frames that a neighbour still needs, each under its own position, so a
    batch of a long episode passes in chunks. With `patience_ms`, frames still waiting that long after the
    last arrival are paired with the nearest frame before them. Start it inside `keyed_state`.
    """
    types = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    keys = ", ".join(f"`{k}` {types[k]}" for k in key)
    schema = f"{keys}, `{idx}` long, `{item}` {types[item]}, action string"
    pairing = _Pairing(annotator, key, idx, item, types[item], batch, patience_ms)
    mode = "None" if patience_ms is None else "ProcessingTime"
    return frames.select(*key, idx, item).groupBy(*key).transformWithStateInPandas(pairing, schema, "append", mode)


def stream_votes(submissions: DataFrame, paths: int = 1, questions: int = 1, systems: int | None = None) -> DataFrame:
    """Running votes per question and system over a growing log of submissions.

    The page's rules: a submission counts if it answers at least `paths` paths, at least
    `questions` questions for each, and no question with nothing or with all `systems`. Each
    is judged on its own, so the state is one counter per question and system.
    """
    def answered(s: Column) -> Column:
        return (F.size(s) > 0) & (F.size(F.array_distinct(s)) < systems if systems is not None else F.lit(True))

    complete = (F.size("answers") >= paths) & F.forall(
        F.map_values("answers"), lambda q: (F.size(q) >= questions) & F.forall(F.map_values(q), answered))
    votes = explode_answers(submissions.where(complete))
    return votes.groupBy("question", "system").agg(F.count(F.lit(1)).alias("votes"))


class _Answers(StatefulProcessor):
    """All answers of a rater so far, and whether they are counted: one value, for each access to the state costs more than the work."""

    def __init__(self, systems: int, paths: int, questions: int):
        self.systems, self.paths, self.questions = systems, paths, questions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.standing = handle.getValueState("standing", "counted boolean, out boolean, cells array<struct<path:string,question:string,systems:array<string>>>")

    def _changes(self, cells: dict, sign: int) -> list[tuple]:
        """An answer for each cell, and a vote for each of its systems."""
        rows = [(question, None, 0, sign) for _, question in cells]
        return rows + [(question, system, sign, 0) for (_, question), ticks in cells.items() for system in ticks]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        counted, out, cells = self.standing.get() or (False, False, [])
        if out:  # too many paths or all systems ticked: answers are only added, so that stays
            return
        before = {(path, question): sorted(systems) for path, question, systems in cells}
        now = {k: set(v) for k, v in before.items()}
        for r in rows:
            now.setdefault((r.path, r.question), set()).update([] if r.system is None else [r.system])
        n = len({path for path, _ in now})
        out = n > self.paths or len(now) > self.paths * self.questions or any(len(t) >= self.systems for t in now.values())
        valid = not out and n == self.paths and len(now) == self.paths * self.questions and all(now.values())
        changes = (self._changes(before, -1) if counted else []) + (self._changes({k: sorted(t) for k, t in now.items()}, 1) if valid else [])
        self.standing.update((valid, out, [] if out else [(*k, sorted(t)) for k, t in now.items()]))
        if changes and not (counted and valid and now == {k: set(v) for k, v in before.items()}):
            yield from (Row(rater=key[0], question=q, system=system, votes=v, answers=n) for q, system, v, n in changes)

    def close(self) -> None:
        pass


CHANGES = "rater string, question string, system string, votes long, answers long"


def rater_changes(submissions: DataFrame, systems: int, paths: int = 5, questions: int = 2) -> DataFrame:
    """What the submissions of each rater change in the count: votes and answers that are added or withdrawn.

    The rules of `survey.valid_raters` hold over all submissions of a rater: `questions` questions on each of
    exactly `paths` paths, every one with at least one and not all systems. A rater counts from the
    submission that completes the answers to the one that breaks a rule. Start it inside `keyed_state`.
    """
    rows = explode_answers(submissions).select(*[F.col(c).cast("string").alias(c) for c in ("rater", "path", "question", "system")])
    return rows.groupBy("rater").transformWithState(_Answers(systems, paths, questions), CHANGES, "append", "None")


def running_tally(changes: DataFrame) -> DataFrame:
    """Votes per question and system, and answers per question (under a null system), over a growing log of changes."""
    return changes.groupBy("question", "system").agg(F.sum("votes").alias("votes"), F.sum("answers").alias("answers"))


def follow_votes(submissions: DataFrame, where: str, systems: int, paths: int = 5, questions: int = 2) -> None:
    """Bring the tally below `where` up to date with the log: one stream writes what raters change, the next one counts it.

    Both remember how far they came, so each call takes what has arrived since the last one.
    """
    spark = submissions.sparkSession
    with keyed_state(spark):
        first = (rater_changes(submissions, systems, paths, questions).writeStream.format("parquet").option("checkpointLocation", f"{where}/raters")
                 .trigger(availableNow=True).start(f"{where}/changes"))
        first.awaitTermination()

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{where}/tally/{batch % 2}")
        df.sparkSession.range(1).select(F.lit(batch % 2).alias("now")).write.mode("overwrite").parquet(f"{where}/current")

    changes = spark.readStream.schema(CHANGES).parquet(f"{where}/changes")
    second = (running_tally(changes).writeStream.outputMode("complete").option("checkpointLocation", f"{where}/counts").foreachBatch(keep)
              .trigger(availableNow=True).start())
    second.awaitTermination()


def current_tally(spark: SparkSession, where: str) -> DataFrame:
    """(question, system, votes, share) as of the last batch that was counted."""
    now = spark.read.parquet(f"{where}/current").first()["now"]
    rows = spark.read.parquet(f"{where}/tally/{now}")
    answers = rows.where(F.col("system").isNull()).select("question", F.col("answers").alias("_n"))
    return rows.where(F.col("system").isNotNull() & (F.col("votes") > 0)).join(answers, "question").select("question", "system", "votes", (F.col("votes") / F.col("_n")).alias("share"))
