"""A job's posting as it loads: which of the readings of an open posting is taken."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from loomrank.functions.text import normalize
from loomrank.operators.eligibility import looks_like_posting

# Skills that a posting which has loaded names, how long it is waited for, and how much of a text tells it from another.
ENOUGH, WAIT_MS, FINGERPRINT_CHARS = 4, 2200, 2200
READINGS = "job_key string, opened long, at long, ts timestamp, text string, n_skills int, same boolean"
STATE = "print string, opened long, done boolean, at long, ts_us long, text string, n_skills int, same boolean"
NEVER = -1


class _Posting:
    """What is known of one job: the beginning of the posting last taken, and the open one's last reading."""

    def __init__(self, state=None):
        self.print, self.opened, self.done, self.last = (None, NEVER, True, None) if state is None else (state[0], state[1], state[2], None if state[3] is None else tuple(state[3:]))

    def state(self) -> tuple:
        return (self.print, self.opened, self.done, *(self.last or (None,) * 5))

    def _take(self, reading) -> list[tuple]:
        at, ts, text, n, same = reading
        self.done, self.last = True, None
        if n < 1 or not same:
            return []
        self.print = text[:FINGERPRINT_CHARS]
        return [(self.opened, at, ts, text, n, same)]

    def settle(self) -> list[tuple]:
        """The wait is over: the last reading counts as it is."""
        out = self._take(self.last) if not self.done and self.last else []
        self.done, self.last = True, None
        return out

    def see(self, opened: int, reading) -> list[tuple]:
        out = []
        if opened > self.opened:
            out, self.opened, self.done, self.last = self.settle(), opened, False, None
        if opened < self.opened or self.done:
            return out
        at, _, text, n, same = reading
        if text[:FINGERPRINT_CHARS] == self.print:
            self.done, self.last = True, None  # nothing new is shown
        elif at >= opened + WAIT_MS or (n >= ENOUGH and same):
            out += self._take(reading)
        else:
            self.last = reading
        return out


def _prepared(readings: DataFrame) -> DataFrame:
    """opened and at in milliseconds; texts that are no posting's aren't readings."""
    kind = [F.col("job_key").cast("string").alias("job_key"), F.unix_millis("opened").alias("opened"), F.unix_millis("ts").alias("at"), "ts", normalize("text").alias("text")]
    out = readings.select(*kind, F.coalesce(F.col("n_skills").cast("int"), F.lit(0)).alias("n_skills"), F.coalesce("same", F.lit(False)).alias("same"))
    return out.filter(looks_like_posting("text") & F.col("opened").isNotNull() & F.col("at").isNotNull() & (F.col("at") >= F.col("opened")))


def _rows(key, taken: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(key, o, a, pd.Timestamp(t, unit="us"), x, n, s) for o, a, t, x, n, s in taken], columns=["job_key", "opened", "at", "ts", "text", "n_skills", "same"])
    return out.astype({"opened": "int64", "at": "int64", "n_skills": "int32", "same": "bool", "ts": "datetime64[us]"})


def _read(b: pd.DataFrame) -> Iterator[tuple]:
    for r in b.itertuples(index=False):
        yield r.job_key, r.opened, (r.at, pd.Timestamp(r.ts).value // 1000, r.text, int(r.n_skills), bool(r.same))


def refreshed(readings: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Of the readings (job_key, opened, ts, text, n_skills, same) of each opening of a job's posting the one that is taken.

    The first that names ENOUGH skills and is the job's posting (eligibility.same_posting) is taken; after WAIT_MS the next one,
    or else the last one, counts if it names any skill. An opening that shows what was taken last gives none, and a later
    opening ends an earlier one. A stream ends a wait by a timer on event time; a table at the job's last row. Readings with
    null times are left out; later than the watermark they count no more."""
    rows = _prepared(readings)
    if not rows.isStreaming:

        def walk(batches):  # sorted by job and time: what is held is one job's last reading
            had, job = None, _Posting()
            for b in batches:
                out = []
                for key, opened, reading in _read(b):
                    if had is None or key != had[0]:
                        out += [_rows(had[0], job.settle())] if had else []
                        had, job = (key,), _Posting()
                    out.append(_rows(key, job.see(opened, reading)))
                yield pd.concat(out) if out else _rows(None, [])
            if had:
                yield _rows(had[0], job.settle())

        return rows.repartition("job_key").sortWithinPartitions("job_key", "at", "opened", "text").mapInPandas(walk, READINGS)

    def run(key, batches, state):
        job = _Posting(state.get if state.exists else None)
        taken = []
        if state.hasTimedOut:
            taken = job.settle()
        else:
            for b in [pd.concat(list(batches)).sort_values(["at", "opened", "text"], kind="stable")]:
                for _, opened, reading in _read(b):
                    taken += job.see(opened, reading)
        state.update(job.state())
        if not job.done:
            state.setTimeoutTimestamp(max(job.opened + WAIT_MS, state.getCurrentWatermarkMs() + 1))
        yield _rows(key[0], taken)

    return rows.withWatermark("ts", late).groupBy("job_key").applyInPandasWithState(run, READINGS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
