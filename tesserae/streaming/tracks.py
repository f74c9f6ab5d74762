"""Stateful processing of frames that arrive as a stream, by video: delayed output, saturating counters, running aggregates."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "video long, frame long, counter int, confirmed boolean"
_STATE = "counter int, run int, confirmed boolean, frames array<long>, hits array<boolean>"


def step(counter: int, run: int, confirmed: bool, hit: bool, low: int, high: int, needed: int) -> tuple[int, int, bool]:
    """Counter within its limits, matches in a row, and whether there ever were enough of them."""
    run = run + 1 if hit else 0
    return max(low, min(high, counter + (1 if hit else -1))), run, confirmed or run >= needed


def track_status(frames: DataFrame, delay: int = 3, low: int = -4, high: int = 8, needed: int = 3) -> DataFrame:
    """frames: a stream of (video, frame, hit). Emits each frame's counter and status, ``delay`` frames later, in frame order.

    Frames that come out of order within the delay are put in order; the state of a video is the frames that wait, never more than the delay and a batch.
    ``frame`` of -1 marks the end of a video and gives out all that waits.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counter, in_row, confirmed, waiting, hits = state.get if state.exists else (0, 0, False, [], [])
        held = dict(zip(waiting, hits))
        end = False
        for b in batches:
            for f, h in zip(b["frame"].tolist(), b["hit"].tolist()):
                if f < 0:
                    end = True
                else:
                    held[f] = bool(h)
        ready = sorted(held)
        ready = ready if end else ready[: max(0, len(ready) - delay)]
        out = []
        for f in ready:
            counter, in_row, confirmed = step(counter, in_row, confirmed, held.pop(f), low, high, needed)
            out.append((key[0], f, counter, confirmed))
        left = sorted(held)
        if end:  # the video is over
            state.remove()
        else:
            state.update((counter, in_row, confirmed, left, [held[f] for f in left]))
        yield pd.DataFrame(out, columns=["video", "frame", "counter", "confirmed"])

    return frames.groupBy("video").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


_REMOVED = "video long, track long, first long, removed_at long, cause string"


def early_removal_stream(log: DataFrame, delay: int, misses: int, doubles: int, wait: int = 1) -> DataFrame:
    """log: a stream of (video, frame, track, det), det null for a track without a match. Emits each track when it goes: the same rows as ``operators.video.early_removals``.

    A frame is judged once a frame ``wait`` later has come, so its rows may come in any order until then; ``frame`` of -1 ends a video. The state of a video
    is the rows that wait, the first frame of its tracks, and counts of the tracks that can still go.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"held": [], "first": [], "miss": [], "pair": [], "gone": []}
        held = {tuple(x) for x in s["held"]}
        first, miss, gone = dict(s["first"]), dict(s["miss"]), set(s["gone"])
        pair = {(a, b): n for a, b, n in s["pair"]}
        end = False
        for b in batches:
            for f, t, d in zip(b["frame"].tolist(), b["track"].tolist(), b["det"].tolist()):
                if f < 0:
                    end = True
                else:
                    held.add((f, t, None if pd.isna(d) else int(d)))
        last = max((f for f, _, _ in held), default=0)
        out = []
        for frame in sorted({f for f, _, _ in held if end or f <= last - wait}):
            rows = [(t, d) for f, t, d in held if f == frame]
            for t, _ in rows:
                first.setdefault(t, frame)
            events = []
            matched = {t for t, d in rows if d is not None}
            for t in sorted({t for t, d in rows if d is None} - matched):
                miss[t] = miss.get(t, 0) + 1
                if miss[t] == misses:
                    events.append((t, "unmatched"))
            for d in sorted({d for _, d in rows if d is not None}):
                tracks = {t for t, e in rows if e == d}
                lead = min(tracks, key=lambda t: (first[t], t))
                for t in sorted(tracks - {lead}):
                    pair[lead, t] = pair.get((lead, t), 0) + 1
                    if pair[lead, t] == doubles:
                        events.append((t, "duplicate"))
            for t, cause in events:
                if t not in gone and frame < first[t] + delay:
                    gone.add(t)
                    out.append((key[0], t, first[t], frame, cause))
            held = {x for x in held if x[0] != frame}
            open_ = {t for t in miss if frame < first[t] + delay}
            miss = {t: n for t, n in miss.items() if t in open_}
            pair = {(a, t): n for (a, t), n in pair.items() if frame < first[t] + delay}
        if end:  # the video is over
            state.remove()
            yield pd.DataFrame(out, columns=["video", "track", "first", "removed_at", "cause"])
            return
        # A track that can still go, or is needed to order others by their first frames, is kept; one that is gone for good needs no count.
        gone = {t for t in gone if last - wait < first[t] + delay}
        kept = {"held": sorted(held, key=str), "first": sorted(first.items()), "miss": sorted(miss.items()), "pair": sorted((a, b, n) for (a, b), n in pair.items()), "gone": sorted(gone)}
        state.update((json.dumps(kept),))
        yield pd.DataFrame(out, columns=["video", "track", "first", "removed_at", "cause"])

    return log.groupBy("video").applyInPandasWithState(run, _REMOVED, "kept string", "append", GroupStateTimeout.NoTimeout)


def running_scores(events: DataFrame) -> DataFrame:
    """A streaming aggregate by kind, for complete output: what an online evaluator keeps."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by event-time window with a watermark. Times without a zone are taken as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
