"""Admission to a gallery of bounded size: an ordered fold of candidates per person into an action log."""

from collections.abc import Iterator
from heapq import heapify, heappop

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOG = "person int, seq int, file_name string, action string, reason string, target_file string"


def _value(x: float | None) -> float | None:
    """NaN is no value."""
    return x if x is not None and x == x else None


class _Gallery:
    """The files of one person with lazily cleaned heaps of what may be replaced."""

    def __init__(self, files: list[dict]):
        self.files = {f["file_name"]: (_value(f["score"]), _value(f["blur"]), f["seq"], f["locked"]) for f in files}
        self.scored = [(-s, q, n) for n, (s, _, q, _) in self.files.items() if s is not None]
        self.sharp = [(b, q, n) for n, (_, b, q, _) in self.files.items() if b is not None]
        self.n_scored, self.most, self.failed = len(self.scored), list(self.scored), set()
        for h in (self.scored, self.sharp, self.most):
            heapify(h)

    def bar(self) -> float | None:
        """The largest score of a mapped file."""
        while self.most and self.most[0][2] not in self.files:
            heappop(self.most)
        return -self.most[0][0] if self.most else None

    def target(self, by_score: bool) -> tuple[str, float] | None:
        """The most redundant (or the least sharp) file that was not refused before, with its value."""
        h = self.scored if by_score else self.sharp
        while h and (h[0][2] not in self.files or h[0][2] in self.failed):
            heappop(h)
        return (h[0][2], -h[0][0] if by_score else h[0][0]) if h else None

    def remove(self, name: str) -> None:
        self.n_scored -= self.files.pop(name)[0] is not None


def _decide(candidates: list[dict], g: _Gallery, capacity: int, ceiling: float | None, replacement: bool, scoring: bool) -> list[tuple]:
    count, known, scores, floor, out = len(g.files), bool(g.files), g.n_scored > 0, None, []
    for c in candidates:
        blur, full = _value(c["blur"]), count >= capacity
        score = _value(c["score"]) if scoring and known and c["matches"] and (not full or scores) else None
        by_score = scores and scoring
        mine = score if by_score else blur
        action, reason, target = "skip", None, None
        if floor is not None and blur is not None and blur < floor:
            reason = "below the freed slot"
        elif not full:
            bar = None if ceiling == 0 else g.bar() if ceiling is None else ceiling
            if score is not None and bar is not None and score > bar:
                reason = "not novel"
            else:
                action, reason = "add", "below capacity"
        elif not replacement:
            reason = "replacement off"
        elif mine is None:
            reason = "no score"
        else:
            found = g.target(by_score)
            if found is None:
                reason = "no target"
            elif mine >= found[1] if by_score else mine <= found[1]:
                reason = "not better"
            elif g.files[found[0]][3]:
                reason, target = "delete failed", found[0]
                g.failed.add(target)
            else:
                action, reason, target = "replace", "less redundant" if by_score else "sharper", found[0]
                g.remove(target)
                count, scores, floor = count - 1, g.n_scored > 0, None if by_score else found[1]
        if action != "skip":
            if c["accepted"]:
                count, floor, scores = count + 1, None, scores or score is not None
            else:
                action = "lost" if full else "failed"
                count, floor = count + full, None if full else floor
        out.append((c["file_name"], action, reason, target))
    return out


def admit(candidates: DataFrame, gallery: DataFrame, capacity: int, ceiling: float | None = None, replacement: bool = True, scoring: bool = True) -> DataFrame:
    """person, seq, file_name, action, reason, target_file for every candidate, in order of its file name as text.

    candidates: person, file_name, score (match score, NULL if none), blur and, if they have them, ``match`` (the name
    the score is for; another one's score counts as none) and ``accepted`` (false where the upload fails). gallery:
    person, file_name, score, blur, seq (what is mapped before the run) and, if it has it, ``locked`` (true where a
    delete fails). Persons are compared as text without case.

    Below capacity a candidate is added unless its score exceeds the ceiling: 0 switches the gate off, None takes the
    largest score in the gallery, and without one everything is added. At capacity, with ``replacement``, it replaces
    the file with the largest score if its own is smaller, as long as the person has match scores; an upload with a
    score gives it some. Without them it replaces the file with the least blur value if its own is larger, and until
    the freed slot is filled nothing blurrier may fill it. A refused delete is not tried again; a failed upload after a
    delete (``lost``) closes the slot. Nothing has a score while the gallery was empty at the start. Files added in this
    run are no targets in it. Ties of a target go to the smallest ``seq``, then name. NaN counts as NULL.

    The fold is sequential by nature and runs per person; a run offers a person no more than its selection limit.
    """
    have = lambda df, c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    own = F.lower(have(candidates, "match", F.col("person").cast("string"))) == F.lower(F.col("person").cast("string"))
    none = lambda t: F.lit(None).cast(t)
    c = candidates.select(F.col("person").cast("int").alias("person"), F.lit(1).alias("side"), "file_name", F.col("score").cast("double").alias("score"), F.col("blur").cast("double").alias("blur"), none("bigint").alias("seq"), own.alias("matches"), have(candidates, "accepted", F.lit(True)).alias("accepted"), F.lit(False).alias("locked"))
    g = gallery.select(F.col("person").cast("int").alias("person"), F.lit(0).alias("side"), "file_name", F.col("score").cast("double").alias("score"), F.col("blur").cast("double").alias("blur"), F.col("seq").cast("bigint").alias("seq"), F.lit(False).alias("matches"), F.lit(True).alias("accepted"), have(gallery, "locked", F.lit(False)).alias("locked"))
    rows = c.union(g).filter("person IS NOT NULL AND file_name IS NOT NULL").repartition("person").sortWithinPartitions("person", "side", "file_name")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        person, held, offered = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if offered:
                log = _decide(offered, _Gallery(held), capacity, ceiling, replacement, scoring)
                cols = [pa.array([person] * len(log), pa.int32()), pa.array(range(1, len(log) + 1), pa.int32()), *(pa.array(x, pa.string()) for x in zip(*log))]
                yield pa.RecordBatch.from_arrays(cols, ["person", "seq", "file_name", "action", "reason", "target_file"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["person"] != person:
                    yield from done()
                    person, held, offered = r["person"], [], []
                (offered if r["side"] else held).append(r)
        yield from done()

    return rows.mapInArrow(fold, _LOG)


def failure_kind(status: int, body: str) -> str:
    """Whether a refused upload is ``permanent`` (the image will never do) or ``transient``."""
    text = body.lower()
    permanent = (status == 400 and "face" in text) or status == 422 or (status == 500 and "could not process" in text)
    return "permanent" if permanent else "transient"
