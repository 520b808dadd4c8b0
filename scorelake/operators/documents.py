"""Lines of a page against lines read from it, where either side may have cut or joined lines that the other has not."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.algorithms import _long_distance, distances_from
from .joins import assignment

#: Below this a pair of lines is settled before lines are merged; above MATCHED it is no pair.
SETTLED, MATCHED = 0.25, 0.7
#: A piece may belong to a longer line if a stretch of that line, as long as the piece, is so near.
PIECE, WHOLE = 0.6, 0.4


def _keys(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def ends_within(pattern: str, text: str, most: int) -> list[tuple[int, int]]:
    """(distance, end) of all places of text where a stretch at most ``most`` edits from pattern ends, nearest first."""
    full, keys = (1 << len(pattern)) - 1, _keys(pattern)
    v, w, score, top, out = full, 0, len(pattern), len(pattern) - 1, []
    for end, c in enumerate(text, 1):
        e = keys.get(c, 0)
        x, h = e | w, (((e & v) + v) ^ v) | e
        plus, minus = w | (full & ~(h | v)), v & h
        score += (plus >> top & 1) - (minus >> top & 1)
        plus, minus = plus << 1 & full, minus << 1 & full  # nothing carried in: a stretch may begin anywhere
        v, w = minus | (full & ~(x | plus)), plus & x
        if score <= most:
            out.append((score, end))
    return sorted(out)


def distance(a: str, b: str) -> int:
    if a == b:
        return 0
    return _long_distance(a, b) if a and b else len(a) + len(b)


def relative(a: str, b: str) -> float:
    """Edit distance over the longer length; 0 for two empty texts."""
    return distance(a, b) / max(len(a), len(b), 1)


def costs(targets: Sequence[str], preds: Sequence[str]) -> np.ndarray:
    """relative() of all targets and preds; equal lines are read once, all targets against a pred at once."""
    rows, columns = ({x: k for k, x in enumerate(dict.fromkeys(side))} for side in (targets, preds))
    of = distances_from(list(rows))
    each = np.array([of(p) for p in columns], float).reshape(len(columns), len(rows)).T
    longer = np.maximum(np.array(list(map(len, rows)), int)[:, None], np.array(list(map(len, columns)), int)[None, :])
    each /= np.maximum(longer, 1)
    return each[np.ix_([rows[x] for x in targets], [columns[x] for x in preds])]


def stretch_within(piece: str, line: str, share: float, strictly: bool) -> bool:
    """Has line a stretch as long as piece, at most (strictly: less than) share of that length in edits away?

    A stretch that ends at a place is no nearer than the nearest one of any length that ends there, which one pass over
    the line gives for all places; only where that is near enough the stretch itself is looked at. Moving a stretch by one
    place changes its distance by two at most, so one that is far off speaks for those around it.
    """
    n = len(piece)
    if not n or n > len(line):
        return False
    most = int(n * share)
    while most >= 0 and not (most / n < share if strictly else most / n <= share):
        most -= 1
    if piece in line:
        return most >= 0
    if sum((Counter(piece) - Counter(line)).values()) > most:  # letters that the whole line lacks
        return False
    far: list[tuple[int, int]] = []
    for _, end in ends_within(piece, line, most):
        if end < n or any(abs(end - at) <= reach for at, reach in far):
            continue
        d = distance(piece, line[end - n : end])
        if d <= most:
            return True
        far.append((end, (d - most - 1) // 2))
    return False


def run_from(target: str, preds: Sequence[str], start: int, closed: set[int], fits) -> int:
    """End of the run of preds from start that joined by spaces read most like target: a line joins while it brings the run
    nearer, each line is a near stretch of target, and the run is not longer than target."""
    end, text = start + 1, preds[start]
    now = relative(target, text)
    while end < len(preds) and end not in closed:
        longer = f"{text} {preds[end]}"
        then = relative(target, longer)
        if then > now or not all(fits(k, False) for k in range(start, end)) or not fits(end, True):
            break
        end, text, now = end + 1, longer, then
        if len(text) > len(target):
            break
    return end


def consistent(runs: list[tuple[tuple[int, ...], float]]) -> list[tuple[int, ...]]:
    """Of runs (places, cost) that overlap, those of the set with the least mean cost among sets gathered in their order."""
    out: list[tuple[int, ...]] = []
    heap = sorted(runs, key=lambda r: r[0][0])
    at = 0
    while at < len(heap):
        end, covered = at + 1, set(heap[at][0])
        while end < len(heap) and covered & set(heap[end][0]):
            covered |= set(heap[end][0])
            end += 1
        sets: list[dict[tuple[int, ...], float]] = []
        for places, cost in heap[at:end]:
            stands = False
            for own in sets:
                if places in own:
                    own[places] = min(own[places], cost)
                    stands = True
                elif not any(set(places) & set(other) for other in own):
                    own[places] = cost
                    stands = True
            if not stands:
                sets.append({places: cost})
        out += min(sets, key=lambda own: sum(own.values()) / len(own))
        at = end
    return out


def matched(targets: Sequence[str], preds: Sequence[str], cost: np.ndarray) -> list[tuple[list[int], list[int], float]]:
    """(targets, preds, edit) by place. cost: relative distances of all lines.

    1. Lines without a settled partner: for each such target the run of such preds that reads most like it; runs that
       do not clash are merged, and targets are assigned to lines and runs at least total cost.
    2. A target left over joins a pred of which it is a near stretch; the targets of a pred are then read as one line.
    3. What is left on both sides is paired at least distance, with edit 1; preds beyond that number are not told.
    """
    if not targets or not preds:
        return [([i], [], 1.0) for i in range(len(targets))] + [([], [j], 1.0) for j in range(len(preds))]
    if len(targets) == len(preds) == 1:
        return [([0], [0], float(cost[0, 0]))]
    rows, columns = np.nonzero(cost < SETTLED)
    closed = set(columns.tolist())
    free = [j for j in range(len(preds)) if j not in closed]

    @lru_cache(None)
    def fits(i: int, k: int, strictly: bool) -> bool:
        return stretch_within(preds[k], targets[i], PIECE, strictly)

    runs = []
    for i in sorted(set(range(len(targets))) - set(rows.tolist())):
        best = None
        for j in free:
            end = run_from(targets[i], preds, j, closed, lambda k, strictly, i=i: fits(i, k, strictly))
            this = (float(cost[i, j]) if end == j + 1 else relative(targets[i], " ".join(preds[j:end])), tuple(range(j, end)))
            best = this if best is None or this[0] < best[0] else best
        if best:
            runs.append((best[1], best[0]))
    merged = consistent(runs)
    inside = {j for run in merged for j in run}
    lines = sorted([*merged, *((j,) for j in range(len(preds)) if j not in inside)])
    wide = [c for c, run in enumerate(lines) if len(run) > 1]
    now = cost[:, [run[0] for run in lines]]
    if wide:
        now[:, wide] = costs(targets, [" ".join(preds[j] for j in lines[c]) for c in wide])
    groups: dict[tuple[int, ...], list[int]] = {lines[c]: [r] for r, c in assignment(now) if now[r, c] <= MATCHED}
    held = {i for own in groups.values() for i in own}
    left = [i for i in range(len(targets)) if i not in held]
    for j, pred in enumerate(preds):
        if near := [i for i in left if stretch_within(targets[i], pred, WHOLE, True)]:
            own = groups.setdefault((j,), [])
            own += [i for i in near if i not in held]
            held.update(near)
    out = []
    for run, own in groups.items():
        if len(own) == 1:
            out.append((own, list(run), relative(targets[own[0]], " ".join(preds[j] for j in run))))
        elif own:
            out.append((sorted(own), list(run), relative("".join(targets[i] for i in sorted(own)), preds[run[0]])))
    alone = [i for i in range(len(targets)) if i not in held]
    spare = sorted(set(range(len(preds))) - {j for run in groups for j in run})
    if spare and not alone:
        out.append(([], spare, 1.0))
    if spare and alone:
        pairs = assignment(np.array([[distance(targets[i], preds[j]) for j in spare] for i in alone], float))
        out += [([alone[r]], [spare[c]], 1.0) for r, c in pairs]
        alone = [i for k, i in enumerate(alone) if k not in {r for r, _ in pairs}]
    return out + [([i], [], 1.0) for i in alone]


def quick_match(df: DataFrame) -> DataFrame:
    """df: page, targets, preds (arrays of text). A row for each group of lines that belong together: page, targets and preds
    (places), edit, target and pred (the lines, joined).

    Pages go in Arrow batches, each read by itself: one pass over each of its preds gives the distances of all its targets.
    A null array is an empty one, a null line an empty line; a page without lines has no rows; repeated pages have rows each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, targets, preds in zip(b["page"], b["targets"], b["preds"], strict=True):
                t, p = ([x or "" for x in side] if side is not None else [] for side in (targets, preds))
                out += [(page, a, b, e, "".join(t[i] for i in a), "".join(p[j] for j in b)) for a, b, e in matched(t, p, costs(t, p))]
            yield pd.DataFrame(out, columns=["page", "targets", "preds", "edit", "target", "pred"])

    kind = df.schema["page"].dataType.simpleString()
    return df.select("page", "targets", "preds").mapInPandas(run, f"page {kind}, targets array<int>, preds array<int>, edit double, target string, pred string")
